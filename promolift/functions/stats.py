"""Uplift statistics as aggregate expressions: any number of groups is one job.

The covariance model is ordinary least squares of the campaign outcome on the
outcome before and the arm. Its closed form needs only counts, means, variances
and covariances per arm, which Spark merges from partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promolift.functions import vocabulary as V
from promolift.functions.columns import ratio

ARMS = {"test": V.TEST_ARM, "control": V.CONTROL_ARM}


def arm_aggregates(metrics: list[str]) -> list[Column]:
    """Per arm: customers, and moments of ``pre_<metric>`` and ``post_<metric>``."""
    aggregates = []
    for arm, flag in ARMS.items():
        in_arm = F.col("event_control_flag") == flag
        aggregates.append(F.count_if(in_arm).alias(f"{arm}_n"))
        for metric in metrics:
            pre = F.when(in_arm, F.col(f"pre_{metric}").cast("double"))
            post = F.when(in_arm, F.col(f"post_{metric}").cast("double"))
            aggregates += [
                F.sum(pre).alias(f"{arm}_{metric}_pre"),
                F.sum(post).alias(f"{arm}_{metric}_post"),
                F.var_pop(pre).alias(f"{arm}_{metric}_var_pre"),
                F.var_pop(post).alias(f"{arm}_{metric}_var_post"),
                F.covar_pop(pre, post).alias(f"{arm}_{metric}_covar"),
            ]
    return aggregates


def expected(metric: str) -> Column:
    """Test outcome had the test arm moved as the control arm did."""
    growth = ratio(F.col(f"control_{metric}_post"), F.col(f"control_{metric}_pre"))
    return growth * F.col(f"test_{metric}_pre")


def ratio_uplift(metric: str) -> Column:
    return F.col(f"test_{metric}_post") - expected(metric)


def ancova(metric: str) -> dict[str, Column]:
    """Slope, uplift per test customer, total uplift, standard error and verdict.

    Without variance before the campaign the slope is 0 and the uplift is the
    difference of means. The error needs at least four customers.
    """
    n_test, n_control = F.col("test_n"), F.col("control_n")

    def pooled(moment: str) -> Column:
        arms = [
            F.coalesce(F.col(f"{arm}_n") * F.col(f"{arm}_{metric}_{moment}"), F.lit(0.0))
            for arm in ARMS
        ]
        return arms[0] + arms[1]

    def difference(moment: str) -> Column:
        return ratio(F.col(f"test_{metric}_{moment}"), n_test) - ratio(
            F.col(f"control_{metric}_{moment}"), n_control
        )

    sxx, sxy, syy = pooled("var_pre"), pooled("covar"), pooled("var_post")
    slope = F.coalesce(F.try_divide(sxy, sxx), F.lit(0.0))
    uplift = difference("post") - slope * difference("pre")
    freedom = n_test + n_control - 3
    mse = F.when(freedom > 0, (syy - slope * sxy) / freedom)
    spread = F.coalesce(F.try_divide(difference("pre") ** 2, sxx), F.lit(0.0))
    error = F.sqrt(
        F.greatest(mse, F.lit(0.0))
        * (ratio(F.lit(1), n_test) + ratio(F.lit(1), n_control) + spread)
    )
    # NULL mse must stay NULL although greatest() skips NULLs.
    error = F.when(mse.isNotNull(), error)
    size = F.abs(uplift)
    verdict = (
        F.when(size > V.SIGNIFICANT_Z * error, "significant")
        .when(size > V.DIRECTIONAL_Z * error, "directional")
        .otherwise("not significant")
    )
    return {
        "slope": slope,
        "uplift_per_test_customer": uplift,
        "total_uplift": uplift * n_test,
        "standard_error": error,
        "verdict": verdict,
    }
