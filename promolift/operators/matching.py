"""Building a comparable control panel when none is supplied.

Only the call signatures of clustering, resampling and matching are given as a
model to follow; the definitions below are this library's own and deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.functions import vocabulary as V
from promolift.functions.columns import panel_arm, stage_is
from promolift.functions.joins import even_join
from promolift.functions.ranks import with_position


def week_pivot(items: DataFrame, weeks: Sequence[str]) -> DataFrame:
    """Spend per customer, one column per week; naming the weeks saves a pass."""
    return items.groupBy("id").pivot("fis_week_id", list(weeks)).sum("spend").na.fill(0)


def cluster_input(pivot: DataFrame, base: DataFrame) -> DataFrame:
    """Allocated contacts of customers with spend, a missing arm taken as control."""
    allocated = base.filter(stage_is(V.ALLOCATED))
    return pivot.join(allocated, "id").na.fill({"event_control_flag": V.CONTROL_FLAG})


def matching_candidates(items: DataFrame, base: DataFrame) -> DataFrame:
    """Allocated customers with spend: arm (missing is control) and total spend as ``score``."""
    score = items.groupBy("id").agg(F.sum("spend").alias("score"))
    arm = F.coalesce("event_control_flag", F.lit(V.CONTROL_FLAG)).alias("event_control_flag")
    arms = base.filter(stage_is(V.ALLOCATED)).select("id", arm).distinct()
    return score.join(arms, "id").select("id", "event_control_flag", "score")


def one_cluster(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("cluster", F.lit(1))


def cluster_customers(
    candidates: DataFrame,
    pivot: DataFrame,
    clusters: int = 100,
    max_iterations: int = 100,
    seed: int = 1,
) -> DataFrame:
    """K-means on the scaled weekly spend. Fitting runs Spark jobs when this is called."""
    weeks = [name for name in pivot.columns if name != "id"]
    vector = VectorAssembler(inputCols=weeks, outputCol="_raw").transform(
        candidates.join(pivot, "id")
    ).drop(*weeks)
    scaler = StandardScaler(inputCol="_raw", outputCol="_features", withMean=True).fit(vector)
    scaled = scaler.transform(vector)
    means = KMeans(
        featuresCol="_features", predictionCol="cluster", k=clusters,
        maxIter=max_iterations, seed=seed,
    )
    return means.fit(scaled).transform(scaled).drop("_raw", "_features")


def _thinned(candidates: DataFrame) -> DataFrame:
    """Every k-th customer by score of the larger arm, so that a cluster's arms are equal.

    Adds ``_kept``, the size of both arms, and ``_rank``, the new place from 1.
    """
    is_control = F.col("event_control_flag") == V.CONTROL_FLAG
    sizes = candidates.groupBy("cluster").agg(
        F.count_if(~is_control).alias("_test"), F.count_if(is_control).alias("_control")
    )
    sizes = sizes.withColumn("_kept", F.least("_test", "_control"))
    placed = even_join(
        with_position(candidates, ["cluster", "event_control_flag"], "score", "id"), sizes,
        ["cluster"], "inner")
    arm = F.when(is_control, F.col("_control")).otherwise(F.col("_test"))
    # Integer division: places reach beyond what a double holds exactly.
    quota = placed.withColumn("_arm", arm).selectExpr(
        "*", "(position * _kept) div _arm as _rank", "((position - 1) * _kept) div _arm as _last")
    return quota.filter("_rank > _last").drop("_arm", "_last")


def systematic_resample(candidates: DataFrame, threshold: int = 10) -> DataFrame:
    """Equal arms in every cluster: every k-th customer by score of the larger arm.

    Clusters with fewer than ``threshold`` customers in an arm are left out;
    :func:`left_out` says how many customers that concerns.
    """
    is_control = F.col("event_control_flag") == V.CONTROL_FLAG
    return _thinned(candidates).filter(F.col("_kept") >= threshold).select(
        "id", "event_control_flag", "cluster", "score",
        F.when(is_control, V.CONTROL_ARM).otherwise(V.TEST_ARM).alias("test_panel"),
    )


def left_out(candidates: DataFrame, threshold: int = 10) -> DataFrame:
    """``cluster, customers`` of the clusters that are too small to resample."""
    is_control = F.col("event_control_flag") == V.CONTROL_FLAG
    sizes = candidates.groupBy("cluster").agg(
        F.count("*").alias("customers"), F.count_if(is_control).alias("_control"))
    smaller = F.least(F.col("customers") - F.col("_control"), F.col("_control"))
    return sizes.filter(smaller < threshold).select("cluster", "customers")


def one_to_one_match(candidates: DataFrame) -> DataFrame:
    """Pairs of a test and a control customer at the same place by score in a cluster.

    The larger arm is thinned evenly first, so both arms are used over their
    whole range and their scores are alike. A cluster with one arm has no pairs.
    """
    placed = _thinned(candidates)
    is_control = F.col("event_control_flag") == V.CONTROL_FLAG

    def arm(condition, name: str) -> DataFrame:
        return placed.filter(condition).select(
            "cluster", F.col("_rank").alias("position"), F.col("id").alias(f"{name}_id"),
            F.col("score").alias(f"{name}_score"),
        )

    return arm(~is_control, "test").join(arm(is_control, "control"), ["cluster", "position"])


def panel_of_pairs(pairs: DataFrame) -> DataFrame:
    """Both customers of each pair: ``id`` and ``event_control_flag``."""
    return pairs.select(F.explode(F.array(
        F.struct(F.col("test_id").alias("id"), F.lit(1).alias("event_control_flag")),
        F.struct(F.col("control_id").alias("id"), F.lit(0).alias("event_control_flag")),
    )).alias("one")).select("one.*")


def build_panel(
    candidates: DataFrame | None = None, how: str = "systematic", external: DataFrame | None = None,
    threshold: int = 10,
) -> DataFrame:
    """A panel for uplift: ``id`` and ``event_control_flag``, 0 control and 1 test.

    ``how`` is ``external`` (a given panel of the same columns, flags 0/1 or N/Y),
    ``systematic`` or ``one_to_one``, both from clustered candidates.
    """
    if how == "external":
        return external.select("id", panel_arm("event_control_flag").alias("event_control_flag"))
    if how == "systematic":
        chosen = systematic_resample(candidates, threshold)
        return chosen.select("id", F.col("test_panel").cast("int").alias("event_control_flag"))
    if how == "one_to_one":
        return panel_of_pairs(one_to_one_match(candidates))
    raise ValueError(f"unknown panel {how!r}; valid: external, systematic, one_to_one")
