"""Uplift of a test panel over its control panel, at any grouping levels."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolift.functions import levels as L
from promolift.functions import vocabulary as V
from promolift.functions.columns import ratio, stage_is
from promolift.functions.stats import ancova, arm_aggregates, expected, ratio_uplift
from promolift.operators.cost import cost_measures
from promolift.operators.facts import customer_outcomes, uplift_panel
from promolift.operators.modules import CampaignFrames
from promolift.operators.rollup import group_by_levels, key_name, level_names, report
from promolift.sources.sinks import stage

METRICS = ("units", "spend", "visits")

# Measure name to the metric it evaluates and what it divides the uplift by.
MEASURES = {
    "units_uplift": ("units", None),
    "sales_uplift": ("spend", None),
    "visits_uplift": ("visits", None),
    "adjusted_sales_uplift": ("spend", None),
    "units_uplift_percentage": ("units", "expected"),
    "visits_uplift_percentage": ("visits", "expected"),
    "sales_uplift_percentage": ("spend", "expected"),
    "adjusted_uplift_percentage": ("spend", "expected"),
    "adjusted_uplift_per_customer": ("spend", "customers"),
    "uplift_per_customer": ("spend", "customers"),
    "scr": ("spend", "cost"),
}
NAMES = tuple(MEASURES)


def panel_outcomes(frames: CampaignFrames, source: str = "basket") -> DataFrame:
    """The panel with each customer's outcomes, from baskets or from item lines."""
    lines = frames.baskets if source == "basket" else frames.items
    return uplift_panel(frames.panel, customer_outcomes(lines, source))


def arm_statistics(
    base: DataFrame, outcomes: DataFrame, levels: Sequence, metrics: Sequence[str]
) -> DataFrame:
    """Arm moments per level and group: key columns, ``grouping_level``, statistics.

    The overall group is the whole panel. In other levels a panel customer is in
    each group it was allocated in, once.
    """
    levels = L.parse_levels(levels)
    keys = L.key_columns(levels)
    names = [key_name(key) for key in keys]
    columns = ["event_control_flag"] + [f"{s}_{m}" for m in metrics for s in ("pre", "post")]
    sets = {L.level_mask(level, keys): level for level in levels if level}

    members = []
    if sets:
        allocated = base.filter(stage_is(V.ALLOCATED) & F.col("id").isNotNull())
        slim = allocated.select(
            "id", *[L.null_labelled(F.col(key)).alias(key_name(key)) for key in keys]
        )
        grouped = group_by_levels(slim, keys, sets, ["id"], [F.lit(1).alias("_one")])
        for name in names:
            if name not in grouped.columns:
                grouped = grouped.withColumn(name, F.lit(None).cast("string"))
        members.append(
            grouped.join(outcomes, "id").select("_mask", *names, *columns)
        )
    if () in levels:
        members.append(
            outcomes.select(
                F.lit(L.level_mask((), keys)).cast("bigint").alias("_mask"),
                *[F.lit(None).cast("string").alias(name) for name in names],
                *columns,
            )
        )
    rows = members[0] if len(members) == 1 else members[0].unionByName(members[1])
    statistics = rows.groupBy("_mask", *names).agg(*arm_aggregates(list(metrics)))
    return statistics.select(
        *[L.total_labelled(F.col(key_name(key))).alias(key) for key in keys],
        level_names(levels, keys).alias("grouping_level"),
        *[name for name in statistics.columns if name not in ("_mask", *names)],
    )


def total_uplift(metric: str, method: str) -> Column:
    return ancova(metric)["total_uplift"] if method == "ancova" else ratio_uplift(metric)


def uplift_report(
    frames: CampaignFrames,
    levels: Sequence,
    names: Iterable[str] | None = None,
    method: str = "ancova",
    source: str = "basket",
    folder: str | None = None,
) -> DataFrame:
    """The named measures per group; with ``folder`` what they are made from is written there when this is called."""
    names = list(dict.fromkeys(NAMES if names is None else names))
    unknown = [name for name in names if name not in MEASURES]
    if unknown:
        raise ValueError(f"unknown uplift measure(s) {unknown}; valid names: {sorted(MEASURES)}")
    if method not in ("ancova", "ratio"):
        raise ValueError(f"unknown uplift method {method!r}; valid: ancova, ratio")
    if source not in ("item", "basket"):
        raise ValueError(f"unknown uplift source {source!r}; valid: item, basket")

    metrics = list(dict.fromkeys(MEASURES[name][0] for name in names))
    keys = L.key_columns(L.parse_levels(levels))
    outcomes = panel_outcomes(frames, source)
    if folder is not None:
        outcomes = stage(outcomes, f"{folder}/outcomes")
    statistics = arm_statistics(frames.base, outcomes, levels, metrics)
    if folder is not None:
        statistics = stage(statistics, f"{folder}/statistics")
    group = [*keys, "grouping_level"]
    if "scr" in names:
        costs = report(cost_measures(frames, ["campaign_cost"]), levels, folder and f"{folder}/costs")
        statistics = statistics.join(costs, group, "left")

    columns = []
    for name in names:
        metric, divisor = MEASURES[name]
        value = total_uplift(metric, method)
        if divisor == "expected":
            value = ratio(value, expected(metric))
        elif divisor == "customers":
            value = ratio(value, F.col("test_n"))
        elif divisor == "cost":
            value = ratio(value, F.col("campaign_cost"))
        columns.append(F.coalesce(value, F.lit(0.0)).alias(name))
    if names == ["scr"]:
        # On its own the measure exists only where there is a cost.
        statistics = statistics.filter(F.col("campaign_cost").isNotNull())
    return statistics.select(*group, *columns)


def uplift_statistics(
    frames: CampaignFrames,
    levels: Sequence,
    metrics: Sequence[str] = METRICS,
    method: str = "ancova",
    source: str = "basket",
) -> DataFrame:
    """The full model output, one row per group and metric."""
    keys = L.key_columns(L.parse_levels(levels))
    statistics = arm_statistics(frames.base, panel_outcomes(frames, source), levels, metrics)
    rows = []
    for metric in metrics:
        fields = {"total_uplift": ratio_uplift(metric)} if method == "ratio" else ancova(metric)
        fields = {"expected": expected(metric), **fields}
        rows.append(
            F.struct(
                F.lit(metric).alias("metric"),
                *[column.alias(name) for name, column in fields.items()],
            )
        )
    return (
        statistics.withColumn("_row", F.explode(F.array(*rows)))
        .select(
            *keys, "grouping_level",
            F.col("test_n").alias("total_test_cust"),
            F.col("control_n").alias("total_control_cust"),
            "_row.*",
        )
    )
