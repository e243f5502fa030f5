"""Reports: one module at its levels, and all modules side by side."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.functions import levels as L
from promolift.functions import vocabulary as V
from promolift.operators.allocation import allocation_measures
from promolift.operators.cost import cost_measures
from promolift.operators.fraud import fraud_measures
from promolift.operators.impact import impact_measures
from promolift.operators.modules import CampaignFrames
from promolift.operators.redemption import redemption_measures
from promolift.operators.rollup import report
from promolift.operators.uplift import uplift_report

MODULES = {
    "allocation": allocation_measures,
    "cost": cost_measures,
    "customer_impact": impact_measures,
    "fraud": fraud_measures,
    "redemption": redemption_measures,
}


def module_report(
    module: str,
    frames: CampaignFrames,
    levels: Sequence,
    names: Iterable[str] | None = None,
    **options,
) -> DataFrame:
    """All (or the named) measures of a module at the given levels, in one wide frame."""
    if module == "uplift":
        return uplift_report(frames, levels, names, **options)
    if module not in MODULES:
        raise ValueError(f"unknown module {module!r}; valid: {sorted([*MODULES, 'uplift'])}")
    keys = L.key_columns(L.parse_levels(levels))
    return report(MODULES[module](frames, names, keys), levels)


def combined_report(
    frames: CampaignFrames, levels: Sequence, modules: Iterable[str] = tuple(MODULES), folder: str | None = None
) -> DataFrame:
    """All measures of several modules at the same levels, as one report.

    The modules' measures over one frame share its pass, and what several modules
    look up (buyers, coupons, exposures) is planned once. Equals the module
    reports joined on every key. With ``folder`` the groups of each pass are written
    there when this is called, which bounds the shuffle files by those of one pass.
    """
    keys = L.key_columns(L.parse_levels(levels))
    return report([m for module in modules for m in MODULES[module](frames, None, keys)], levels, folder)


def final_report(reports: Sequence[DataFrame] | Mapping[str, DataFrame]) -> DataFrame:
    """All module reports side by side on the union of their key columns.

    A key a module does not group by counts as ``total``; a measure a group does
    not have counts as 0. The reports are stacked and grouped once, which equals
    a full outer join of all of them on every key.
    """
    reports = list(reports.values()) if isinstance(reports, Mapping) else list(reports)
    # In a report the key columns come before grouping_level, the measures after it.
    split = [report.columns.index("grouping_level") for report in reports]
    keys = list(dict.fromkeys(k for r, at in zip(reports, split) for k in r.columns[:at]))
    measures = [m for r, at in zip(reports, split) for m in r.columns[at + 1:]]
    repeated = sorted({m for m in measures if measures.count(m) > 1 or m in keys})
    if repeated:
        raise ValueError(f"measure(s) in more than one report: {repeated}")

    aligned = [
        r.select(
            *[F.col(k) if k in r.columns[:at] else F.lit(V.TOTAL_KEY).alias(k) for k in keys],
            *r.columns[at:],
        )
        for r, at in zip(reports, split)
    ]
    stacked = aligned[0]
    for frame in aligned[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.groupBy(*keys, "grouping_level").agg(
        *[F.coalesce(F.max(name), F.lit(0)).alias(name) for name in measures]
    )
