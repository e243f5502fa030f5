"""From prepared frames to a panel of test and control customers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.operators.feature_matching import bounded_clusters, feature_match, with_features
from promolift.operators.matching import (
    build_panel,
    cluster_customers,
    matching_candidates,
    one_cluster,
    panel_of_pairs,
    week_pivot,
)
from promolift.operators.modules import CampaignFrames
from promolift.sources import sinks


def campaign_panel(
    frames: CampaignFrames, weeks: Sequence[str], how: str = "features", clusters: int = 100,
    most: int | None = None, threshold: int = 10,
) -> DataFrame:
    """``id, event_control_flag`` of comparable arms among the allocated customers.

    Customers are clustered by their spend in ``weeks`` before the campaign
    (one cluster: no clustering), clusters above ``most`` customers are halved,
    and the arms are made alike inside each: ``features`` pairs by all weeks,
    ``one_to_one`` by total spend, ``systematic`` thins the larger arm.
    """
    if how not in ("features", "one_to_one", "systematic"):
        raise ValueError(f"unknown panel {how!r}; valid: features, one_to_one, systematic")
    folder = sinks.shared_folder(frames.base.sparkSession)
    items = frames.items.filter("in_pre")
    pivot = sinks.stage(week_pivot(items, weeks), f"{folder}/weeks")
    candidates = sinks.stage(matching_candidates(items, frames.base), f"{folder}/candidates")
    clustered = cluster_customers(candidates, pivot, clusters) if clusters > 1 else one_cluster(candidates)
    described = with_features(clustered, pivot)
    if most is not None:
        parts = bounded_clusters(described, most)
        described = parts.withColumn("cluster", F.concat_ws("/", "cluster", "part")).drop("part")
    if how == "features":
        return panel_of_pairs(feature_match(described))
    return build_panel(described.drop("features"), how, threshold=threshold)
