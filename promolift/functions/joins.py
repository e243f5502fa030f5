"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def even_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "left", null_safe: bool = False
) -> DataFrame:
    """Equi-join whose hot left keys the adaptive engine can split.

    The adaptive skew split only applies where both inputs are read straight
    from a shuffle written for this join, and no later step reuses its
    partitioning. A right side that was just grouped by the same key would be
    joined in place, which rules the split out. Joining on one more key, a hash
    of the others, makes Spark write that shuffle; equal keys have equal hashes,
    so the result is unchanged. Small right sides are still broadcast by size.
    With ``null_safe`` a NULL key matches a NULL key.
    """
    tag = "_key_hash"
    with_tag = F.hash(*on)
    if not null_safe:
        joined = left.withColumn(tag, with_tag).join(right.withColumn(tag, with_tag), [*on, tag], how)
        return joined.drop(tag)
    other = {name: f"_other_{name}" for name in on}
    renamed = right.withColumn("_other_hash", with_tag).withColumnsRenamed(other)
    same = F.col(tag) == F.col("_other_hash")
    for name, theirs in other.items():
        same = same & F.col(name).eqNullSafe(F.col(theirs))
    return left.withColumn(tag, with_tag).join(renamed, same, how).drop(tag, "_other_hash", *other.values())
