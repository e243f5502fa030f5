"""Exact positions within large groups, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRECISION_BITS = 6


def magnitude_bucket(value: Column) -> Column:
    """A coarse, order-preserving bucket of an integer: exponent and leading bits.

    At most ``2**PRECISION_BITS`` buckets per power of two, so a group has some
    thousands of buckets at most, whatever its size and without looking at data.
    """
    steps = 1 << PRECISION_BITS

    def bucket(number: Column) -> Column:
        size = F.abs(number)
        shift = F.greatest(F.length(F.bin(size)) - 1 - PRECISION_BITS, F.lit(0))
        unsigned = shift * steps + F.floor(size / F.pow(F.lit(2.0), shift))
        return (F.signum(number) * unsigned).cast("bigint")

    # The lambda names the column once. Joins on a bucket infer filters from its
    # definition, in a number that doubles with each mention of the column.
    return F.transform(F.array(value), bucket)[0]


def with_position(df: DataFrame, group: list[str], order: str, key: str) -> DataFrame:
    """Add ``position``: 1-based place in ``group`` by integer ``order``, then md5 of ``key``.

    The order is (order, md5(key), key). Its three nested parts are counted
    apart: whole buckets of values, then values and hash prefixes in a bucket,
    then single rows. A window only ever sorts one of these parts, so neither a
    group holding all rows nor one value holding a third of them is sorted in
    one task.
    """
    prepared = df.withColumn("_digest", F.md5(F.col(key).cast("binary"))).withColumns({
        "_bucket": magnitude_bucket(F.col(order)),
        "_prefix": F.substring("_digest", 1, 2),
    })
    cells = prepared.groupBy(*group, "_bucket", order, "_prefix").agg(F.count("*").alias("_n"))

    before = lambda window: F.coalesce(
        F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    buckets = cells.groupBy(*group, "_bucket").agg(F.sum("_n").alias("_n"))
    buckets = buckets.withColumn(
        "_before_bucket", before(Window.partitionBy(*group).orderBy("_bucket"))
    ).drop("_n")
    in_bucket = Window.partitionBy(*group, "_bucket").orderBy(order, "_prefix")
    offsets = cells.withColumn("_before_cell", before(in_bucket)).drop("_n")
    offsets = offsets.join(buckets, [*group, "_bucket"])

    cell = [*group, "_bucket", order, "_prefix"]
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy("_digest", key))
    placed = prepared.withColumn("_inside", inside).join(offsets, cell)
    position = F.col("_before_bucket") + F.col("_before_cell") + F.col("_inside")
    return placed.withColumn("position", position.cast("bigint")).select(*df.columns, "position")
