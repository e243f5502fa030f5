"""What the operators share: row identity, staged tables, prefix sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promolift.sources.sinks import shared_folder, stage

#: The characters that separate words: space, tab, line feed, vertical tab, form feed, return.
WHITE_BYTES = b" \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"


#: Folders written by :func:`staged` and not discarded yet.
_folders: list[str] = []


def staged(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame into the folder all executors share and read it back.

    The written table cuts lineage: a lost executor costs no recomputation.
    """
    folder = f"{shared_folder(frame.sparkSession)}-{name}"
    table = stage(frame, folder)
    _folders.append(folder)
    table.staged_folder = folder
    return table


def made_by(step: Callable[[], DataFrame]) -> tuple[DataFrame, list[str]]:
    """The result of a step and the folders it has staged and not discarded."""
    earlier = set(_folders)
    return step(), [folder for folder in _folders if folder not in earlier]


def discard_folders(spark: SparkSession, folders: list[str]) -> None:
    """Delete staged folders that nothing reads any more.

    A result is lazy and reads what it has staged when it is written.
    """
    context = spark.sparkContext
    for folder in folders:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        _folders.remove(folder)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; those of other results stay."""
    discard_folders(spark, [table.staged_folder for table in tables])


def spread(spark: SparkSession) -> int:
    """How many buckets work is dealt into: as many as the session shuffles into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def whole_text(column: str | Column = "text") -> Column:
    return F.coalesce(column if isinstance(column, Column) else F.col(column), F.lit(""))


def crc_of_text(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def before(value: str, group: list[str], order: list[str]) -> Column:
    """Sum of ``value`` over the earlier rows of the group, 0 for the first."""
    window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0)).cast("bigint")


def running_start(
    rows: DataFrame, group: list[str], bucket: str, order: list[str], value: str, start: str
) -> DataFrame:
    """Add ``start``: the sum of ``value`` over all earlier rows of the group.

    Rows are ordered by (bucket, order). Buckets are summed first, so a window
    sorts either the bucket totals of a group or the rows of one bucket, never
    a whole group.
    """
    totals = rows.groupBy(*group, bucket).agg(F.sum(value).alias("_bucket_total"))
    totals = totals.withColumn("_bucket_start", before("_bucket_total", group, [bucket]))
    inside = rows.withColumn("_inside", before(value, [*group, bucket], order))
    joined = inside.join(totals.drop("_bucket_total"), [*group, bucket])
    return joined.withColumn(start, F.col("_bucket_start") + F.col("_inside")).drop(
        "_bucket_start", "_inside"
    )
