"""Writing reports and shared intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table_name(database: str, prefix: str, part: str, suffix: str, grouping: str = "") -> str:
    """Name of a report table; ``grouping`` keeps several reports of one module apart."""
    return f"{database}." + "_".join(word for word in (prefix, part, grouping, suffix) if word)


def write_report(report: DataFrame, name: str, path: str | None = None) -> str:
    """Replace a report table in the catalog (external when ``path`` is given)."""
    writer = report.write.mode("overwrite").format("parquet")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return name


def drop_reports(spark: SparkSession, names: list[str]) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that every executor can read.

    The cluster names its shared storage in ``spark.checkpoint.dir``.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{root.rstrip('/')}/promolift-{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a staged table that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Lets Spark delete the shuffle files of a command when it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(frame: DataFrame, folder: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a frame that several passes read, and read it back.

    Unlike a cache the written table is columnar, prunes columns and partitions,
    and outlives the executors that made it. The shuffle files it was made from go
    at once; Spark else keeps them until the driver happens to collect its garbage.
    """
    writer, conf = frame.write.mode("errorifexists"), frame.sparkSession.conf
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = conf.get(CLEAN_UP, "false")
    conf.set(CLEAN_UP, "true")
    try:
        writer.parquet(folder)
    finally:
        conf.set(CLEAN_UP, before)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)
