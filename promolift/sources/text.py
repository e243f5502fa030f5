"""Delimited text sources. Fields have fixed positions; there is no header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolift.functions import vocabulary as V


def read_delimited(spark: SparkSession, path: str, separator: str, columns: list[str]) -> DataFrame:
    """All-text columns; quotes are ordinary characters and empty fields stay empty text."""
    fields = F.split("value", "\\Q" + separator + "\\E")
    lines = spark.read.text(path)
    return lines.select(*[F.get(fields, F.lit(i)).alias(name) for i, name in enumerate(columns)])


def read_app_customers(spark: SparkSession, path: str) -> DataFrame:
    """App users; the card number in the file lacks its leading digit."""
    users = read_delimited(spark, path, ";", ["id", "first_login", "last_login"])
    return users.withColumn("id", F.concat(F.lit(V.MEMBER_PREFIX), "id"))


def read_resample_panel(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, ",", ["id", "event_control_flag"])
