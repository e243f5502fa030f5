"""Sources and sinks."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from promolift.sources import sinks, tables, text
from promolift.sources.tables import Period


def test_delimited_text_keeps_empty_and_quoted_fields(spark, tmp_path):
    (tmp_path / "f.txt").write_text('1;;"x"\n2;a b;\n')
    found = text.read_app_customers(spark, str(tmp_path / "f.txt")).collect()
    assert [tuple(r) for r in found] == [("01", "", '"x"'), ("02", "a b", "")]
    (tmp_path / "p.txt").write_text("7,Y\n8,N\n")
    assert text.read_resample_panel(spark, str(tmp_path / "p.txt")).collect() == [("7", "Y"), ("8", "N")]
    (tmp_path / "s.txt").write_text("a|b\n")
    assert text.read_delimited(spark, str(tmp_path / "s.txt"), "|", ["x", "y"]).collect() == [("a", "b")]


def test_periods_by_start_or_by_number_of_weeks(spark):
    days = spark.sql("select explode(sequence(date'2000-01-01', date'2000-03-31')) as date")
    calendar = days.select("date", F.date_format("date", "yyyyDDD").substr(1, 6).alias("fis_week_id"))
    rows = spark.createDataFrame(
        [("1", "P", "t", 2.9, "200003"), ("1", "P", "t", -2.9, "200004"), ("1", "P", "t", 1.0, "200006"),
         ("", "P", "t", 1.0, "200004"), (None, "P", "t", 1.0, "200004"), ("1", " ", "t", 1.0, "200004")],
        "card_code string, prod_code string, transaction_code string, net_spend_amt double, fis_week_id string",
    ).withColumns({"transaction_dttm": F.current_timestamp(), "prod_id": F.lit("7")})
    by_start = tables.items_in(rows, Period(start="200003", end="200005"))
    assert [r.spend for r in by_start.collect()] == [2, -2]
    by_weeks = tables.items_in(rows, Period(end="200005", weeks=2), calendar)
    assert [r.spend for r in by_weeks.collect()] == [-2]
    with pytest.raises(ValueError):
        tables.items_in(rows, Period(end="200005"))


def test_filters_and_columns_reach_the_scan(spark):
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(
        F.col("l_linestatus").alias("card_code"), F.col("l_returnflag").alias("prod_code"),
        F.col("l_orderkey").alias("transaction_code"), F.col("l_tax").alias("net_spend_amt"),
        F.col("l_shipdate").alias("transaction_dttm"), F.col("l_returnflag").alias("fis_week_id"),
        F.col("l_partkey").alias("prod_id"), "l_suppkey",
    )
    plan = (
        tables.items_in(items, Period(start="A", end="N")).select("id", "spend")
        ._jdf.queryExecution().executedPlan().toString()
    )
    assert "GreaterThanOrEqual(l_returnflag,A)" in plan and "l_suppkey" not in plan


def test_report_tables_are_replaced_and_dropped(spark, tmp_path):
    name = sinks.table_name("default", "p", "cost", uuid.uuid4().hex[:8], "g1")
    for value in (1, 2):
        sinks.write_report(spark.range(value), name, str(tmp_path / "table"))
    assert spark.table(name).count() == 2
    sinks.drop_reports(spark, [name])
    assert not spark.catalog.tableExists(name)


def test_staged_frames_prune_partitions(spark, tmp_path):
    frame = spark.createDataFrame([("A", 1), ("B", 2), (None, 3)], "s string, n int")
    staged = sinks.stage(frame, str(tmp_path / "staged"), ["s"])
    assert sorted(staged.select("s", "n").collect(), key=str) == sorted(frame.collect(), key=str)
    plan = staged.filter("s = 'A'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(s" in plan


def test_shared_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = sinks.shared_folder(spark), sinks.shared_folder(spark)
    assert first.startswith(root) and second.startswith(root) and first != second


def test_a_staged_table_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f.getName() for f in files_of(manager) if f.getName().startswith("shuffle_")}
    before, setting = shuffles(), spark.conf.get(sinks.CLEAN_UP, None)
    sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    staged = sinks.stage(sums, sinks.shared_folder(spark))
    assert shuffles() <= before
    assert spark.conf.get(sinks.CLEAN_UP, None) in (setting, "false")
    assert sorted(map(tuple, staged.collect())) == sorted(map(tuple, sums.collect()))


def files_of(manager):
    files = manager.getAllFiles()
    return [files.apply(i) for i in range(files.size())]
