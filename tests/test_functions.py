"""Column expressions, joins, ranks and statistics."""

from __future__ import annotations

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from promolift.functions.columns import age_band, is_targeted, is_unknown_id, slot_segment
from promolift.functions.joins import even_join
from promolift.functions.ranks import magnitude_bucket, with_position
from promolift.functions.stats import ancova, arm_aggregates, expected, ratio_uplift


def test_slot_segments(spark):
    cases = [
        (1.0, "N", "baulcm"), (8.0, "N", "baulcm"), (3.0, "Y", "lessloyal"), (4.0, "Y", "others"),
        (1.0, None, "others"), (9.0, None, "baby"), (20.0, "Y", "npm"), (24.0, "N", "extralcm"),
        (25.0, "N", "babyextra"), (29.0, "N", "nfm"), (40.0, "N", "additional"),
        (41.0, "N", "others"), (None, "N", "others"), (8.5, "N", "others"), (7.5, "N", "baulcm"),
    ]
    df = spark.createDataFrame(cases, "rank double, flag string, expected string")
    found = df.withColumn("found", slot_segment(F.col("rank"), F.col("flag")))
    assert found.filter("found <> expected").collect() == []


def test_age_bands_keep_fractions(spark):
    day = dt.date(2000, 1, 1)
    cases = [
        (66 * 365, "56-66"), (66 * 365 + 4, "67 eller mer"), (25 * 365, "0-25"), (25 * 365 + 1, "26-35"),
        (1, "0-25"), (0, "Uklassifiserte"), (-5, "Uklassifiserte"), (None, "Uklassifiserte"),
    ]
    rows = [(None if d is None else day - dt.timedelta(days=d), name) for d, name in cases]
    df = spark.createDataFrame(rows, "birth date, expected string")
    found = df.withColumn("found", age_band(F.col("birth"), F.lit(day)))
    assert found.filter("found <> expected").collect() == []


def test_unknown_ids_and_targeted_rows(spark):
    ids = spark.createDataFrame([(None,), ("",), ("  ",), ("null",), ("01",)], "id string")
    assert ids.filter(~is_unknown_id()).collect() == [("01",)]
    rows = [
        ("DIGITAL_APP", "ACT", True), ("DIGITAL_APP", "DLV", False), ("PAPER", "DLV", True),
        ("PAPER", "ACT", False), ("digital", "DLV", True), (None, "DLV", False), (None, "ACT", False),
    ]
    df = spark.createDataFrame(rows, "channel_code string, contact_stage_code string, expected boolean")
    assert df.filter(F.coalesce(is_targeted(), F.lit(False)) != F.col("expected")).collect() == []


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_even_join_equals_a_plain_join(spark, how):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, x int")
    right = spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "k string")
    plain = left.join(right, ["k"], how)
    assert sorted(even_join(left, right, ["k"], how).collect(), key=str) == sorted(
        plain.collect(), key=str
    )


def test_a_hot_key_is_split_by_the_adaptive_engine(spark):
    """A third of the rows on one key, the right side grouped by that key."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        number = F.col("id")
        left = spark.range(0, 60000, 1, 8).select(
            F.when(number % 3 == 0, 0).otherwise(number).alias("k"), F.md5(number.cast("string")).alias("x")
        )
        right = spark.range(60000).groupBy(F.col("id").alias("k")).agg(F.count("*").alias("n"))
        joined = even_join(left, right, ["k"]).groupBy("n").agg(F.sum(F.length("x")).alias("chars"))
        assert joined.collect() == [(1, 60000 * 32)]
        final = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "SortMergeJoin(skew=true)" in final
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_magnitude_bucket_keeps_order(spark):
    values = sorted({s * v for s in (1, -1) for e in range(0, 60, 3) for v in (2**e - 1, 2**e, 2**e + 1)})
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    rows = df.select("v", magnitude_bucket(F.col("v")).alias("b")).orderBy("v").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows)
    assert len({r.b for r in rows}) > 50


def test_positions_are_exact_with_a_hot_value(spark):
    rows = [(str(i), "g" if i % 4 else "h", 0 if i % 3 == 0 else (i * 7919) % 97 - 20) for i in range(900)]
    df = spark.createDataFrame(rows, "id string, arm string, score bigint")
    found = {r.id: r.position for r in with_position(df, ["arm"], "score", "id").collect()}
    for arm in "gh":
        order = sorted(
            (r for r in rows if r[1] == arm),
            key=lambda r: (r[2], hashlib.md5(r[0].encode()).hexdigest(), r[0]),
        )
        assert [found[r[0]] for r in order] == list(range(1, len(order) + 1))


def statistics(spark, rows):
    schema = "event_control_flag int, pre_m double, post_m double"
    return spark.createDataFrame(rows, schema).agg(*arm_aggregates(["m"]))


def test_ancova_equals_least_squares(spark):
    rng = np.random.default_rng(7)
    arm = np.repeat([0, 1], [40, 60])
    pre = rng.normal(50, 10, 100)
    post = 5 + 0.7 * pre + 3 * arm + rng.normal(0, 4, 100)
    design = np.column_stack([np.ones(100), pre, arm])
    beta, residual, *_ = np.linalg.lstsq(design, post, rcond=None)
    error = np.sqrt(np.linalg.inv(design.T @ design)[2, 2] * residual[0] / 97)

    rows = [(int(a), float(x), float(y)) for a, x, y in zip(arm, pre, post)]
    model = {name: column.alias(name) for name, column in ancova("m").items()}
    (found,) = statistics(spark, rows).select(*model.values()).collect()
    assert found.slope == pytest.approx(beta[1])
    assert found.uplift_per_test_customer == pytest.approx(beta[2])
    assert found.total_uplift == pytest.approx(beta[2] * 60)
    assert found.standard_error == pytest.approx(error)
    assert found.verdict == "significant"


def test_uplift_edges(spark):
    single = statistics(spark, [(1, 1.0, 2.0), (0, 1.0, 1.0), (0, 3.0, 3.0)])
    (found,) = single.select(*[c.alias(n) for n, c in ancova("m").items()]).collect()
    assert found.total_uplift == pytest.approx(1.0)
    assert found.standard_error is None and found.verdict == "not significant"

    flat = statistics(spark, [(1, 0.0, 5.0), (1, 0.0, 7.0), (0, 0.0, 2.0), (0, 0.0, 4.0)])
    columns = [ancova("m")["total_uplift"].alias("t"), expected("m").alias("e"), ratio_uplift("m").alias("r")]
    (found,) = flat.select(*columns).collect()
    assert found.t == pytest.approx(6.0) and found.e is None and found.r is None

    lonely = statistics(spark, [(1, 1.0, 2.0)])
    (found,) = lonely.select(*columns).collect()
    assert found.t is None

    half = statistics(spark, [(1, 10.0, 30.0), (0, 4.0, 6.0)])
    (found,) = half.select(*columns).collect()
    assert found.e == pytest.approx(15.0) and found.r == pytest.approx(15.0)
