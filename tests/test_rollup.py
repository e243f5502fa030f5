"""The rollup engine and levelled aggregates on hand-written frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from promolift.functions import levels as L
from promolift.operators import aggregates as G
from promolift.operators.rollup import Measure, Rows, report

SCHEMA = "id string, k string, n int, v double"
ROWS = [
    ("a", "x", 1, 1.0),
    ("a", "x", 1, 2.0),
    ("b", "x", 2, None),
    ("b", None, 2, 4.0),
    (None, "XX", 3, 8.0),
    ("c", "total", None, 16.0),
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def as_dict(df, *keys):
    return {tuple(row[k] for k in (*keys, "grouping_level")): row["m"] for row in df.collect()}


def test_levels_are_parsed_and_deduplicated():
    assert L.parse_levels(["()", "(a, b)", "a", ("a",), "('a', 'b')"]) == [(), ("a", "b"), ("a",)]
    assert L.key_columns([(), ("b", "a"), ("a", "c")]) == ["b", "a", "c"]
    assert L.level_name(("a", "b")) == "a-b" and L.level_name(()) == "overall"


def test_null_keys_and_totals_are_labelled(frame):
    found = as_dict(G.level_distinct_count(frame, ["()", "k", "(k, n)"], "m", "id"), "k", "n")
    assert found["total", "total", "overall"] == 3
    assert found["x", "total", "k"] == 2
    # A NULL key joins the literal 'XX'; a literal 'total' stays a group of its level.
    assert found["XX", "total", "k"] == 1
    assert found["total", "total", "k"] == 1
    assert found["total", "XX", "k-n"] == 1
    assert found["XX", "3", "k-n"] == 0


def test_sums_and_counts_skip_nulls(frame):
    assert as_dict(G.level_sum(frame, ["()", "k"], "m", "v"), "k")["x", "k"] == 3.0
    assert as_dict(G.level_count(frame, ["()", "k"], "m", "v"), "k")["x", "k"] == 2
    assert as_dict(G.level_average(frame, ["k"], "m", "v", "n"), "k")["x", "k"] == 1.0
    assert as_dict(G.level_distinct_average(frame, ["k"], "m", "v", "id"), "k")["x", "k"] == 1.5


def test_totals_may_be_numbers_or_frames(frame):
    total = frame.agg(F.count("*").alias("n"))
    for given in (6, total):
        assert as_dict(G.level_percentage(frame, ["k"], "m", "id", given), "k")["x", "k"] == (
            pytest.approx(100 * 2 / 6)
        )
        assert as_dict(G.level_count_average(frame, ["()"], "m", "id", given))["overall",] == (
            pytest.approx(5 / 6)
        )


def test_empty_input_gives_one_overall_row(frame):
    empty = frame.filter("false")
    for function in (G.level_sum, G.level_count, G.level_distinct_count):
        rows = function(empty, ["()", "k"], "m", "v").collect()
        assert [(r.k, r.grouping_level, r.m) for r in rows] == [("total", "overall", 0)]
    assert G.level_sum(empty, ["k"], "m", "v").collect() == []


def test_groups_of_filtered_out_rows_do_not_appear(frame):
    rows = Rows("some", frame, F.col("v") > 3)
    found = as_dict(report([Measure("m", (rows.ids(),))], ["k"]), "k")
    assert set(found) == {("XX", "k"), ("total", "k")}


def test_a_level_may_name_the_counted_column(frame):
    found = as_dict(G.level_distinct_count(frame, ["(id, k)", "()"], "m", "id"), "id", "k")
    assert found["a", "x", "id-k"] == 1
    assert found["XX", "XX", "id-k"] == 0


def test_same_columns_in_two_orders_keep_both_names(frame):
    found = as_dict(G.level_count(frame, ["(k, n)", "(n, k)"], "m", "id"), "k", "n")
    assert found["x", "1", "k-n"] == found["x", "1", "n-k"] == 2


def test_overall_only_measure_is_added_without_showing_other_overall_values(frame):
    rows = Rows("all", frame, F.lit(True))
    result = report(
        [Measure("m", (rows.ids(),)), Measure("whole", (rows.count("id"),), overall_only=True)], ["k"]
    )
    overall = [r for r in result.collect() if r.grouping_level == "overall"]
    assert [(r.k, r.m, r.whole) for r in overall] == [("total", 0, 5)]
    assert all(r.whole == 0 for r in result.collect() if r.grouping_level == "k")


def test_ratio_needs_both_sides_and_zero_division_gives_zero(frame):
    left = Rows("left", frame, F.col("k") == "x")
    right = Rows("right", frame, F.col("n") >= 2)
    measure = Measure("m", (left.count("v"), right.count("v")), lambda a, b: F.try_divide(a, b))
    assert as_dict(report([measure], ["k"]), "k") == {("x", "k"): 0.0}


def test_measure_order_does_not_matter(frame):
    rows = Rows("all", frame, F.lit(True))
    one, two = Measure("one", (rows.ids(),)), Measure("two", (rows.sum("v"),))
    ab = report([one, two], ["()", "k"]).select("k", "grouping_level", "one", "two")
    ba = report([two, one], ["()", "k"]).select("k", "grouping_level", "one", "two")
    assert sorted(ab.collect()) == sorted(ba.collect())


def test_levels_add_up(frame):
    sums = as_dict(G.level_sum(frame, ["()", "k"], "m", "v"), "k")
    assert sum(v for key, v in sums.items() if key[-1] == "k") == sums["total", "overall"]
    ids = as_dict(G.level_distinct_count(frame, ["()", "k"], "m", "id"), "k")
    parts = [v for key, v in ids.items() if key[-1] == "k"]
    assert max(parts) <= ids["total", "overall"] <= sum(parts)


def test_one_shuffle_per_step_whatever_the_number_of_measures(frame):
    rows = [Rows(f"r{i}", frame, F.col("n") > i) for i in range(8)]
    plan = report(
        [Measure(f"m{i}", (r.ids(),)) for i, r in enumerate(rows)], ["()", "k", "n"]
    )._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("Expand") == 1
