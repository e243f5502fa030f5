from __future__ import annotations

import math
import random

import pytest

from promolift.operators import feature_matching as fm
from promolift.operators import matching
from promolift.plans.panel import campaign_panel

CANDIDATE = "id string, event_control_flag string, cluster int, score double"
WEEKS = "id string, w1 double, w2 double, w3 double"


def planted(spark, twins=60, seed=3):
    """Every test customer has a control twin; total spend is much alike for all, weeks are not."""
    chance = random.Random(seed)
    people, weeks = [], []
    for i in range(twins):
        spend = [chance.uniform(0, 100) for _ in range(2)]
        spend.append(200 - sum(spend) + chance.uniform(-1, 1))
        for flag in "NY":
            name = f"{flag}{i}"
            people.append((name, flag, 0, sum(spend)))
            weeks.append((name, *[x + chance.uniform(-0.5, 0.5) for x in spend]))
    return spark.createDataFrame(people, CANDIDATE), spark.createDataFrame(weeks, WEEKS)


def test_pairs_are_nearer_than_by_total_spend(spark):
    people, weeks = planted(spark)
    described = fm.with_features(people, weeks)
    pairs = fm.feature_match(described).collect()
    assert len(pairs) == len({p.test_id for p in pairs}) == len({p.control_id for p in pairs}) == 60
    features = {r.id: r.features for r in described.collect()}
    distance = lambda p: math.dist(features[p.test_id], features[p.control_id])
    assert all(math.isclose(p.distance, distance(p), abs_tol=1e-9) for p in pairs)
    by_total = matching.one_to_one_match(people.withColumn("score", people.score.cast("bigint"))).collect()
    mean = lambda found: sum(map(distance, found)) / len(found)
    assert mean(pairs) < 0.3 * mean(by_total)
    assert sum(p.test_id[1:] == p.control_id[1:] for p in pairs) > 50


def test_equal_customers_small_blocks_and_lone_arms(spark, monkeypatch):
    monkeypatch.setattr(fm, "BLOCK", 8)
    rows = [(f"a{i}", "Y" if i % 3 == 0 else "N", 0, 1.0) for i in range(60)]   # all alike
    rows += [("lone", "N", 1, 1.0)]                                              # a cluster with one arm
    rows += [("both", "N", 0, 1.0), ("both", "Y", 0, 1.0)]                       # in both arms
    rows += [("a1", "N", 0, 1.0), (None, "N", 0, 1.0), ("x", None, 0, 1.0), ("y", "Y", None, 1.0)]
    people = spark.createDataFrame(rows, CANDIDATE)
    weeks = spark.createDataFrame([("a0", None, float("nan"), 7.0), ("a1", 0.0, 0.0, 7.0)], WEEKS)
    described = fm.with_features(people, weeks)
    assert described.count() == 61
    pairs = fm.feature_match(described, rounds=2).collect()
    assert len({p.control_id for p in pairs}) == len({p.test_id for p in pairs}) == len(pairs) == 20
    assert all(p.control_id != "both" and p.test_id != "both" for p in pairs)


def test_no_candidates(spark):
    empty = fm.with_features(spark.createDataFrame([], CANDIDATE), spark.createDataFrame([], WEEKS))
    assert fm.feature_match(empty).count() == 0
    assert fm.bounded_clusters(empty, 5).count() == 0


def test_clusters_are_halved_to_the_bound(spark):
    people, weeks = planted(spark)
    described = fm.with_features(people, weeks)
    parts = fm.bounded_clusters(described, 20)
    costs = fm.cluster_cost(parts, ["cluster", "part"]).collect()
    assert [c.customers for c in costs] == [15] * 8
    assert {c.part for c in costs} == set(range(8, 16))
    # Three features with deviation 1 over 120 customers cost 360 in one cluster.
    (whole,) = fm.cluster_cost(described, ["cluster"]).collect()
    assert math.isclose(whole.cost, 360, rel_tol=1e-9)
    assert sum(c.cost for c in costs) < 0.4 * whole.cost
    with pytest.raises(ValueError, match="room for one customer"):
        fm.bounded_clusters(described, 0)


@pytest.mark.parametrize("how", ["features", "systematic"])
def test_panel_from_prepared_frames(spark, how):
    from testbed import tables as T

    frames = T.frames(spark, "/root/testdata/sf0.001")
    panel = campaign_panel(frames, T.PRE_WEEKS, how, clusters=3, most=30, threshold=2).collect()
    flags = [r.event_control_flag for r in panel]
    assert flags.count(0) == flags.count(1) > 0
    assert len({r.id for r in panel}) == len(panel)
    with pytest.raises(ValueError, match="unknown panel"):
        campaign_panel(frames, T.PRE_WEEKS, "nothing")


def test_features_and_distances_are_worked_out_once(spark):
    rows = [(f"a{i}", "Y" if i % 2 else "N", i % 3, 1.0) for i in range(200)]
    weeks = [(f"a{i}", 0.1, 7.3 * (i % 11), None) for i in range(150)] + [(f"a{i}", 0.1, 0.7, None) for i in range(150, 200)]
    described = fm.with_features(
        spark.createDataFrame(rows, CANDIDATE).repartition(7), spark.createDataFrame(weeks, WEEKS))
    # The features are read back, not made again by every reader.
    assert "Aggregate" not in described._jdf.queryExecution().optimizedPlan().toString()
    found = [r.features for r in described.collect()]
    # A feature that is the same for all is exactly 0, in whichever tasks its rows are.
    assert {(f[0], f[2]) for f in found} == {(0.0, 0.0)}
    second = [f[1] for f in found]
    assert math.isclose(sum(second), 0, abs_tol=1e-9) and math.isclose(sum(x * x for x in second), 200, rel_tol=1e-9)
    customers = fm.stage(fm._on_lines(described, 1, 1), fm.shared_folder(spark))
    best = fm._mutual(fm._with_distance(fm._offers(customers, 1, 0), customers))
    # The distances are in the plan once, for both sides.
    assert best._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert best.count() == len({r.test_id for r in best.collect()}) > 0


def test_places_are_sums_in_the_order_of_the_features(spark):
    features = [[0.1 * i + j / 3 for j in range(6)] for i in range(20)]
    described = spark.createDataFrame(
        [(1, f"c{i}", "NY"[i % 2], f) for i, f in enumerate(features)],
        "cluster int, id string, event_control_flag string, features array<double>")
    chance = random.Random(5)
    lines = [line for _ in range(3) for line in fm._lines(chance, 6)]
    for row in fm._on_lines(described, 2, 5).collect():
        sums = []
        for line in lines:
            total = 0.0
            for x, weight in zip(features[int(row.id[1:])], line):
                total += x * weight
            sums.append(total)
        assert row.places == [math.floor(abs(1000 * x) + 0.5) * (1 if x >= 0 else -1) for x in sums]
