"""Measures on small hand-written campaigns, against brute force."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from promolift.functions.columns import panel_arm
from promolift.operators import enrich, facts, matching
from promolift.operators.modules import CampaignFrames
from promolift.operators.uplift import uplift_report
from promolift.plans.prepare import stage_frames
from promolift.plans.reports import MODULES, combined_report, final_report, module_report
from testbed import tables as T

BASE = (
    "id string, contact_stage_code string, offer_code string, prod_code string, channel_code string,"
    " event_control_flag string, loyalty_level string, offer_discount_amt double, offer_amount double,"
    " contact_cust_detail_dttm timestamp"
)
DAY = dt.datetime(2000, 5, 1, 12)


def row(id, stage, offer="O1", prod="P1", channel="EMAIL", flag="N", loyalty="PR", value=1.0, cost=2.0):
    return (id, stage, offer, prod, channel, flag, loyalty, value, cost, DAY)


def items(spark, rows):
    """(id, product, transaction, period) lines."""
    df = spark.createDataFrame(rows, "id string, prod_code string, transaction_fid string, period string")
    return df.select(
        "id", "prod_code", "transaction_fid", F.lit(10).alias("spend"),
        F.lit(DAY).alias("transaction_dttm"),
        *[(F.col("period") == p).alias(f"in_{p}") for p in ("pre", "dur", "post")],
    )


def frames(spark, base, lines=(), offers=(("O1", "P1"),), products=(("P1", "C1"),)):
    return CampaignFrames(
        base=spark.createDataFrame(base, BASE),
        offer_product=spark.createDataFrame(list(offers), "offer_code string, prod_code string"),
        items=items(spark, list(lines)) if lines else None,
        products=spark.createDataFrame(list(products), "prod_code string, prod_hier_l20_code string"),
    )


def overall(df):
    (found,) = [r for r in df.collect() if r.grouping_level == "overall"]
    return found


def test_unknown_names_are_refused(spark):
    f = frames(spark, [row("1", "ALC")])
    with pytest.raises(ValueError, match="repetors.*valid names"):
        module_report("customer_impact", f, ["()"], ["repetors"])
    with pytest.raises(ValueError, match="unknown module"):
        module_report("nothing", f, ["()"])
    with pytest.raises(ValueError, match="valid names"):
        uplift_report(f, ["()"], ["nothing"])


def test_a_coupon_unexposed_and_repeated_counts_twice(spark):
    base = [
        row("1", "RDM"), row("1", "RDM"),                  # repeated and unexposed
        row("2", "EXP"), row("2", "RDM"),                  # fine
        row("3", "EXP", None), row("3", "RDM", None),      # exposed to the same NULL offer
        row("4", "RDM", None),                             # unexposed NULL offer
        row(None, "RDM"), row("", "RDM"), row("null", "RDM"), row("null", "RDM"),
    ]
    names = ["bad_redeemers", "mal_redemptions", "non_cc_malredemptions"]
    found = overall(module_report("fraud", frames(spark, base), ["loyalty_level"], names))
    assert (found.bad_redeemers, found.mal_redemptions, found.non_cc_malredemptions) == (2, 3, 4)


def test_a_customer_in_both_arms_has_every_redemption_twice(spark):
    base = [row("1", "ALC", flag="Y"), row("1", "ALC", flag="N"), row("1", "RDM"), row("1", "EXP")]
    names = ["control_redeemers", "bad_redeemers", "mis_redemptions"]
    found = overall(module_report("fraud", frames(spark, base, offers=[("O2", "P1")]), ["()"], names))
    assert (found.control_redeemers, found.bad_redeemers, found.mis_redemptions) == (1, 1, 2)


def test_mis_redemptions_count_unknown_customers_but_not_unknown_offers(spark):
    base = [row(None, "RDM", "O1", "P9"), row("1", "RDM", "O1", "P9"), row("1", "RDM", None, "P9")]
    found = overall(module_report("fraud", frames(spark, base), ["()"], ["mis_redemptions"]))
    assert found.mis_redemptions == 2


def test_costs_need_both_kinds_in_a_group(spark):
    base = [
        row("1", "RDM", loyalty="A", value=5.0), row("1", "DLV", loyalty="A", channel="PAPER"),
        row("2", "RDM", loyalty="B", value=7.0), row("3", "DLV", loyalty="C", channel=None),
    ]
    report = module_report("cost", frames(spark, base), ["()", "loyalty_level"]).collect()
    cost = {(r.loyalty_level, r.grouping_level): (r.redemption_cost, r.campaign_cost) for r in report}
    assert cost == {
        ("total", "overall"): (12.0, 14.0), ("A", "loyalty_level"): (5.0, 7.0),
        ("B", "loyalty_level"): (7.0, 0.0),
    }


def test_shared_transactions_count_once_per_group(spark):
    base = [row("1", "EXP", loyalty="A"), row("2", "EXP", loyalty="A"), row("3", "EXP", loyalty="B")]
    lines = [
        ("1", "P1", "t1", "dur"), ("2", "P1", "t1", "dur"), ("3", "P1", "t1", "dur"),
        ("1", "P1", "t2", "dur"), ("1", "P2", "t2", "dur"), ("2", "P1", None, "dur"),
        ("9", "P1", "t3", "dur"), ("3", "P1", "t4", "pre"),
    ]
    name = "dur_average_frequency_of_purchase"
    report = module_report(
        "customer_impact", frames(spark, base, lines), ["()", "loyalty_level"], [name]
    ).collect()
    found = {r.loyalty_level: r[name] for r in report}
    assert found == {"total": pytest.approx(2 / 3), "A": pytest.approx(2 / 3), "B": pytest.approx(1 / 3)}


@pytest.mark.parametrize("wide", [False, True])
def test_impact_equals_brute_force(spark, wide):
    """Also with an offer on every product and a product in hundreds of offers."""
    rng = random.Random(3)
    ids, prods, offers = [str(i) for i in range(12)], [f"P{i}" for i in range(6)], ["O1", "O2", "O3"]
    exposures = [row(rng.choice(ids), "EXP", rng.choice(offers)) for _ in range(40)]
    listed = [(o, p) for o, p in itertools.product(offers, prods) if rng.random() < 0.5 or p == "P0"]
    if wide:
        listed = sorted({*listed, *(("O1", p) for p in prods), *((f"W{i}", "P0") for i in range(300))})
    category = {p: f"C{i % 3}" for i, p in enumerate(prods)}
    lines = [
        (rng.choice(ids), rng.choice(prods), f"t{i}", rng.choice(["pre", "dur", "post"]))
        for i in range(90)
    ]
    found = overall(module_report(
        "customer_impact",
        frames(spark, exposures, lines, listed, category.items()),
        ["()"],
        ["trialist", "repeaters", "adopters", "lapsed_buyers", "retained_hhs",
         "buy_in_category_but_not_product"],
    ))

    n = lambda i, p, period: sum(l[0] == i and l[1] == p and l[3] == period for l in lines)
    bought = lambda i, c, period: any(n(i, p, period) for p in prods if category[p] == c)
    matched = [(e[0], p) for e in exposures for o, p in listed if o == e[2]]
    ids_where = lambda test: len({i for i, p in matched if test(i, p)})
    assert found.trialist == ids_where(lambda i, p: n(i, p, "dur") and not n(i, p, "post"))
    assert found.repeaters == ids_where(lambda i, p: n(i, p, "dur") and n(i, p, "post") == 1)
    assert found.adopters == ids_where(lambda i, p: n(i, p, "dur") and n(i, p, "post") > 1)
    assert found.lapsed_buyers == ids_where(lambda i, p: n(i, p, "pre") and not n(i, p, "post"))
    assert found.retained_hhs == ids_where(lambda i, p: n(i, p, "pre") and n(i, p, "post"))
    assert found.buy_in_category_but_not_product == sum(
        bought(i, category[p], "pre") and bought(i, category[p], "post")
        and not n(i, p, "pre") and not n(i, p, "post")
        for i, p in matched
    )


def test_empty_control_group_gives_zero(spark):
    f = frames(spark, [row("1", "ALC")], [("1", "P1", "t1", "dur")])
    report = module_report("fraud", f, ["()", "loyalty_level"], ["control_participation"]).collect()
    assert [(r.grouping_level, r.control_participation) for r in report] == [("overall", 0)]


def test_offer_terms_keep_the_first_supplier_with_its_own_terms(spark):
    offers = spark.createDataFrame(
        [("O1", "Z", 9.0, 9.0), ("O1", "A", 1.0, 5.0), ("O1", "A", 3.0, 2.0), ("O1", None, 8.0, 8.0),
         ("O2", None, 4.0, 4.0), (" ", "A", 1.0, 1.0), (None, "A", 1.0, 1.0)],
        "offer_code string, supplier_name string, offer_discount_amt double, offer_amount double",
    )
    assert sorted(enrich.offer_terms(offers).collect()) == [("O1", "A", 3.0, 5.0), ("O2", None, 4.0, 4.0)]


def test_profile_equals_left_joins_also_with_repeated_ids(spark):
    detail = spark.createDataFrame([("1", 1), ("2", 2), ("3", 3), (None, 4)], "id string, n int")
    a = spark.createDataFrame([("1", "x"), ("1", "y"), (None, "z")], "id string, a string")
    b = spark.createDataFrame([("1", "p"), ("1", "q"), ("2", "r"), ("7", "s")], "id string, b string")
    plain = detail.join(a, "id", "left").join(b, "id", "left")
    found = enrich.attach_profile(detail, enrich.customer_profile(a, b))
    assert sorted(found.collect(), key=str) == sorted(plain.collect(), key=str)


def test_customer_outcomes_count_lines_spend_and_visits(spark):
    lines = items(spark, [
        ("1", "P1", "t1", "pre"), ("1", "P2", "t1", "pre"), ("1", "P1", "t2", "dur"),
        ("1", "P1", None, "dur"), ("2", "P1", "t3", "post"),
    ])
    (found,) = facts.customer_outcomes(lines, "item").collect()
    assert found.asDict() == {
        "id": "1", "pre_units": 2, "pre_spend": 20, "pre_visits": 1,
        "post_units": 2, "post_spend": 20, "post_visits": 1,
    }


def test_resampling_evens_the_arms_and_drops_small_clusters(spark):
    rows = [(str(i), "Y" if i % 4 == 0 else "N", i * 3, 0) for i in range(100)]
    rows += [(f"s{i}", "Y" if i < 2 else "N", i, 1) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, event_control_flag string, score bigint, cluster int")
    kept = matching.systematic_resample(df, threshold=10).collect()
    assert {r.cluster for r in kept} == {0}
    assert sum(r.test_panel == 1 for r in kept) == sum(r.test_panel == 0 for r in kept) == 25
    scores = sorted(r.score for r in kept if r.test_panel == 1)
    assert all(6 <= b - a <= 18 for a, b in zip(scores, scores[1:]))  # evenly spread

    pairs = matching.one_to_one_match(df).collect()
    assert len(pairs) == 25 + 2
    assert len({p.test_id for p in pairs}) == len({p.control_id for p in pairs}) == 27
    # Both arms are used over their whole range, so their scores are alike.
    large = [p for p in pairs if p.cluster == 0]
    gap = sum(p.test_score - p.control_score for p in large) / len(large)
    assert abs(gap) < 12 and max(p.test_score for p in large) > 280
    (small,) = matching.left_out(df, threshold=10).collect()
    assert (small.cluster, small.customers) == (1, 30)


@pytest.mark.parametrize("how", ["systematic", "one_to_one", "external"])
def test_built_panels_feed_uplift(spark, how):
    rows = [(str(i), "Y" if i % 3 == 0 else "N", i, 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, event_control_flag string, score bigint, cluster int")
    panel = matching.build_panel(df, how, external=df)
    flags = [r.event_control_flag for r in panel.collect()]
    assert flags.count(0) == 20 and flags.count(1) == (40 if how == "external" else 20)
    outcomes = spark.createDataFrame([("1", 5)], "id string, pre_units int")
    assert facts.uplift_panel(panel, outcomes).count() == len(flags)
    with pytest.raises(ValueError, match="unknown panel"):
        matching.build_panel(df, "nothing")


def test_panel_flags(spark):
    df = spark.createDataFrame([("Y",), ("n",), (" 0",), ("1",), (None,)], "flag string")
    assert [r[0] for r in df.select(panel_arm("flag")).collect()] == [0, 1, 0, 1, None]
    with pytest.raises(Exception, match="panel flag must be"):
        spark.createDataFrame([("maybe",)], "flag string").select(panel_arm("flag")).collect()


def test_control_redeemers_alone_do_not_read_exposures(spark):
    f = frames(spark, [row("1", "ALC", flag="Y"), row("1", "RDM")])
    plan = lambda name: module_report("fraud", f, ["()"], [name])._jdf.queryExecution().optimizedPlan().toString()
    assert "EXP" not in plan("control_redeemers") and "EXP" in plan("bad_redeemers")


def test_most_redemptions_on_one_unknown_id(spark):
    base = [row(None, "RDM")] * 300 + [row("null", "RDM")] * 50 + [row("1", "RDM"), row("1", "RDM", channel="PAPER")]
    names = ["bad_redeemers", "mal_redemptions", "non_cc_malredemptions", "app_multi_redeemers"]
    found = overall(module_report("fraud", frames(spark, base), ["()"], names))
    assert (found.bad_redeemers, found.mal_redemptions, found.non_cc_malredemptions) == (1, 2, 350)


def test_final_report_aligns_keys_and_fills_zeros(spark):
    one = spark.createDataFrame([("a", "k", 1), ("total", "overall", 3)], "k string, grouping_level string, m bigint")
    two = spark.createDataFrame([("b", "l", 2.5), ("total", "overall", 4.5)], "l string, grouping_level string, n double")
    found = {tuple(r) for r in final_report({"one": one, "two": two}).collect()}
    assert found == {
        ("a", "total", "k", 1, 0.0), ("total", "b", "l", 0, 2.5), ("total", "total", "overall", 3, 4.5),
    }
    with pytest.raises(ValueError, match="more than one report"):
        final_report([one, one])


def test_every_measure_has_a_module():
    assert set(MODULES) == {"allocation", "cost", "customer_impact", "fraud", "redemption"}


def brute_outcomes(purchases, pairs, listed):
    """Flags per exposed coupon: tried, repeated, adopted, lapsed, retained."""
    of_offer = {}
    for offer, product in listed:
        of_offer.setdefault(offer, set()).add(product)
    counts = {(i, p): n for i, p, *n in purchases}
    found = {}
    for i, offer in pairs:
        flags = [False] * 5
        for product in of_offer.get(offer, ()):
            pre, dur, post = counts.get((i, product), (0, 0, 0))
            hits = (dur and not post, dur and post == 1, dur and post > 1, pre and not post, pre and post)
            flags = [bool(a or b) for a, b in zip(flags, hits)]
        found[i, offer] = flags
    return found


@pytest.mark.parametrize("longest", [2, 256])
def test_outcomes_equal_brute_force_for_short_and_long_offers(spark, monkeypatch, longest):
    monkeypatch.setattr(facts, "LONGEST_LIST", longest)
    rng = random.Random(3)
    purchases = [(f"c{i}", f"P{p}", *(rng.choice((0, 0, 1, 2)) for _ in range(3)))
                 for i in range(12) for p in rng.sample(range(30), 9)]
    pairs = [(f"c{i}", f"O{o}") for i in range(14) for o in rng.sample(range(8), 4)]
    listed = [(f"O{o}", f"P{p}") for o in range(7) for p in rng.sample(range(30), (1, 2, 3, 9, 20, 2, 5)[o])]
    found = facts.coupon_outcomes(
        spark.createDataFrame(purchases, "id string, prod_code string, n_pre long, n_dur long, n_post long"),
        spark.createDataFrame(pairs, "id string, offer_code string"),
        spark.createDataFrame(listed + listed[:3], "offer_code string, prod_code string")).collect()
    names = ("tried", "repeated", "adopted", "lapsed", "retained")
    ours = {(r.id, r.offer_code): [r[n] for n in names] for r in found}
    for key, flags in brute_outcomes(purchases, pairs, listed).items():
        assert ours.get(key, [False] * 5) == flags
    assert len(ours) == len(found)


def test_a_customer_with_many_products_and_many_offers_makes_no_pair_list(spark):
    """10,000 products and 1,000 offers: rows before the customer's own row are purchases and exposures."""
    products = spark.range(10_000).select(F.concat(F.lit("P"), "id").alias("prod_code"))
    purchases = products.select(
        F.lit("c").alias("id"), "prod_code", F.lit(1).alias("n_pre"), F.lit(1).alias("n_dur"), F.lit(2).alias("n_post"))
    offers = spark.range(1_000).select(F.concat(F.lit("O"), "id").alias("offer_code"), F.col("id").alias("n"))
    # Offers of 11 products; every hundredth lists 1,000.
    listed = offers.select("offer_code", F.explode(F.expr(
        "transform(sequence(0, if(n % 100 = 0, 999, 10)), i -> concat('P', (n * 7 + i) % 20000))")).alias("prod_code"))
    pairs = offers.select(F.lit("c").alias("id"), "offer_code")
    found = facts.coupon_outcomes(purchases, pairs, listed)
    rows = {r.offer_code: (r.adopted, r.lapsed, r.retained) for r in found.collect()}
    assert len(rows) == 1_000 and set(rows.values()) == {(True, False, True)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # A customer's lists are made once, below the explode of its exposures, and no join follows it.
    above = plan[:plan.index("Generate explode")]
    assert "filter(bought" not in above and "Join" not in above


def test_transactions_are_read_from_facts_and_the_report_has_few_exchanges(spark, tmp_path):
    base = [row("1", "EXP"), row("1", "ALC"), row("1", "RDM"), row("2", "EXP"), row("2", "ALC")]
    lines = [("1", "P1", "t1", "dur"), ("2", "P1", "t1", "dur"), ("1", "P1", "t2", "pre"), ("2", "P1", "t3", "post")]
    staged = stage_frames(frames(spark, base, lines), str(tmp_path / "staged"))
    before = {key: spark.conf.get(key) for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = {name: module_report(name, staged, ["()", "loyalty_level"])._jdf.queryExecution().executedPlan().toString()
                for name in ("customer_impact", "fraud")}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert text["customer_impact"].count(" Exchange ") <= 40
    assert text["fraud"].count(" Exchange ") <= 20


def test_combined_report_equals_the_module_reports(spark):
    base = [
        row("1", "EXP"), row("1", "ALC", flag="Y"), row("1", "RDM"), row("1", "RDM", channel="PAPER"),
        row("2", "EXP", loyalty="GO"), row("2", "ALC", loyalty="GO"), row("3", "DLV", channel="PAPER"),
        row("2", "RDM", "O2", "P9", loyalty="GO"), row(None, "RDM"), row("4", "EXP", None), row("4", "RDM", None),
    ]
    lines = [("1", "P1", "t1", "dur"), ("2", "P1", "t1", "dur"), ("1", "P1", "t2", "pre"), ("2", "P1", "t3", "post")]
    f = frames(spark, base, lines)
    modules = [name for name in MODULES if name != "redemption"]
    levels = ["()", "loyalty_level", "(loyalty_level, offer_code)"]
    one = combined_report(f, levels, modules)
    several = final_report([module_report(name, f, levels) for name in modules])
    order = several.columns
    assert sorted(map(str, one.select(*order).collect())) == sorted(map(str, several.collect()))


def test_written_passes_equal_one_plan(spark, tmp_path):
    levels, modules = ["()", "loyalty_level"], ["redemption", "fraud", "customer_impact"]
    f = T.frames(spark, "/root/testdata/sf0.001", detail=str(tmp_path / "detail"))
    lazy = combined_report(T.frames(spark, "/root/testdata/sf0.001"), levels, modules)
    written = combined_report(f, levels, modules, folder=str(tmp_path / "passes"))
    # The groups are there before the report is read.
    assert len(list((tmp_path / "passes").iterdir())) > 3
    rows = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert written.columns == lazy.columns and rows(written) == rows(lazy)
