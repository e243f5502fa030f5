"""Every registered query: the Spark callable and, next to it, its plain SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolift.functions import levels as L
from promolift.operators import aggregates as G
from promolift.operators import enrich as E
from promolift.operators import facts, feature_matching, matching
from promolift.operators.uplift import uplift_report, uplift_statistics
from promolift.operators.rollup import report
from promolift.plans.prepare import stage_frames
from promolift.plans.reports import combined_report, final_report, module_report
from promolift.sources import sinks, tables, text
from testbed import oracle as O
from testbed import tables as T
from testbed.oracle import joined, leveled, num, one_row, ratio, statement

Query = Callable[[SparkSession, str], DataFrame]

LEVELS = [
    (),
    ("channel_code", "loyalty_level"),
    ("slot_segment", "pricesense_code", "loyalty_level"),
    ("age", "lifestyle_level"),
]
KEYS = L.key_columns(LEVELS)
CATEGORY_LEVELS = [*LEVELS, ("prod_hier_l20_code", "supplier_name")]
UPLIFT_LEVELS = [(), ("loyalty_level",), ("pricesense_code", "lifestyle_level")]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles as both engines print them; the small shift keeps halves off the edge."""
    shift = 10.0 ** -(digits + 3)
    return df.select(*[
        (F.round(F.col(name) + shift, digits) + 0.0).alias(name) if kind == "double" else F.col(name)
        for name, kind in df.dtypes
    ])


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = statement(sql)


def on_raw(table: str, build: Callable[[DataFrame], DataFrame], digits: int = 4) -> Query:
    return lambda spark, folder: rounded(build(T.raw_tables(spark, folder)[table]), digits)


def on_base(build: Callable[[DataFrame], DataFrame], digits: int = 4) -> Query:
    return lambda spark, folder: rounded(build(T.frames(spark, folder).base), digits)


# --- sources ------------------------------------------------------------------

def _table_projection(spark: SparkSession, folder: str) -> DataFrame:
    view = "promolift_customer"
    spark.read.parquet(f"{folder}/customer.parquet").createOrReplaceTempView(view)
    return tables.read_table(
        spark, view, {"c_custkey": "customer_key", "c_mktsegment": "segment"}
    )


add("src_table_projection", _table_projection,
    "select c_custkey as customer_key, c_mktsegment as segment from customer")
add("src_event_scope",
    on_raw("contact_detail", lambda d: tables.event_scope(d, "EV1,EV3").withColumn(
        "contact_cust_detail_dttm", F.to_date("contact_cust_detail_dttm"))),
    """select * exclude (event_code, contact_cust_detail_dttm, offer_discount_amt),
    round(offer_discount_amt + 1e-7, 4) + 0.0 as offer_discount_amt,
    cast(contact_cust_detail_dttm as date) as contact_cust_detail_dttm
    from detail where event_code in ('EV1', 'EV3')""")
add("src_segment_snapshot",
    on_raw("seg_loyalty", lambda d: tables.segment_snapshot(d, T.SEG_WEEK)),
    "select id, loyalty_level from seg_loyalty where seg_week = '199926'")


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("transaction_day", F.to_date("transaction_dttm")).drop("transaction_dttm")


def _per_period(read_one: Callable, table: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        raw = T.raw_tables(spark, folder)
        parts = [
            _dated(read_one(raw[table], period, raw["calendar"])).withColumn("period", F.lit(name))
            for name, period in T.CAMPAIGN.periods.items()
        ]
        return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return run


PERIOD_SQL = [("pre", "199801", "199953"), ("dur", "200001", "200053"), ("post", "200101", "200153")]


def _period_sql(table: str) -> str:
    return " union all ".join(
        f"select *, '{name}' as period from {table} where fis_week_id between '{a}' and '{b}'"
        for name, a, b in PERIOD_SQL
    )


add("src_items_period", _per_period(tables.items_in, "items"), _period_sql("items"))
add("src_baskets_period", _per_period(tables.baskets_in, "baskets"), _period_sql("baskets"))


def _dirty(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose spend is text, some of it no number: they keep their line without spend."""
    raw = T.raw_tables(spark, folder)
    items = raw["items"].withColumn("net_spend_amt", F.expr(
        "if(transaction_code like '%7', 'n/a', string(net_spend_amt))"))
    return _dated(tables.items_in(items, T.CAMPAIGN.during))


add("src_items_dirty", _dirty,
    """select * replace (case when transaction_fid like '%7' then null else spend end as spend)
    from items_dur""")


def _last_weeks(spark: SparkSession, folder: str) -> DataFrame:
    raw = T.raw_tables(spark, folder)
    return _dated(tables.items_in(raw["items"], tables.Period(end="199953", weeks=8), raw["calendar"]))


add("src_items_last_weeks", _last_weeks,
    """select * from items where fis_week_id between (select min(fis_week_id) from
    (select distinct fis_week_id from calendar where fis_week_id <= '199953'
     order by 1 desc limit 8)) and '199953'""")
add("src_card_dim", on_raw("cards", tables.card_dim), "select * from cards")
add("src_living_members", on_raw("members", tables.living_members),
    """select concat('0', member_id) as mem_id, deceased_date from members
    where deceased_date = '00000000' or deceased_date is null""")


def _dims(spark: SparkSession, folder: str) -> DataFrame:
    raw = T.raw_tables(spark, folder)
    frames = [
        tables.product_dim(raw["products"]).select(
            F.lit("product").alias("dim"), F.col("prod_code").alias("code"),
            F.col("prod_hier_l20_code").alias("parent"), F.col("prod_desc").alias("label")),
        tables.store_dim(raw["stores"]).select(
            F.lit("store"), "store_code", F.lit(None).cast("string"), "banner_name"),
        tables.calendar_dim(raw["calendar"]).select(
            F.lit("day"), F.col("date").cast("string"), "fis_week_id", "fis_day_of_week_num"),
    ]
    return frames[0].union(frames[1]).union(frames[2])


add("src_dims", _dims,
    """select 'product' as dim, prod_code as code, prod_hier_l20_code as parent, prod_desc as label
    from products union all select 'store', store_code, null, banner_name from stores
    union all select 'day', cast(date as varchar), fis_week_id, fis_day_of_week_num from calendar""")


def _panel(spark: SparkSession, folder: str) -> DataFrame:
    path = sinks.shared_folder(spark)
    T.raw_tables(spark, folder)["panel"].write.parquet(path)
    return tables.read_panel(spark, path)


add("src_panel", _panel, "select id, event_control_flag from panel")


def _text_source(columns: tuple[str, ...], separator: str, read: Callable) -> Query:
    """Spark writes the customers as text lines, then the source reads them."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = sinks.shared_folder(spark)
        customers = spark.read.parquet(f"{folder}/customer.parquet")
        customers.select(
            F.concat_ws(separator, *[F.expr(f"string({column})") for column in columns])
        ).write.text(path)
        return read(spark, path)
    return run


add("src_delimited_text",
    _text_source(
        ("c_name", "if(c_custkey % 3 = 0, '', c_mktsegment)", "c_nationkey"), "|",
        lambda s, path: text.read_delimited(s, path, "|", ["name", "segment", "nation"]),
    ),
    """select c_name as name, case when c_custkey % 3 = 0 then '' else c_mktsegment end as segment,
    cast(c_nationkey as varchar) as nation from customer""")
add("src_app_customers",
    _text_source(
        ("c_custkey * 37 + 100000", "concat('1999', lpad(c_nationkey, 4, '0'))",
                      "concat('2000', lpad(c_nationkey, 4, '0'))"), ";",
        text.read_app_customers,
    ),
    f"""select {O.card('c_custkey')} as id,
    concat('1999', lpad(cast(c_nationkey as varchar), 4, '0')) as first_login,
    concat('2000', lpad(cast(c_nationkey as varchar), 4, '0')) as last_login from customer""")
add("src_resample_panel",
    _text_source(
        ("concat('0', c_custkey * 37 + 100000)", "if(c_custkey % 5 = 0, 'Y', 'N')"), ",",
        text.read_resample_panel,
    ),
    f"""select {O.card('c_custkey')} as id,
    case when c_custkey % 5 = 0 then 'Y' else 'N' end as event_control_flag from customer""")


# --- levelled aggregates ------------------------------------------------------

DISC = "offer_discount_amt"
add("agg_sum", on_base(lambda b: G.level_sum(b, LEVELS, "m", DISC)),
    leveled("base", LEVELS, {"m": num(f"sum({DISC})")}))
add("agg_count", on_base(lambda b: G.level_count(b, LEVELS, "m", "loyalty_level")),
    leveled("base", LEVELS, {"m": "count(loyalty_level)"}))
add("agg_distinct_count", on_base(lambda b: G.level_distinct_count(b, LEVELS, "m", "id")),
    leveled("base", LEVELS, {"m": "count(distinct id)"}))
add("agg_average", on_base(lambda b: G.level_average(b, LEVELS, "m", DISC, "lifestyle_level")),
    leveled("base", LEVELS, {"m": num(ratio(f"sum({DISC})", "count(lifestyle_level)"))}))
add("agg_distinct_average", on_base(lambda b: G.level_distinct_average(b, LEVELS, "m", DISC, "id")),
    leveled("base", LEVELS, {"m": num(ratio(f"sum({DISC})", "count(distinct id)"))}))


def _over_rows(function: Callable, column: str) -> Query:
    return on_base(lambda b: function(b, LEVELS, "m", column, b.agg(F.count("*").alias("n"))), 8)


ALL_ROWS = "(select count(*) from base)"
add("agg_distinct_count_average", _over_rows(G.level_distinct_count_average, "id"),
    leveled("base", LEVELS, {"m": num(ratio("count(distinct id)", ALL_ROWS), 8)}))
add("agg_count_average", _over_rows(G.level_count_average, "loyalty_level"),
    leveled("base", LEVELS, {"m": num(ratio("count(loyalty_level)", ALL_ROWS), 8)}))
add("agg_percentage", _over_rows(G.level_percentage, "id"),
    leveled("base", LEVELS, {"m": num(ratio("count(distinct id) * 100", ALL_ROWS), 8)}))


def _literal_labels(base: DataFrame) -> DataFrame:
    """Keys that hold NULL next to the texts used as labels."""
    return base.select(
        "id",
        F.when(F.col("loyalty_level") == "GO", "XX").when(F.col("loyalty_level") == "LP", "total")
        .otherwise(F.col("loyalty_level")).alias("k1"),
        (F.length("id") + F.lit(0)).alias("k2"),
    )


LABEL_LEVELS = ["()", "(k1)", "(k2, k1)", "k2"]
add("agg_null_and_total_labels",
    on_base(lambda b: G.level_distinct_count(_literal_labels(b), LABEL_LEVELS, "m", "id")),
    leveled("""(select id, case loyalty_level when 'GO' then 'XX' when 'LP' then 'total'
      else loyalty_level end as k1, length(id) as k2 from base)""",
            LABEL_LEVELS, {"m": "count(distinct id)"}))
add("agg_empty_overall",
    on_base(lambda b: G.level_sum(b.filter("contact_stage_code = 'NONE'"), LEVELS, "m", DISC)),
    leveled("(select * from base where contact_stage_code = 'NONE')", LEVELS,
            {"m": num(f"sum({DISC})")}))
add("agg_scalar_row",
    on_base(lambda b: report([G.scalar_row("m", (G._all_rows(b, "id").ids(),))], LEVELS[1:])),
    one_row(L.key_columns(LEVELS[1:]), "m", "(select count(distinct id) from base)"))


# --- enrichment ---------------------------------------------------------------

def _no_time(df: DataFrame) -> DataFrame:
    """Timestamps as dates, so that both engines print them alike."""
    name = "contact_cust_detail_dttm"
    return df.withColumn(name, F.to_date(name)) if name in df.columns else df


def _enriched(build: Callable[[dict], DataFrame]) -> Query:
    return lambda spark, folder: rounded(_no_time(build(T.raw_tables(spark, folder))))


def _scoped(raw: dict, name: str) -> DataFrame:
    return tables.event_scope(raw[name], T.EVENT_CODES)


def _headed(raw: dict) -> DataFrame:
    profile = E.customer_profile(E.header_attributes(_scoped(raw, "contact_header")))
    return E.attach_profile(_scoped(raw, "contact_detail"), profile)


def _segmented(raw: dict) -> DataFrame:
    profile = E.customer_profile(*E.known_segments(*[
        tables.segment_snapshot(raw[name], T.SEG_WEEK)
        for name in ("seg_lifestyle", "seg_loyalty", "seg_pricesense")
    ]))
    return E.attach_profile(_scoped(raw, "contact_detail").select("id", "offer_code"), profile)


def _aged(raw: dict) -> DataFrame:
    calendar = tables.calendar_dim(raw["calendar"])
    cards = E.with_age(tables.card_dim(raw["cards"]), E.targeting_date(calendar, T.SEG_WEEK))
    return E.attach_profile(_scoped(raw, "contact_detail").select("id", "offer_code"), cards)


PLAIN = "cast(contact_cust_detail_dttm as date) as contact_cust_detail_dttm"
MONEY = "round(offer_discount_amt + 1e-7, 4) + 0.0 as offer_discount_amt"
SWAP = f"* exclude (contact_cust_detail_dttm, offer_discount_amt), {PLAIN}, {MONEY}"
add("enrich_header", _enriched(_headed), f"select {SWAP} from headed")
add("enrich_slot_segment", _enriched(lambda raw: E.with_slot_segment(_headed(raw))),
    f"select {SWAP} from slotted")
add("enrich_segments", _enriched(_segmented),
    "select id, offer_code, lifestyle_level, loyalty_level, pricesense_code from segmented")
add("enrich_targ_date",
    _enriched(lambda raw: E.targeting_date(raw["calendar"], T.SEG_WEEK)),
    "select targ_date from targ")
add("enrich_age_band", _enriched(_aged),
    """select d.id, d.offer_code, k.* exclude (id, years)
    from detail d left join aged k on d.id = k.id""")
add("enrich_offer_dim", _enriched(lambda raw: E.offer_terms(raw["offer_dim"])),
    """select offer_code, supplier_name, round(dim_discount + 1e-7, 4) + 0.0 as dim_discount_amt,
    offer_amount from terms""")
add("enrich_offer_discount", on_base(_no_time), f"select {SWAP} from base")
add("enrich_product",
    lambda spark, folder: rounded(_no_time(T.frames(spark, folder, with_products=True).base)),
    f"""select base.{SWAP}, prod_hier_l20_code, prod_desc,
    case when upper(prod_desc) like '%X-TRA%' or upper(prod_desc) like '%NGLAMARK%'
      or upper(prod_desc) like '%MARKET%' then 'private' else 'non-private' end
      as supplier_private_label
    from base left join products using (prod_code)""")
add("enrich_banner",
    _enriched(lambda raw: E.attach_banner(
        _scoped(raw, "contact_detail"), tables.store_dim(raw["stores"]))),
    f"select {SWAP.replace('exclude (', 'exclude (event_code, ')}"
    " from detail left join stores using (store_code)")


# --- measures -----------------------------------------------------------------

MEASURE_SQL: dict[tuple[str, str], str] = {}


def measure(key: str, module: str, name: str, sql: str) -> None:
    MEASURE_SQL[module, name] = sql

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(module_report(module, T.frames(spark, folder), LEVELS, [name]))
    add(key, run, sql)


def simple(key: str, module: str, name: str, source: str, sql: str) -> None:
    measure(key, module, name, leveled(source, LEVELS, {name: sql}))


def side_by_side(key, module, name, left, left_sql, right, right_sql, sql) -> None:
    measure(key, module, name, joined(
        leveled(left, LEVELS, {"a": left_sql}), leveled(right, LEVELS, {"b": right_sql}),
        KEYS, name, sql))


IDS = "count(distinct id)"
ACTIVE = "(select * from alc where trim(loyalty_level) not in ('GO', 'LP'))"
LOYAL = "(select * from alc where trim(loyalty_level) in ('PR', 'VL'))"
DELIVERED = "(select * from base where contact_stage_code = 'DLV')"
ACTIVATED = "(select * from base where contact_stage_code = 'ACT' and lower(channel_code) like '%{}%')"
REDEEMED_ON = "(select * from redeemed where lower(channel_code) like '%{}%')"

ALLOCATION = [
    ("alloc_coupon_value_per_customer", "coupon_value_per_customer", "exposed",
     num(ratio(f"sum({DISC})", IDS))),
    ("alloc_active_customers", "active_customers", ACTIVE, IDS),
    ("alloc_active_customers_percentage", "active_customers_percentage", ACTIVE,
     num(ratio(f"{IDS} * 100", "(select count(*) from (select distinct * from alc))"))),
    ("alloc_active_loyal_customer", "active_loyal_customer", LOYAL, IDS),
    ("alloc_coupon_value", "coupon_value", "exposed", num(f"sum({DISC})")),
    ("alloc_coupons_allocated", "coupons_allocated", DELIVERED, "count(offer_code)"),
    ("alloc_coupons_exposed", "coupons_exposed", "exposed", "count(offer_code)"),
    ("alloc_exposed_households", "exposed_households", "exposed", IDS),
    ("alloc_mailed_households", "mailed_households", "exposed", IDS),
    ("alloc_household_allocated", "household_allocated", DELIVERED, IDS),
]
COST = [
    ("cost_redemption", "redemption_cost", "redeemed", num(f"sum({DISC})")),
    ("cost_targeting", "targeting_cost", "targeted", num("sum(offer_amount)")),
    ("cost_production", "production_cost", "targeted", num(ratio("sum(offer_amount)", IDS))),
]
for module, listed in (("allocation", ALLOCATION), ("cost", COST)):
    for key, name, source, sql in listed:
        simple(key, module, name, source, sql)
side_by_side("cost_campaign", "cost", "campaign_cost",
             "redeemed", f"coalesce(sum({DISC}), 0)", "targeted", "coalesce(sum(offer_amount), 0)",
             num("a + b"))

IMPACT = "customer_impact"
simple("impact_trialist", IMPACT, "trialist",
       "(select * from exp_prod_dur e where not exists (select 1 from post_n p"
       " where p.id = e.id and p.prod_code = e.prod_code))", IDS)
for key, name, condition in [
    ("impact_repeaters", "repeaters", "n = 1"), ("impact_adopters", "adopters", "n > 1"),
]:
    simple(key, IMPACT, name,
           "(select e.* from exp_prod_dur e join post_n p on e.id = p.id"
           f" and e.prod_code = p.prod_code where {condition})", IDS)
simple("impact_category_not_product", IMPACT, "buy_in_category_but_not_product",
       "missed", "count(id)")
for period in ("pre", "dur", "post"):
    visits = (f"(select e.*, i.transaction_fid from exp_prod e join"
              f" items_{period} i on e.id = i.id)")
    everyone = f"(select count(distinct e.id) from exp_prod e join items_{period} i on e.id = i.id)"
    simple(f"impact_{period}_frequency", IMPACT, f"{period}_average_frequency_of_purchase",
           visits, num(ratio("count(distinct transaction_fid)", everyone)))
simple("impact_lapsed_buyers", IMPACT, "lapsed_buyers",
       "(select * from exp_prod_pre e where not exists (select 1 from post_n p"
       " where p.id = e.id and p.prod_code = e.prod_code))", IDS)
simple("impact_retained_hhs", IMPACT, "retained_hhs",
       "(select * from exp_prod_pre e where exists (select 1 from post_n p"
       " where p.id = e.id and p.prod_code = e.prod_code))", IDS)
BASKET_SQL = ratio(
    """(select count(distinct transaction_fid) from items_dur i join redeemed r on i.id = r.id
    and i.prod_code = r.prod_code and i.transaction_day = cast(r.contact_cust_detail_dttm as date))""",
    "(select count(distinct transaction_fid) from items_dur where id in (select id from exposed))")
measure("impact_average_basket_with_offer", IMPACT, "average_basket_with_offer",
        one_row(KEYS, "average_basket_with_offer", num(BASKET_SQL)))

BAD_SQL = ("(select count(distinct id) from (select * from unexposed union all"
           " select * from repeated))")
MAL_SQL = "(select count(*) from (select * from unexposed union all select * from repeated))"
UNKNOWN_SQL = "(select count(*) from rdm where id is null or trim(id) = '' or id = 'null')"
measure("fraud_bad_redeemers", "fraud", "bad_redeemers", one_row(KEYS, "bad_redeemers", BAD_SQL))
measure("fraud_non_cc_malredemptions", "fraud", "non_cc_malredemptions",
        one_row(KEYS, "non_cc_malredemptions", UNKNOWN_SQL))
measure("fraud_mal_redemptions", "fraud", "mal_redemptions",
        one_row(KEYS, "mal_redemptions", MAL_SQL))
for key, name, source, sql in [
    ("fraud_control_redeemers", "control_redeemers",
     "(select * from rdm where event_control_flag = 'Y')", IDS),
    ("fraud_control_participation", "control_participation", "control_shoppers", IDS),
    ("fraud_mis_redemptions", "mis_redemptions", "misplaced", "count(*)"),
    ("fraud_app_multi_redeemers", "app_multi_redeemers", "again_digital", IDS),
    ("fraud_dm_multi_redeemers", "dm_multi_redeemers", "again_paper", IDS),
    ("fraud_app_dm_multi_redeemers", "app_dm_multi_redeemers", "in_both", IDS),
]:
    simple(key, "fraud", name, source, sql)

MAILED_BUYERS = "(select * from exposed where id in (select id from buyers))"
for key, name, source, sql in [
    ("rdm_hh_redeemers", "hh_redemeers", "redeemed", IDS),
    ("rdm_number_of_redemptions", "number_of_redemptions", "redeemed", "count(offer_code)"),
    ("rdm_correct_redeemers", "correct_redemeers", "correct", IDS),
    ("rdm_valid_redemption", "valid_redemption", "correct", "count(id)"),
    ("rdm_paper_redeemers", "paper_redemeers", REDEEMED_ON.format("paper"), IDS),
    ("rdm_digital_redeemers", "digital_redemeers", REDEEMED_ON.format("digital"), IDS),
    ("rdm_paper_triggered", "paper_trigered", ACTIVATED.format("paper"), "count(offer_code)"),
    ("rdm_digital_triggered", "digital_trigered", ACTIVATED.format("digital"), "count(offer_code)"),
    ("rdm_mailed_participation", "mailed_participation", MAILED_BUYERS, IDS),
    ("rdm_coupons_per_hh", "coupon_redeem_per_hh", "redeemed", num(ratio("count(offer_code)", IDS))),
]:
    simple(key, "redemption", name, source, sql)
side_by_side("rdm_mailed_penetration", "redemption", "mailed_penetration",
             MAILED_BUYERS, IDS, "exposed", IDS, num(ratio("a", "b")))
PENETRATION_SQL = ratio("(select count(*) from buyers)", "(select count(*) from universe)")
measure("rdm_overall_penetration", "redemption", "overall_penetration",
        one_row(KEYS, "overall_penetration", num(PENETRATION_SQL)))
side_by_side("rdm_redemption_rate", "redemption", "redemption_rate",
             "redeemed", "count(offer_code)", "exposed", "count(offer_code)", num(ratio("a", "b")))
side_by_side("rdm_response_rate", "redemption", "response_rate",
             "redeemed", IDS, "exposed", IDS, num(ratio("a", "b")))
INDEX_SQL = ratio(
    ratio("a", f"(select {IDS} from redeemed)"), ratio("b", f"(select {IDS} from exposed)"))
side_by_side("rdm_index_vs_mailed", "redemption", "index_vs_mailed",
             "redeemed", IDS, "exposed", IDS, num(INDEX_SQL))


# --- uplift -------------------------------------------------------------------

def _members_sql(source: str, levels, columns: list[str]) -> str:
    """Panel rows per level: the panel itself overall, else once per allocated group."""
    keys = L.key_columns(L.parse_levels(levels))
    selects = []
    for level in L.parse_levels(levels):
        labels = [
            f"coalesce(cast({k} as varchar), 'XX') as {k}" if k in level else f"'total' as {k}"
            for k in keys
        ]
        labels.append(f"'{L.level_name(level)}' as grouping_level")
        picked = ", ".join(f"p.{c}" for c in columns)
        if level:
            groups = f"(select distinct a.id, {', '.join(labels)} from alc a)"
            selects.append(
                f"select g.* exclude (id), {picked} from {groups} g join {source} p on g.id = p.id")
        else:
            selects.append(f"select {', '.join(labels)}, {picked} from {source} p")
    return " union all ".join(selects)


def _stats_sql(source: str, levels, metric: str) -> str:
    keys = [*L.key_columns(L.parse_levels(levels)), "grouping_level"]
    x, y = f"cast(pre_{metric} as double)", f"cast(post_{metric} as double)"
    columns = []
    for arm, flag in (("t", 1), ("c", 0)):
        where = f"filter (event_control_flag = {flag})"
        columns += [
            f"count(*) {where} as n_{arm}", f"sum({x}) {where} as x_{arm}",
            f"sum({y}) {where} as y_{arm}", f"var_pop({x}) {where} as vx_{arm}",
            f"var_pop({y}) {where} as vy_{arm}", f"covar_pop({x}, {y}) {where} as cxy_{arm}",
        ]
    members = _members_sql(
        source, levels, ["event_control_flag", f"pre_{metric}", f"post_{metric}"])
    stats = f"select {', '.join(keys)}, {', '.join(columns)} from ({members}) group by {', '.join(keys)}"
    return f"""select *, (y_t / n_t - y_c / n_c) - slope * (x_t / n_t - x_c / n_c) as tau,
      (syy - slope * sxy) / (n_t + n_c - 3) as mse, x_t / n_t - x_c / n_c as dx,
      y_c * x_t / nullif(x_c, 0) as expected
      from (select *, coalesce(sxy / nullif(sxx, 0), 0) as slope from (select *,
        n_t * vx_t + n_c * vx_c as sxx, n_t * cxy_t + n_c * cxy_c as sxy,
        n_t * vy_t + n_c * vy_c as syy from ({stats})))"""


def _uplift_query(names: list[str], **options) -> Query:
    return lambda spark, folder: rounded(
        uplift_report(T.frames(spark, folder), UPLIFT_LEVELS, names, **options))


UPLIFT_KEYS = [*L.key_columns(UPLIFT_LEVELS), "grouping_level"]


def uplift(key: str, name: str, metric: str, sql: str) -> None:
    keys = ", ".join(UPLIFT_KEYS)
    stats = _stats_sql("basket_panel", UPLIFT_LEVELS, metric)
    add(key, _uplift_query([name]), f"select {keys}, {num(sql)} as {name} from ({stats})")


UPLIFT_MEASURES = [
    ("uplift_units", "units_uplift", "units", "tau * n_t"),
    ("uplift_sales", "sales_uplift", "spend", "tau * n_t"),
    ("uplift_visits", "visits_uplift", "visits", "tau * n_t"),
    ("uplift_adjusted_sales", "adjusted_sales_uplift", "spend", "tau * n_t"),
    ("uplift_units_pct", "units_uplift_percentage", "units", "tau * n_t / nullif(expected, 0)"),
    ("uplift_visits_pct", "visits_uplift_percentage", "visits", "tau * n_t / nullif(expected, 0)"),
    ("uplift_sales_pct", "sales_uplift_percentage", "spend", "tau * n_t / nullif(expected, 0)"),
    ("uplift_adjusted_pct", "adjusted_uplift_percentage", "spend",
     "tau * n_t / nullif(expected, 0)"),
    ("uplift_adjusted_per_customer", "adjusted_uplift_per_customer", "spend", "tau"),
    ("uplift_per_customer", "uplift_per_customer", "spend", "tau"),
]
for key, name, metric, sql in UPLIFT_MEASURES:
    uplift(key, name, metric, sql)

COST_SQL = joined(
    leveled("redeemed", UPLIFT_LEVELS, {"a": f"coalesce(sum({DISC}), 0)"}),
    leveled("targeted", UPLIFT_LEVELS, {"b": "coalesce(sum(offer_amount), 0)"}),
    L.key_columns(UPLIFT_LEVELS), "cost", "a + b")
add("uplift_scr", _uplift_query(["scr"]),
    f"""select {', '.join(UPLIFT_KEYS)}, {num('tau * n_t / nullif(cost, 0)')} as scr
    from ({_stats_sql('basket_panel', UPLIFT_LEVELS, 'spend')}) join ({COST_SQL})
    using ({', '.join(UPLIFT_KEYS)})""")


def _model_sql(source: str, method: str) -> str:
    keys = ", ".join(UPLIFT_KEYS)
    selects = []
    for metric in ("units", "spend", "visits"):
        shared = f"""select {keys}, n_t as total_test_cust, n_c as total_control_cust,
          '{metric}' as metric, round(expected + 1e-7, 4) + 0.0 as expected"""
        if method == "ratio":
            fields = "round(y_t - expected + 1e-7, 4) + 0.0 as total_uplift"
        else:
            fields = """round(slope + 1e-7, 4) + 0.0 as slope,
              round(tau + 1e-7, 4) + 0.0 as uplift_per_test_customer,
              round(tau * n_t + 1e-7, 4) + 0.0 as total_uplift, round(se + 1e-7, 4) + 0.0 as standard_error,
              case when abs(tau) > 1.959964 * se then 'significant'
                when abs(tau) > 1.281552 * se then 'directional' else 'not significant' end as verdict"""
        selects.append(f"""{shared}, {fields} from (select *,
          sqrt(mse * (1 / n_t + 1 / n_c + dx * dx / nullif(sxx, 0))) as se
          from ({_stats_sql(source, UPLIFT_LEVELS, metric)}))""")
    return " union all ".join(selects)


for method in ("ancova", "ratio"):
    add(f"uplift_{method}",
        lambda spark, folder, method=method: rounded(uplift_statistics(
            T.frames(spark, folder), UPLIFT_LEVELS, method=method, source="item")),
        _model_sql("item_panel", method))


def _expected(spark: SparkSession, folder: str) -> DataFrame:
    stats = uplift_statistics(T.frames(spark, folder), UPLIFT_LEVELS)
    return rounded(stats.select(*UPLIFT_KEYS, "metric", "expected"))


add("uplift_expected", _expected, " union all ".join(
    f"""select {', '.join(UPLIFT_KEYS)}, '{metric}' as metric, round(expected + 1e-7, 4) + 0.0 as expected
    from ({_stats_sql('basket_panel', UPLIFT_LEVELS, metric)})"""
    for metric in ("units", "spend", "visits")))


def _on_frames(build: Callable) -> Query:
    return lambda spark, folder: rounded(build(T.frames(spark, folder)))


OUTCOMES = ", ".join(
    f"coalesce({s}_{m}, 0) as {s}_{m}" for s in ("pre", "post") for m in ("units", "spend", "visits"))
for unit in ("item", "basket"):
    add(f"uplift_customer_{unit}s",
        _on_frames(lambda f, unit=unit: facts.customer_outcomes(
            f.items if unit == "item" else f.baskets, unit)),
        f"select id, {OUTCOMES} from {unit}_pre full join {unit}_post using (id)")
add("uplift_panel",
    _on_frames(lambda f: facts.uplift_panel(f.panel, facts.customer_outcomes(f.baskets, "basket"))),
    "select * from basket_panel")


def _pivot(f) -> DataFrame:
    return matching.week_pivot(f.items.filter("in_pre"), T.PRE_WEEKS)


def _inputs(f) -> DataFrame:
    return matching.cluster_input(_pivot(f), f.base).select("id", "event_control_flag", *T.PRE_WEEKS)


def _candidates(f) -> DataFrame:
    return matching.matching_candidates(f.items.filter("in_pre"), f.base)


def _clusters_of_ids(clustered: DataFrame) -> DataFrame:
    """What SQL can say of a clustering: every customer once, in a cluster that exists."""
    return clustered.select(
        "id", "event_control_flag", F.col("cluster").between(0, 99).alias("in_range"))


def _clustered(f) -> DataFrame:
    """Candidates in clusters of like customers that SQL can follow."""
    groups = f.base.filter("contact_stage_code = 'ALC'").select(
        "id", F.concat(F.coalesce("loyalty_level", F.lit("XX")), F.coalesce("lifestyle_level", F.lit("XX")))
        .alias("cluster")).distinct()
    return _candidates(f).join(groups, "id")


def _resampled_report(f) -> DataFrame:
    panel = matching.build_panel(_clustered(f), "systematic")
    return uplift_report(replace(f, panel=panel), UPLIFT_LEVELS, ["sales_uplift"])


add("uplift_week_pivot", _on_frames(_pivot), "select * from weekly")
add("uplift_cluster_input", _on_frames(_inputs), "select * from cluster_rows")
add("uplift_cluster",
    _on_frames(lambda f: _clusters_of_ids(
        matching.cluster_customers(_candidates(f), _pivot(f)))),
    "select id, event_control_flag, true as in_range from candidates")
add("uplift_sys_resample",
    _on_frames(lambda f: matching.systematic_resample(_clustered(f))),
    "select * from resampled")
add("uplift_left_out", _on_frames(lambda f: matching.left_out(_clustered(f))),
    """select cluster, count(*) as customers from clustered group by cluster
    having least(count(*) filter (event_control_flag <> 'Y'),
      count(*) filter (event_control_flag = 'Y')) < 10""")
add("uplift_resampled_panel_report", _on_frames(_resampled_report),
    f"""select {', '.join(UPLIFT_KEYS)}, {num('tau * n_t')} as sales_uplift
    from ({_stats_sql('resampled_panel', UPLIFT_LEVELS, 'spend')})""")
add("uplift_one_to_one",
    _on_frames(lambda f: matching.one_to_one_match(_clustered(f))),
    """select t.cluster, t.rank as position, t.id as test_id, t.score as test_score,
    c.id as control_id, c.score as control_score
    from placed t join placed c on t.cluster = c.cluster and t.rank = c.rank
    where t.event_control_flag <> 'Y' and c.event_control_flag = 'Y'
      and t.rank > t.last and c.rank > c.last""")


def _described(f) -> DataFrame:
    return feature_matching.with_features(_clustered(f), _pivot(f))


def _part_sizes(f) -> DataFrame:
    """How many parts of each size a cluster was cut into, none above 40 customers."""
    parts = feature_matching.bounded_clusters(_described(f), 40).groupBy("cluster", "part").agg(
        F.count("*").alias("customers"))
    return parts.groupBy("cluster", "customers").agg(F.count("*").alias("parts"))


def _pair_counts(f) -> DataFrame:
    """Pairs of each cluster and the different customers in them."""
    return feature_matching.feature_match(_described(f)).groupBy("cluster").agg(
        F.count("*").alias("pairs"), F.count_distinct("test_id").alias("test_customers"),
        F.count_distinct("control_id").alias("control_customers"))


DESCRIBED_SQL = """(select cluster, id, min(event_control_flag) as event_control_flag from clustered
    where id is not null and cluster is not null group by cluster, id
    having min(event_control_flag) = max(event_control_flag))"""

add("uplift_bounded_clusters", _on_frames(_part_sizes),
    f"""select * from (
    with recursive halves as (
      select cluster, count(*) as n, 0 as side from {DESCRIBED_SQL} group by cluster
      union all
      select cluster, (n + s.side) // 2, s.side from halves, (select unnest([0, 1]) as side) s where n > 40)
    select cluster, n as customers, count(*) as parts from halves where n <= 40 group by cluster, n)""")
add("uplift_feature_match", _on_frames(_pair_counts),
    f"""select cluster, pairs, pairs as test_customers, pairs as control_customers from (
    select cluster, least(count(*) filter (event_control_flag <> 'Y'),
      count(*) filter (event_control_flag = 'Y')) as pairs from {DESCRIBED_SQL} group by cluster) where pairs > 0""")


# --- reports ------------------------------------------------------------------

MODULES = ("allocation", "cost", IMPACT, "fraud", "redemption")


def _full_join(parts: list[str], keys: list[str], names: list[str]) -> str:
    """Outer join of levelled results on every key, missing measures as 0."""
    using = ", ".join([*keys, "grouping_level"])
    source = f"({parts[0]})" + "".join(f" full join ({part}) using ({using})" for part in parts[1:])
    filled = ", ".join(f"coalesce({name}, 0) as {name}" for name in names)
    return f"select {using}, {filled} from {source}"


def _module_sql(module: str) -> str:
    bodies = {name: sql for (owner, name), sql in MEASURE_SQL.items() if owner == module}
    return _full_join(list(bodies.values()), KEYS, list(bodies))


def _module(module: str) -> Query:
    names = [name for owner, name in MEASURE_SQL if owner == module]
    return lambda spark, folder: rounded(
        module_report(module, T.frames(spark, folder), LEVELS, names))


for _module_name in MODULES:
    add(f"report_{_module_name}", _module(_module_name), _module_sql(_module_name))
add("report_module", _module("redemption"), _module_sql("redemption"))



def _by_category(module: str) -> Query:
    return lambda spark, folder: rounded(
        module_report(module, T.frames(spark, folder, with_products=True), CATEGORY_LEVELS))


CATEGORY_KEYS = L.key_columns(CATEGORY_LEVELS)


def _in_category(source: str) -> str:
    return f"(select s.*, prod_hier_l20_code from {source} s left join products using (prod_code))"


def _category_sql(measures: list, extra: dict[str, str] | None = None) -> str:
    parts = {
        name: leveled(_in_category(source), CATEGORY_LEVELS, {name: sql})
        for _, name, source, sql in measures
    } | (extra or {})
    return _full_join(list(parts.values()), CATEGORY_KEYS, list(parts))


add("report_allocation_by_category", _by_category("allocation"), _category_sql(ALLOCATION))
add("report_cost_by_category", _by_category("cost"), _category_sql(COST, {"campaign_cost": joined(
    leveled(_in_category("redeemed"), CATEGORY_LEVELS, {"a": f"coalesce(sum({DISC}), 0)"}),
    leveled(_in_category("targeted"), CATEGORY_LEVELS, {"b": "coalesce(sum(offer_amount), 0)"}),
    CATEGORY_KEYS, "campaign_cost", num("a + b"))}))

UPLIFT_NAMES = [*(name for _, name, _, _ in UPLIFT_MEASURES), "scr"]


def _uplift_report_sql(source: str, method: str) -> str:
    """All uplift measures side by side; without a cost there is no return on it."""
    parts = []
    for metric in ("units", "spend", "visits"):
        total = "tau * n_t" if method == "ancova" else "y_t - expected"
        parts.append(f"""(select {', '.join(UPLIFT_KEYS)}, {total} as total_{metric}, expected as e_{metric},
          n_t as n_{metric} from ({_stats_sql(source, UPLIFT_LEVELS, metric)}))""")
    using = f"using ({', '.join(UPLIFT_KEYS)})"
    values = []
    for _, name, metric, sql in UPLIFT_MEASURES:
        total = f"total_{metric}"
        value = f"{total} / nullif(e_{metric}, 0)" if "expected" in sql else total
        values.append(f"{num(f'{total} / n_{metric}' if sql == 'tau' else value)} as {name}")
    values.append(f"{num('total_spend / nullif(cost, 0)')} as scr")
    return f"""select {', '.join(UPLIFT_KEYS)}, {', '.join(values)}
      from {f' join '.join(part + (f' {using}' if i else '') for i, part in enumerate(parts))}
      left join ({COST_SQL}) {using}"""


for report_key, options in {
    "report_uplift": {}, "report_uplift_ratio": {"method": "ratio"}, "report_uplift_item": {"source": "item"},
}.items():
    add(report_key, _uplift_query(UPLIFT_NAMES, **options), _uplift_report_sql(
        f"{options.get('source', 'basket')}_panel", options.get("method", "ancova")))

def _final(spark: SparkSession, folder: str) -> DataFrame:
    # What the modules read is written once.
    target = sinks.shared_folder(spark)
    frames = stage_frames(T.frames(spark, folder, detail=f"{target}/detail"))
    sinks.discard(spark, f"{target}/detail")  # only the enriched contacts are read from now on
    uplift_part = module_report("uplift", frames, UPLIFT_LEVELS, UPLIFT_NAMES, folder=f"{target}/uplift")
    return rounded(final_report([combined_report(frames, LEVELS, folder=f"{target}/combined"), uplift_part]))


def _final_sql() -> str:
    names = [name for _, name in MEASURE_SQL]
    uplift_part = ", ".join(
        key if key in UPLIFT_KEYS else f"'total' as {key}" for key in [*KEYS, "grouping_level"])
    parts = [_module_sql(module) for module in MODULES]
    parts.append(f"""select {uplift_part}, {', '.join(UPLIFT_NAMES)}
      from ({_uplift_report_sql('basket_panel', 'ancova')})""")
    return _full_join(parts, KEYS, [*names, *UPLIFT_NAMES])


add("report_final", _final, _final_sql())


def _read_back(spark: SparkSession, report_frame: DataFrame, name: str) -> DataFrame:
    """Write a report as a table, read the table, copy it and drop the table again."""
    folder = sinks.shared_folder(spark)
    sinks.write_report(report_frame, name, folder)
    copy = sinks.stage(rounded(spark.table(name)), f"{folder}-copy")
    sinks.drop_reports(spark, [name])
    if spark.catalog.tableExists(name):
        raise RuntimeError(f"{name} was not dropped")
    return copy


def _sink_module(spark: SparkSession, folder: str) -> DataFrame:
    """Write the report as a catalog table in a new folder and read the table back."""
    name = sinks.table_name("default", "promolift", "cost", "check", uuid.uuid4().hex[:8])
    report_frame = module_report("cost", T.frames(spark, folder), LEVELS)
    return _read_back(spark, report_frame, name)


def _sink_final(spark: SparkSession, folder: str) -> DataFrame:
    frames = T.frames(spark, folder)
    reports = [
        module_report("cost", frames, LEVELS),
        module_report("allocation", frames, LEVELS, ["coupons_exposed"]),
    ]
    name = sinks.table_name("default", "promolift", "final", "check", uuid.uuid4().hex[:8])
    return _read_back(spark, final_report(reports), name)


add("sink_module_report", _sink_module, _module_sql("cost"))
add("sink_final_report", _sink_final, _full_join(
    [_module_sql("cost"), MEASURE_SQL["allocation", "coupons_exposed"]], KEYS,
    ["redemption_cost", "targeting_cost", "production_cost", "campaign_cost", "coupons_exposed"]))
