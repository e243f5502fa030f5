"""Campaign tables derived from the generated test tables (see FIXTURES.md)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolift.operators.modules import CampaignFrames
from promolift.plans.prepare import Campaign, prepare
from promolift.sources.tables import Period

EVENT_CODES = ("EV0", "EV1", "EV2", "EV3")
SEG_WEEK = "199926"
CAMPAIGN = Campaign(
    event_codes=EVENT_CODES,
    seg_week=SEG_WEEK,
    pre=Period(start="199801", end="199953"),
    during=Period(start="200001", end="200053"),
    post=Period(start="200101", end="200153"),
)
PRE_WEEKS = [f"{year}{week:02d}" for year in (1998, 1999) for week in range(1, 54)]


def week(day: str) -> str:
    return f"string(int(year({day}) * 100 + floor((dayofyear({day}) - 1) / 7) + 1))"


def card(key: str) -> str:
    return f"concat('0', {key} * 37 + 100000)"


def _reader(spark: SparkSession, folder: str):
    """Each file is opened once, however many tables are derived from it."""
    return cache(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))


def _lines(read) -> DataFrame:
    # Orders meet customers first, so the lines are shuffled once.
    orders = read("orders").join(read("customer").select("c_custkey"), F.expr("c_custkey = o_custkey"))
    return read("lineitem").join(orders, F.expr("l_orderkey = o_orderkey"))


def contact_detail(read) -> DataFrame:
    return _lines(read).selectExpr(
        f"""case when l_linenumber in (5, 6) and l_orderkey % 97 = 0 then null
          when l_linenumber in (5, 6) and l_orderkey % 89 = 0 then ''
          when l_linenumber in (5, 6) and l_orderkey % 83 = 0 then 'null'
          else {card('o_custkey')} end as id""",
        """case l_linenumber when 1 then 'ALC' when 2 then 'DLV' when 3 then 'EXP'
          when 4 then 'EXP' when 5 then 'RDM' when 6 then 'RDM' else 'ACT' end
          as contact_stage_code""",
        "concat('OF', l_partkey % 40) as offer_code",
        "concat('P', l_partkey % 50) as prod_code",
        "concat('S', l_suppkey) as store_code",
        """case l_returnflag when 'A' then 'DIGITAL_APP' when 'R' then 'PAPER_DM'
          else 'EMAIL' end as channel_code""",
        "l_quantity as offer_rank_num",
        "l_extendedprice * l_discount + 0.0d as offer_discount_amt",
        "o_orderdate as contact_cust_detail_dttm",
        "string(year(o_orderdate)) as fis_year_id",
        f"{week('o_orderdate')} as fis_week_id",
        "concat('EV', l_orderkey % 4) as event_code",
    )


def contact_header(read) -> DataFrame:
    return read("customer").selectExpr(
        f"{card('c_custkey')} as id",
        "'ALC' as contact_stage_code",
        "if(c_custkey % 5 = 0, 'Y', 'N') as event_control_flag",
        "case when c_custkey % 4 = 0 then 'Y' when c_custkey % 4 = 1 then null else 'N' end"
        " as less_loyal_flag",
        "concat('EV', c_custkey % 4) as event_code",
    )


def offer_product(read) -> DataFrame:
    return read("part").filter("(p_partkey % 200) % 7 <> 0").selectExpr(
        "concat('OF', p_partkey % 40) as offer_code", "concat('P', p_partkey % 50) as prod_code"
    ).distinct()


def offer_dim(read) -> DataFrame:
    terms = read("part").selectExpr(
        "concat('OF', p_partkey % 40) as offer_code", "p_brand as supplier_name",
        "p_retailprice * 0.05d as discount", "double(p_size) as amount",
    )
    return terms.groupBy("offer_code", "supplier_name").agg(
        F.max("discount").alias("offer_discount_amt"), F.max("amount").alias("offer_amount")
    )


def _snapshots(read, level: str, sql: str) -> DataFrame:
    """The used snapshot, and an older one that must be filtered out."""
    used = read("customer").selectExpr(
        f"{card('c_custkey')} as id", f"{sql} as {level}", f"'{SEG_WEEK}' as seg_week"
    )
    older = used.selectExpr("id", f"'OLD' as {level}", "'199925' as seg_week")
    return used.unionByName(older)


def seg_lifestyle(read) -> DataFrame:
    return _snapshots(read, "lifestyle_level", "if(c_custkey % 13 = 0, null, c_mktsegment)")


def seg_loyalty(read) -> DataFrame:
    return _snapshots(
        read, "loyalty_level",
        """case when c_custkey % 11 = 0 then null when c_acctbal < 500 then 'GO'
          when c_acctbal < 2000 then 'LP' when c_acctbal < 5000 then 'OC'
          when c_acctbal < 7500 then 'VL' else 'PR' end""",
    )


def seg_pricesense(read) -> DataFrame:
    return _snapshots(
        read, "pricesense_code",
        "case c_nationkey % 3 when 0 then 'LA' when 1 then 'MM' else 'UM' end",
    )


def cards(read) -> DataFrame:
    return read("customer").selectExpr(
        f"{card('c_custkey')} as card_code",
        "string(c_custkey) as card_id",
        "if(c_custkey % 17 = 0, null, date_add(date'1930-01-01', int(c_custkey * 53 % 33000)))"
        " as card_birth_date",
        "if(c_custkey % 10 = 0, date'2000-01-01', null) as card_termination_date",
        "if(c_custkey % 6 = 0, 'Y', 'N') as card_address_valid_flag",
        "if(c_nationkey % 4 = 0, 'SE', 'NO') as card_address_country_code",
        "if(c_custkey % 9 = 0, 'Y', '') as card_analyse_now_suppress_flag",
        "if(c_custkey % 8 = 0, 'Y', 'N') as card_suppress_flag",
    )


def members(read) -> DataFrame:
    return read("customer").selectExpr(
        "string(c_custkey * 37 + 100000) as member_id",
        """case when c_custkey % 14 = 0 then '19991231' when c_custkey % 3 = 0 then null
          else '00000000' end as deceased_date""",
    )


def products(read) -> DataFrame:
    numbered = read("part").selectExpr("p_partkey % 50 as n", "p_name")
    return numbered.groupBy("n").agg(F.min("p_name").alias("prod_desc")).selectExpr(
        "concat('P', n) as prod_code", "concat('C', n % 8) as prod_hier_l20_code", "prod_desc"
    )


def stores(read) -> DataFrame:
    """Stores are suppliers and the banner is their nation."""
    placed = read("supplier").join(read("nation"), F.expr("s_nationkey = n_nationkey"))
    return placed.selectExpr("concat('S', s_suppkey) as store_code", "n_name as banner_name")


def calendar(read) -> DataFrame:
    """Every day from the first to the last order; some have none, so they are filled in."""
    days = read("orders").selectExpr("date(o_orderdate) as day").selectExpr(
        "explode(sequence(min(day), max(day))) as date"
    )
    return days.selectExpr(
        "date", f"{week('date')} as fis_week_id",
        "string((dayofyear(date) - 1) % 7 + 1) as fis_day_of_week_num",
    )


def items(read) -> DataFrame:
    return _lines(read).selectExpr(
        f"""case when l_orderkey % 101 = 0 then '' when l_orderkey % 103 = 0 then null
          else {card('o_custkey')} end as card_code""",
        "concat('P', l_partkey % 50) as prod_code",
        "string(l_partkey) as prod_id",
        "string(l_orderkey) as transaction_code",
        "l_extendedprice * (1 - l_discount) as net_spend_amt",
        "l_quantity as quantity",
        "o_orderdate as transaction_dttm",
        f"{week('o_orderdate')} as fis_week_id",
    )


def baskets(read) -> DataFrame:
    # Sums of money depend on their order; rounding keeps the later truncation stable.
    return items(read).groupBy(
        "transaction_code", "card_code", "transaction_dttm", "fis_week_id"
    ).agg(
        F.round(F.sum("net_spend_amt"), 4).alias("basket_spend_amt"),
        F.sum("quantity").alias("basket_item_qty"),
    )


def panel(read) -> DataFrame:
    return read("customer").selectExpr(
        f"{card('c_custkey')} as card_code", "if(c_custkey % 5 = 0, '0', '1') as test_panel"
    )


BUILDERS = {
    "contact_header": contact_header,
    "contact_detail": contact_detail,
    "offer_product": offer_product,
    "offer_dim": offer_dim,
    "seg_lifestyle": seg_lifestyle,
    "seg_loyalty": seg_loyalty,
    "seg_pricesense": seg_pricesense,
    "cards": cards,
    "members": members,
    "products": products,
    "stores": stores,
    "calendar": calendar,
    "items": items,
    "baskets": baskets,
    "panel": panel,
}


class RawTables(Mapping):
    """The derived tables, each built when first asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._read, self._built = _reader(spark, folder), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = BUILDERS[name](self._read)
        return self._built[name]

    def __iter__(self):
        return iter(BUILDERS)

    def __len__(self) -> int:
        return len(BUILDERS)


def raw_tables(spark: SparkSession, folder: str) -> RawTables:
    return RawTables(spark, folder)


def written_tables(spark: SparkSession, folder: str, target: str) -> dict[str, DataFrame]:
    """The derived tables as files, as a real campaign would find them."""
    written = {}
    for name, table in raw_tables(spark, folder).items():
        table.write.parquet(f"{target}/{name}")
        written[name] = spark.read.parquet(f"{target}/{name}")
    return written


def frames(
    spark: SparkSession, folder: str, with_products: bool = False, detail: str | None = None
) -> CampaignFrames:
    return prepare(raw_tables(spark, folder), CAMPAIGN, with_products, detail)
