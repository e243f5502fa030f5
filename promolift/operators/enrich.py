"""From contact events to the enriched contact frame ("base") all measures use.

The customer attributes live in several small tables with the same key. They
are joined to each other first, on customer-sized data, so that the large event
table is shuffled and merged once, not once per attribute table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.functions import vocabulary as V
from promolift.functions.columns import age_band, is_filled, private_label, slot_segment, stage_is
from promolift.functions.joins import even_join


def header_attributes(header: DataFrame) -> DataFrame:
    """Customer flags from the allocation rows of the contact header."""
    return header.filter(stage_is(V.ALLOCATED)).drop("contact_stage_code")


def known_segments(*segments: DataFrame) -> list[DataFrame]:
    return [segment.filter(is_filled("id")) for segment in segments]


def targeting_date(calendar: DataFrame, seg_week: str) -> DataFrame:
    """One-cell frame: the last day of the targeting week."""
    day = (F.col("fis_week_id") == seg_week) & (
        F.col("fis_day_of_week_num") == V.TARGETING_DAY_OF_WEEK
    )
    return calendar.filter(day).agg(F.min("date").alias("targ_date"))


def with_age(cards: DataFrame, targ_date: DataFrame) -> DataFrame:
    dated = cards.crossJoin(F.broadcast(targ_date))
    return dated.withColumn("age", age_band(F.col("card_birth_date"), F.col("targ_date"))).drop(
        "targ_date"
    )


def customer_profile(*attributes: DataFrame) -> DataFrame:
    """All attribute tables side by side, for every id that any of them knows.

    An id with several rows in a table gets a row for each, as a left join of
    that table would give.
    """
    tables = [table.filter(F.col("id").isNotNull()) for table in attributes]
    if len(tables) == 1:
        return tables[0]
    profile = tables[0]
    for table in tables[1:]:
        profile = profile.join(table, "id", "full")
    return profile


def attach_profile(detail: DataFrame, profile: DataFrame) -> DataFrame:
    return even_join(detail, profile, ["id"])


def with_slot_segment(contacts: DataFrame) -> DataFrame:
    rank = F.col("offer_rank_num").cast("double")
    return contacts.withColumn("slot_segment", slot_segment(rank, F.col("less_loyal_flag")))


def offer_terms(offer_dim: DataFrame) -> DataFrame:
    """One row per offer: its first supplier by name, with that supplier's highest terms."""
    per_supplier = (
        offer_dim.filter(is_filled("offer_code"))
        .groupBy("offer_code", "supplier_name")
        .agg(F.max("offer_discount_amt").alias("discount"), F.max("offer_amount").alias("amount"))
    )
    chosen = F.struct(F.col("supplier_name").isNull(), "supplier_name", "discount", "amount")
    return (
        per_supplier.groupBy("offer_code").agg(F.min(chosen).alias("first"))
        .select(
            "offer_code", "first.supplier_name",
            F.col("first.discount").alias("dim_discount_amt"),
            F.col("first.amount").alias("offer_amount"),
        )
    )


def attach_offer_terms(contacts: DataFrame, terms: DataFrame) -> DataFrame:
    """Supplier and cost of the offer; coupon value from the offer until it is used."""
    discount = F.when(stage_is(*V.OFFER_PRICED_STAGES), F.col("dim_discount_amt")).otherwise(
        F.col("offer_discount_amt")
    )
    joined = even_join(contacts, terms, ["offer_code"])
    return joined.withColumn("offer_discount_amt", discount).drop("dim_discount_amt")


def attach_product(contacts: DataFrame, products: DataFrame) -> DataFrame:
    """Category, description and private-label flag of the contacted product."""
    labelled = products.withColumn("supplier_private_label", private_label(F.col("prod_desc")))
    return even_join(contacts, labelled, ["prod_code"])


def attach_banner(contacts: DataFrame, stores: DataFrame) -> DataFrame:
    return even_join(contacts, stores, ["store_code"])


def enrich(
    detail: DataFrame,
    header: DataFrame,
    segments: list[DataFrame],
    cards: DataFrame,
    calendar: DataFrame,
    offer_dim: DataFrame,
    seg_week: str,
    products: DataFrame | None = None,
    stores: DataFrame | None = None,
) -> DataFrame:
    """The whole enrichment. ``products`` and ``stores`` add their optional columns."""
    profile = customer_profile(
        header_attributes(header),
        *known_segments(*segments),
        with_age(cards, targeting_date(calendar, seg_week)),
    )
    base = with_slot_segment(attach_profile(detail, profile))
    base = base.drop("offer_rank_num", "less_loyal_flag")
    base = attach_offer_terms(base, offer_terms(offer_dim))
    if products is not None:
        base = attach_product(base, products)
    if stores is not None:
        base = attach_banner(base, stores)
    return base
