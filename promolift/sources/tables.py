"""Typed views of the input tables.

Every function is a narrow projection or filter, so column pruning and filter
pushdown reach the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promolift.functions import vocabulary as V
from promolift.functions.columns import is_filled


@dataclass(frozen=True)
class Period:
    """Weeks ``start`` to ``end``, both inclusive, compared as text.

    With ``weeks`` instead of ``start`` the period is that many calendar weeks
    ending with ``end``; the calendar is then needed.
    """

    end: str
    start: str | None = None
    weeks: int | None = None

    def holds(self, week: Column, calendar: DataFrame | None = None) -> Column:
        if self.start is not None:
            return week.between(self.start, self.end)
        if self.weeks is None or calendar is None:
            raise ValueError("a period needs a start week, or a number of weeks and a calendar")
        return week.between(first_week(calendar, self.end, self.weeks).scalar(), F.lit(self.end))


def first_week(calendar: DataFrame, end: str, weeks: int) -> DataFrame:
    """One-cell frame: the first of the ``weeks`` calendar weeks that end with ``end``."""
    latest = (
        calendar.filter(F.col("fis_week_id") <= end)
        .select("fis_week_id").distinct()
        .orderBy(F.desc("fis_week_id")).limit(weeks)
    )
    return latest.agg(F.min("fis_week_id"))


def project(table: DataFrame, columns: Sequence[str] | Mapping[str, str] | None = None) -> DataFrame:
    """Select columns, or rename them when given as ``{column: new name}``."""
    if columns is None:
        return table
    if isinstance(columns, Mapping):
        return table.select(*[F.col(name).alias(new) for name, new in columns.items()])
    return table.select(*columns)


def read_table(
    spark: SparkSession, name: str, columns: Sequence[str] | Mapping[str, str] | None = None
) -> DataFrame:
    """A catalog table, projected."""
    return project(spark.table(name), columns)


def event_scope(table: DataFrame, event_codes: str | Sequence[str]) -> DataFrame:
    """Rows of the given campaign events (a list, or comma-separated text)."""
    if isinstance(event_codes, str):
        event_codes = event_codes.split(",")
    return table.filter(F.col("event_code").isin(*event_codes)).drop("event_code")


def segment_snapshot(table: DataFrame, seg_week: str) -> DataFrame:
    return table.filter(F.col("seg_week") == seg_week).drop("seg_week")


def items_in(items: DataFrame, period: Period, calendar: DataFrame | None = None) -> DataFrame:
    """Transaction lines of known cards and products in a period; spend is truncated."""
    return items.filter(_usable_item() & period.holds(F.col("fis_week_id"), calendar)).select(
        *_item_columns()
    )


def baskets_in(baskets: DataFrame, period: Period, calendar: DataFrame | None = None) -> DataFrame:
    """Transactions of known cards in a period; spend and quantity are truncated."""
    return baskets.filter(_usable_card() & period.holds(F.col("fis_week_id"), calendar)).select(
        *_basket_columns()
    )


def flagged_items(items: DataFrame, periods: Mapping[str, Period], calendar=None) -> DataFrame:
    """Lines of several periods in one scan, with a boolean ``in_<name>`` for each."""
    return _flagged(items, _usable_item(), _item_columns(), periods, calendar)


def flagged_baskets(baskets: DataFrame, periods: Mapping[str, Period], calendar=None) -> DataFrame:
    return _flagged(baskets, _usable_card(), _basket_columns(), periods, calendar)


def _flagged(table, usable, columns, periods, calendar) -> DataFrame:
    inside = {name: period.holds(F.col("fis_week_id"), calendar) for name, period in periods.items()}
    any_period = F.lit(False)
    for condition in inside.values():
        any_period = any_period | condition
    flags = [condition.alias(f"in_{name}") for name, condition in inside.items()]
    return table.filter(usable & any_period).select(*columns, *flags)


def _usable_card() -> Column:
    return F.col("card_code").isNotNull() & is_filled("card_code")


def _usable_item() -> Column:
    return _usable_card() & is_filled("prod_code")


def _whole(column: str) -> Column:
    """The number without its fraction; text that is no number becomes NULL."""
    return F.col(column).try_cast("double").try_cast("bigint")


def _item_columns() -> list[Column]:
    return [
        F.col("card_code").alias("id"),
        F.col("prod_code"),
        F.col("prod_id"),
        F.col("transaction_code").alias("transaction_fid"),
        _whole("net_spend_amt").alias("spend"),
        F.col("transaction_dttm"),
        F.col("fis_week_id"),
    ]


def _basket_columns() -> list[Column]:
    return [
        F.col("card_code").alias("id"),
        F.col("transaction_code").alias("transaction_fid"),
        _whole("basket_spend_amt").alias("spend"),
        _whole("basket_item_qty").alias("basket_item_qty"),
        F.col("basket_item_qty").alias("item"),
        F.col("transaction_dttm"),
        F.col("fis_week_id"),
    ]


def card_dim(cards: DataFrame) -> DataFrame:
    return cards.select(
        F.col("card_code").alias("id"),
        "card_id",
        "card_birth_date",
        "card_termination_date",
        "card_address_valid_flag",
        "card_address_country_code",
        "card_analyse_now_suppress_flag",
        "card_suppress_flag",
    )


def living_members(members: DataFrame) -> DataFrame:
    alive = (F.col("deceased_date") == V.NOT_DECEASED) | F.col("deceased_date").isNull()
    return members.filter(alive).select(
        F.concat(F.lit(V.MEMBER_PREFIX), "member_id").alias("mem_id"), "deceased_date"
    )


def product_dim(products: DataFrame) -> DataFrame:
    return products.select("prod_code", "prod_hier_l20_code", "prod_desc")


def store_dim(stores: DataFrame) -> DataFrame:
    return stores.select("banner_name", "store_code")


def calendar_dim(calendar: DataFrame) -> DataFrame:
    return calendar.select("date", "fis_week_id", "fis_day_of_week_num")


def test_panel(panel: DataFrame) -> DataFrame:
    """Externally matched panel: 0 is control, 1 is test."""
    return panel.select(
        F.col("card_code").alias("id"), F.col("test_panel").alias("event_control_flag")
    )


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return test_panel(spark.read.parquet(path))
