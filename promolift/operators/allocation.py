"""Allocation: who was targeted, what they were sent and what it was worth."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import functions as F

from promolift.functions import vocabulary as V
from promolift.functions.columns import ratio, stage_is
from promolift.operators.aggregates import percentage, total_part
from promolift.operators.modules import CampaignFrames, pick
from promolift.operators.rollup import Measure, Rows

NAMES = (
    "coupon_value_per_customer",
    "active_customers",
    "active_customers_percentage",
    "active_loyal_customer",
    "coupon_value",
    "coupons_allocated",
    "coupons_exposed",
    "exposed_households",
    "mailed_households",
    "household_allocated",
)


def allocation_measures(
    frames: CampaignFrames, names: Iterable[str] | None = None, keys: Iterable[str] = ()
) -> list[Measure]:
    base = frames.base
    loyalty = F.trim("loyalty_level")
    allocated = stage_is(V.ALLOCATED)
    exposed = Rows("exposed", base, stage_is(V.EXPOSED))
    delivered = Rows("delivered", base, stage_is(V.DELIVERED))
    active = Rows("active", base, allocated & ~loyalty.isin(*V.INACTIVE_LOYALTY))
    loyal = Rows("loyal", base, allocated & loyalty.isin(*V.TOP_LOYALTY))

    def active_share() -> Measure:
        """Per cent of the distinct allocation *rows* of the whole campaign."""
        rows = base.filter(allocated).distinct().agg(F.count("*").alias("n"))
        return Measure(
            "active_customers_percentage",
            (active.ids(),),
            percentage,
            totals=(total_part("allocated_rows", rows),),
        )

    return pick("allocation", {
        "coupon_value_per_customer": lambda: Measure(
            "coupon_value_per_customer", (exposed.sum("offer_discount_amt"), exposed.ids()), ratio
        ),
        "active_customers": lambda: Measure("active_customers", (active.ids(),)),
        "active_customers_percentage": active_share,
        "active_loyal_customer": lambda: Measure("active_loyal_customer", (loyal.ids(),)),
        "coupon_value": lambda: Measure("coupon_value", (exposed.sum("offer_discount_amt"),)),
        "coupons_allocated": lambda: Measure("coupons_allocated", (delivered.count("offer_code"),)),
        "coupons_exposed": lambda: Measure("coupons_exposed", (exposed.count("offer_code"),)),
        "exposed_households": lambda: Measure("exposed_households", (exposed.ids(),)),
        "mailed_households": lambda: Measure("mailed_households", (exposed.ids(),)),
        "household_allocated": lambda: Measure("household_allocated", (delivered.ids(),)),
    }, names)
