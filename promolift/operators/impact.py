"""Customer impact: how exposed customers' buying changed."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.functions import vocabulary as V
from promolift.functions.columns import ratio, stage_is
from promolift.functions.joins import even_join
from promolift.operators.aggregates import scalar_row
from promolift.operators.facts import (
    coupon_outcomes,
    exposed_pairs,
    purchases_of,
    shared_visits_of,
    visits_of,
)
from promolift.operators.modules import CampaignFrames, pick
from promolift.operators.rollup import Measure, Part, Rows

# Measure name to the coupon outcome it counts customers of.
OUTCOME_OF = {
    "trialist": "tried",
    "repeaters": "repeated",
    "adopters": "adopted",
    "lapsed_buyers": "lapsed",
    "retained_hhs": "retained",
}
PERIOD_OF = {
    "pre_average_frequency_of_purchase": "pre",
    "dur_average_frequency_of_purchase": "dur",
    "post_average_frequency_of_purchase": "post",
}
CATEGORY = "buy_in_category_but_not_product"
BASKET = "average_basket_with_offer"
NAMES = (
    "trialist", "repeaters", "adopters", CATEGORY, *PERIOD_OF, "lapsed_buyers", "retained_hhs", BASKET,
)


def impact_measures(
    frames: CampaignFrames, names: Iterable[str] | None = None, keys: Iterable[str] = ()
) -> list[Measure]:
    names = list(NAMES if names is None else names)
    base = frames.base
    exposed = base.filter(stage_is(V.EXPOSED))

    @cache
    def exposures() -> DataFrame:
        """Exposures with the outcomes of their coupon, if a requested measure needs them."""
        if not {*OUTCOME_OF, CATEGORY} & set(names):
            return exposed
        outcomes = frames.outcomes
        if outcomes is None:
            outcomes = coupon_outcomes(
                frames.once(purchases_of), frames.once(exposed_pairs), frames.offer_product,
                frames.products if CATEGORY in names else None)
        return even_join(exposed, outcomes, ["id", "offer_code"])

    @cache
    def customers() -> Rows:
        return Rows("customers", exposures(), F.lit(True), facts=frames.once(visits_of))

    @cache
    def shared() -> DataFrame:
        """Shared transactions in the groups of their exposed customers."""
        groups = list(dict.fromkeys(["id", *keys]))
        return even_join(frames.once(shared_visits_of), exposed.select(*groups).distinct(), ["id"], "inner")

    def shared_visits(period: str) -> Part:
        return Rows(f"shared_{period}", shared(), F.col(f"in_{period}"), counted="transaction_fid").ids()

    def outcome(name: str) -> Measure:
        return Measure(name, (Rows(OUTCOME_OF[name], exposures(), F.col(OUTCOME_OF[name])).ids(),))

    def category() -> Measure:
        missed = Rows("missed", exposures(), F.col("unbought") > 0)
        return Measure(CATEGORY, (missed.sum("unbought"),))

    def frequency(name: str) -> Measure:
        """Transactions of the group over the customers with transactions in any group."""
        period = PERIOD_OF[name]
        active = customers().ids_with(f"any_{period}")
        return Measure(
            name,
            (customers().weight(f"own_{period}"), shared_visits(period)),
            lambda own, shared, everyone: ratio(own + shared, everyone),
            totals=(active,),
            present=(active,),
        )

    def basket_with_offer() -> Measure:
        """Campaign transactions with a redeemed product over all of exposed customers'.

        The latter are the customers' own and the shared ones: both are counted already.
        """
        day = F.to_date("transaction_dttm").alias("day")
        lines = frames.items.filter("in_dur").select("id", "prod_code", "transaction_fid", day)
        used = (
            base.filter(stage_is(V.REDEEMED))
            .select("id", "prod_code", F.to_date("contact_cust_detail_dttm").alias("day"))
            .distinct()
        )
        with_offer = Rows(
            "with_offer", even_join(lines, used, ["id", "prod_code", "day"], "left_semi"), F.lit(True),
            counted="transaction_fid", overall=True)
        return scalar_row(
            BASKET, (with_offer.ids(), customers().weight("own_dur"), shared_visits("dur")),
            lambda used, own, shared: ratio(used, own + shared))

    available = {name: (lambda name=name: outcome(name)) for name in OUTCOME_OF}
    available |= {name: (lambda name=name: frequency(name)) for name in PERIOD_OF}
    available |= {CATEGORY: category, BASKET: basket_with_offer}
    return pick("customer_impact", available, names)
