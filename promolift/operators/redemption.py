"""Redemption: who redeemed, how often, and against whom was exposed."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.functions import vocabulary as V
from promolift.functions.columns import is_digital, is_paper, ratio, stage_is
from promolift.functions.joins import even_join
from promolift.operators.aggregates import scalar_row
from promolift.operators.facts import coupons_of, featured_buyers
from promolift.operators.modules import CampaignFrames, pick
from promolift.operators.rollup import Measure, Rows

NAMES = (
    "hh_redemeers",
    "number_of_redemptions",
    "correct_redemeers",
    "valid_redemption",
    "paper_redemeers",
    "digital_redemeers",
    "paper_trigered",
    "digital_trigered",
    "mailed_penetration",
    "overall_penetration",
    "mailed_participation",
    "redemption_rate",
    "response_rate",
    "coupon_redeem_per_hh",
    "index_vs_mailed",
)


def eligible_customers(cards: DataFrame, members: DataFrame) -> DataFrame:
    """Living, contactable customers in the home country."""
    eligible = cards.filter(
        ~F.substring("id", 2, 4).isin(*V.EXCLUDED_ID_BLOCKS)
        & F.col("card_termination_date").isNull()
        & (F.col("card_address_valid_flag") == "N")
        & (F.col("card_address_country_code") == V.HOME_COUNTRY)
        & (F.col("card_analyse_now_suppress_flag") == "")
        & (F.col("card_suppress_flag") == "N")
    )
    return eligible.join(members, F.col("mem_id") == F.col("id"), "left_semi").select("id")


def redemption_measures(
    frames: CampaignFrames, names: Iterable[str] | None = None, keys: Iterable[str] = ()
) -> list[Measure]:
    base = frames.base

    @cache
    def buyers() -> DataFrame:
        return frames.once(featured_buyers)

    redeemed = Rows("redeemed", base, stage_is(V.REDEEMED))
    exposed = Rows("exposed", base, stage_is(V.EXPOSED))
    on_paper = Rows("redeemed_paper", base, stage_is(V.REDEEMED) & is_paper())
    on_screen = Rows("redeemed_digital", base, stage_is(V.REDEEMED) & is_digital())
    paper_on = Rows("activated_paper", base, stage_is(V.ACTIVATED) & is_paper())
    screen_on = Rows("activated_digital", base, stage_is(V.ACTIVATED) & is_digital())

    @cache
    def mailed() -> Rows:
        return Rows("mailed", base, stage_is(V.EXPOSED), facts=buyers())

    @cache
    def correct() -> Rows:
        """Redemptions of a coupon the customer was exposed to."""
        exposed = frames.once(coupons_of).filter("exposed").select("id", "offer_code")
        rows = even_join(base.filter(stage_is(V.REDEEMED)), exposed, ["id", "offer_code"], "left_semi")
        return Rows("correct", rows, F.lit(True))

    def mailed_penetration() -> Measure:
        bought = mailed().ids_with("bought_featured")
        return Measure("mailed_penetration", (bought, mailed().ids()), ratio)

    def overall_penetration() -> Measure:
        universe = eligible_customers(frames.cards, frames.members)
        return scalar_row(
            "overall_penetration",
            (
                Rows("buyers", buyers(), F.lit(True), overall=True).ids(),
                Rows("universe", universe, F.lit(True), overall=True).ids(),
            ),
            ratio,
        )

    return pick("redemption", {
        "hh_redemeers": lambda: Measure("hh_redemeers", (redeemed.ids(),)),
        "number_of_redemptions": lambda: Measure(
            "number_of_redemptions", (redeemed.count("offer_code"),)
        ),
        "correct_redemeers": lambda: Measure("correct_redemeers", (correct().ids(),)),
        "valid_redemption": lambda: Measure("valid_redemption", (correct().count("id"),)),
        "paper_redemeers": lambda: Measure("paper_redemeers", (on_paper.ids(),)),
        "digital_redemeers": lambda: Measure("digital_redemeers", (on_screen.ids(),)),
        "paper_trigered": lambda: Measure("paper_trigered", (paper_on.count("offer_code"),)),
        "digital_trigered": lambda: Measure("digital_trigered", (screen_on.count("offer_code"),)),
        "mailed_penetration": mailed_penetration,
        "overall_penetration": overall_penetration,
        "mailed_participation": lambda: Measure(
            "mailed_participation", (mailed().ids_with("bought_featured"),)
        ),
        "redemption_rate": lambda: Measure(
            "redemption_rate", (redeemed.count("offer_code"), exposed.count("offer_code")), ratio
        ),
        "response_rate": lambda: Measure("response_rate", (redeemed.ids(), exposed.ids()), ratio),
        "coupon_redeem_per_hh": lambda: Measure(
            "coupon_redeem_per_hh", (redeemed.count("offer_code"), redeemed.ids()), ratio
        ),
        "index_vs_mailed": lambda: Measure(
            "index_vs_mailed",
            (redeemed.ids(), exposed.ids()),
            lambda redeemed, mailed, all_redeemed, all_mailed: ratio(
                ratio(redeemed, all_redeemed), ratio(mailed, all_mailed)
            ),
            totals=(redeemed.ids(), exposed.ids()),
        ),
    }, names)
