"""Cost of redeemed coupons and of targeting."""

from __future__ import annotations

from collections.abc import Iterable

from promolift.functions import vocabulary as V
from promolift.functions.columns import is_targeted, ratio, stage_is
from promolift.operators.modules import CampaignFrames, pick
from promolift.operators.rollup import Measure, Rows

NAMES = ("redemption_cost", "targeting_cost", "production_cost", "campaign_cost")


def cost_measures(
    frames: CampaignFrames, names: Iterable[str] | None = None, keys: Iterable[str] = ()
) -> list[Measure]:
    redeemed = Rows("redeemed", frames.base, stage_is(V.REDEEMED))
    targeted = Rows("targeted", frames.base, is_targeted())
    redemption = redeemed.sum("offer_discount_amt")
    targeting = targeted.sum("offer_amount")

    return pick("cost", {
        "redemption_cost": lambda: Measure("redemption_cost", (redemption,)),
        "targeting_cost": lambda: Measure("targeting_cost", (targeting,)),
        "production_cost": lambda: Measure("production_cost", (targeting, targeted.ids()), ratio),
        # Only groups that have both kinds of cost carry the total.
        "campaign_cost": lambda: Measure(
            "campaign_cost",
            (redemption, targeting),
            lambda redeemed, targeted: redeemed.cast("double") + targeted.cast("double"),
        ),
    }, names)
