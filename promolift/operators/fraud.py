"""Fraud: coupons redeemed by the wrong customer, too often or on the wrong product."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.functions import vocabulary as V
from promolift.functions.columns import is_digital, is_paper, is_unknown_id, stage_is
from promolift.functions.joins import even_join
from promolift.operators.aggregates import scalar_row
from promolift.operators.facts import coupons_of, customer_arms, featured_buyers
from promolift.operators.modules import CampaignFrames, pick
from promolift.operators.rollup import Measure, Rows

NAMES = (
    "bad_redeemers",
    "control_redeemers",
    "non_cc_malredemptions",
    "control_participation",
    "mis_redemptions",
    "app_multi_redeemers",
    "dm_multi_redeemers",
    "app_dm_multi_redeemers",
    "mal_redemptions",
)


#: Measures that need to know a customer's arms but nothing of other redemptions or exposures.
ARMS_ONLY = {"control_redeemers", "non_cc_malredemptions", "mis_redemptions", "control_participation"}


def redemptions(frames: CampaignFrames, keys: Iterable[str], with_coupons: bool = True) -> DataFrame:
    """Redemptions with their number ``n``, their coupon's facts and the customer's arm.

    The arm is the one the customer was allocated to; a customer allocated to
    both has every redemption twice. Equal redemptions are collapsed before
    anything is joined, so one coupon or one unknown card holding most of the
    redemptions leaves few rows. ``listed`` is NULL where the offer does not have
    the product. All redemption measures are conditions on these rows.
    """
    redeemed = frames.base.filter(stage_is(V.REDEEMED)).drop("event_control_flag")
    kept = dict.fromkeys(("id", "offer_code", "prod_code", "channel_code", *keys))
    kept.pop("event_control_flag", None)
    rows = redeemed.groupBy(*kept).agg(F.count("*").alias("n"))
    if with_coupons:
        rows = even_join(rows, frames.once(coupons_of), ["id", "offer_code"], null_safe=True)
    else:
        rows = even_join(rows, customer_arms(frames.base), ["id"])
    listed = frames.offer_product.select("prod_code", "offer_code").distinct()
    rows = even_join(rows, listed.withColumn("listed", F.lit(True)), ["prod_code", "offer_code"])
    return rows.withColumn("arm", F.explode_outer("arms")).select(
        *[name for name in rows.columns if name != "arms"], "arm.event_control_flag")


def bad_coupons(frames: CampaignFrames) -> DataFrame:
    """Coupons of known customers with ``n_bad``: 1 each for unexposed and for repeated."""
    unexposed, repeated = ~F.col("exposed"), F.col("n_coupon") > 1
    return frames.once(coupons_of).filter(~is_unknown_id()).withColumn(
        "n_bad", unexposed.cast("int") + repeated.cast("int"))


def fraud_measures(
    frames: CampaignFrames, names: Iterable[str] | None = None, keys: Iterable[str] = ()
) -> list[Measure]:
    names = list(NAMES if names is None else names)
    if any(name != "control_participation" for name in names):
        rows = redemptions(frames, keys, with_coupons=not ARMS_ONLY.issuperset(names))
    else:
        rows = frames.base
    real_product = F.col("prod_code").isNotNull() & F.col("offer_code").isNotNull()

    @cache
    def bad() -> Rows:
        return Rows("bad", bad_coupons(frames), F.col("n_bad") > 0, overall=True)

    def misplaced() -> Rows:
        return Rows("misplaced", rows, real_product & F.col("listed").isNull())

    control = Rows("control", rows, F.col("event_control_flag") == V.CONTROL_FLAG)
    unknown = Rows("unknown", rows, is_unknown_id())

    def again(label: str, condition) -> Measure:
        """A coupon without customer or offer is never redeemed again."""
        named = F.col("id").isNotNull() & F.col("offer_code").isNotNull()
        return Measure(label, (Rows(label, rows, named & condition).ids(),))

    def control_participation() -> Measure:
        in_control = stage_is(V.ALLOCATED) & (F.col("event_control_flag") == V.CONTROL_FLAG)
        buyers = frames.once(featured_buyers)
        shoppers = Rows("control_shoppers", frames.base, in_control, facts=buyers)
        return Measure("control_participation", (shoppers.ids_with("bought_featured"),))

    return pick("fraud", {
        "bad_redeemers": lambda: scalar_row("bad_redeemers", (bad().ids(),)),
        "control_redeemers": lambda: Measure("control_redeemers", (control.ids(),)),
        "non_cc_malredemptions": lambda: scalar_row("non_cc_malredemptions", (unknown.sum("n"),)),
        "control_participation": control_participation,
        "mis_redemptions": lambda: Measure("mis_redemptions", (misplaced().sum("n"),)),
        "app_multi_redeemers": lambda: again(
            "app_multi_redeemers", is_digital() & (F.col("n_digital") > 1)),
        "dm_multi_redeemers": lambda: again(
            "dm_multi_redeemers", is_paper() & (F.col("n_paper") > 1)),
        "app_dm_multi_redeemers": lambda: again(
            "app_dm_multi_redeemers", (F.col("n_digital") > 0) & (F.col("n_paper") > 0)),
        "mal_redemptions": lambda: scalar_row("mal_redemptions", (bad().sum("n_bad"),)),
    }, names)
