"""From raw tables to the frames the measures read."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from promolift.operators.enrich import enrich
from promolift.operators.facts import (
    coupon_facts,
    coupon_outcomes,
    exposed_pairs,
    held_transactions,
    purchase_counts,
    shared_transactions,
    visit_facts,
)
from promolift.operators.modules import CampaignFrames
from promolift.sources import sinks, tables
from promolift.sources.tables import Period


@dataclass(frozen=True)
class Campaign:
    """What identifies one campaign."""

    event_codes: tuple[str, ...]
    seg_week: str
    pre: Period
    during: Period
    post: Period

    @property
    def periods(self) -> dict[str, Period]:
        return {"pre": self.pre, "dur": self.during, "post": self.post}


def prepare(
    raw: Mapping[str, DataFrame], campaign: Campaign, with_products: bool = False, folder: str | None = None
) -> CampaignFrames:
    """Lazy frames of one campaign; nothing runs until a report is written or read.

    ``raw`` maps contact_header, contact_detail, offer_product, offer_dim,
    seg_lifestyle, seg_loyalty, seg_pricesense, cards, members, products,
    calendar, items, baskets and, for uplift, panel. With ``folder`` the contacts in
    scope are written there first, so what they are derived by and what they are
    enriched by are not on disk at a time.
    """
    calendar = tables.calendar_dim(raw["calendar"])
    cards = tables.card_dim(raw["cards"])
    products = tables.product_dim(raw["products"])
    segments = [
        tables.segment_snapshot(raw[name], campaign.seg_week)
        for name in ("seg_lifestyle", "seg_loyalty", "seg_pricesense")
    ]
    detail = tables.event_scope(raw["contact_detail"], campaign.event_codes)
    if folder is not None:
        detail = sinks.stage(detail, folder)
    base = enrich(
        detail=detail,
        header=tables.event_scope(raw["contact_header"], campaign.event_codes),
        segments=segments,
        cards=cards,
        calendar=calendar,
        offer_dim=raw["offer_dim"],
        seg_week=campaign.seg_week,
        products=products if with_products else None,
    )
    return CampaignFrames(
        base=base,
        offer_product=raw["offer_product"],
        items=tables.flagged_items(raw["items"], campaign.periods, calendar),
        baskets=tables.flagged_baskets(raw["baskets"], campaign.periods, calendar),
        cards=cards,
        members=tables.living_members(raw["members"]),
        products=products,
        panel=tables.test_panel(raw["panel"]) if "panel" in raw else None,
    )


def stage_frames(frames: CampaignFrames, folder: str | None = None) -> CampaignFrames:
    """Write what several reports share: the enriched contacts and facts about them.

    A report reads ``base`` once per kind of row it needs, and every read of a
    lazy ``base`` repeats its joins. The written table is partitioned by stage,
    so each measure only reads its own stages and columns. Coupon facts are what
    redemptions are looked up in. Purchase counts and visits are what is left of
    the transaction lines for all measures but the basket with an offer. Coupon
    outcomes are what customer impact looks up of purchases.
    """
    folder = folder or sinks.shared_folder(frames.base.sparkSession)
    staged = replace(
        frames, base=sinks.stage(frames.base, f"{folder}/base", ["contact_stage_code"])
    )
    staged = replace(staged, coupons=sinks.stage(coupon_facts(staged.base), f"{folder}/coupons"))
    if frames.items is not None:
        counts = purchase_counts(frames.items)
        held = sinks.stage(held_transactions(frames.items), f"{folder}/held")
        shared = sinks.stage(shared_transactions(held), f"{folder}/shared_visits")
        staged = replace(
            staged, purchases=sinks.stage(counts, f"{folder}/purchases"), shared_visits=shared,
            visits=sinks.stage(visit_facts(held, shared), f"{folder}/visits"))
        if frames.offer_product is not None and frames.products is not None:
            pairs = sinks.stage(exposed_pairs(staged), f"{folder}/exposed")
            outcomes = coupon_outcomes(staged.purchases, pairs, frames.offer_product, frames.products)
            staged = replace(staged, outcomes=sinks.stage(outcomes, f"{folder}/outcomes"))
    return staged
