"""A module is a family of measures over the same prepared frames."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from promolift.operators.rollup import Measure


@dataclass(frozen=True)
class CampaignFrames:
    """Everything the measures read.

    ``items`` and ``baskets`` carry ``in_pre``, ``in_dur`` and ``in_post``.
    Only ``base`` is needed by every module. ``purchases``, ``coupons``, ``visits``,
    ``shared_visits`` and ``outcomes`` hold facts where they were written once for
    several reports; elsewhere they are worked out from the other frames.
    """

    base: DataFrame
    offer_product: DataFrame | None = None
    items: DataFrame | None = None
    baskets: DataFrame | None = None
    cards: DataFrame | None = None
    members: DataFrame | None = None
    products: DataFrame | None = None
    panel: DataFrame | None = None
    purchases: DataFrame | None = None
    coupons: DataFrame | None = None
    visits: DataFrame | None = None
    shared_visits: DataFrame | None = None
    outcomes: DataFrame | None = None
    _made: dict = field(default_factory=dict, init=False, repr=False, compare=False)

    def once(self, make: Callable[[CampaignFrames], DataFrame]) -> DataFrame:
        """``make(self)``, the same frame each time, so that modules in one report share it."""
        if make not in self._made:
            self._made[make] = make(self)
        return self._made[make]


def pick(
    module: str, available: dict[str, Callable[[], Measure]], names: Iterable[str] | None
) -> list[Measure]:
    """The named measures, or all of them, in the order asked for."""
    names = list(available if names is None else names)
    unknown = [name for name in names if name not in available]
    if unknown:
        raise ValueError(
            f"unknown {module} measure(s) {unknown}; valid names: {sorted(available)}"
        )
    return [available[name]() for name in dict.fromkeys(names)]
