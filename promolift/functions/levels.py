"""Grouping levels: how a caller names them and how a report labels them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from promolift.functions import vocabulary as V

Level = tuple[str, ...]


def parse_level(level: str | Sequence[str]) -> Level:
    """Accept ``()``, ``("a", "b")``, ``"(a, b)"`` or a bare ``"a"``."""
    if isinstance(level, str):
        level = level.strip().removeprefix("(").removesuffix(")").split(",")
    names = (name.strip().strip("'\"") for name in level)
    return tuple(dict.fromkeys(name for name in names if name))


def parse_levels(levels: Iterable[str | Sequence[str]]) -> list[Level]:
    """Levels without repeats, in the order given."""
    return list(dict.fromkeys(parse_level(level) for level in levels))


def key_columns(levels: Iterable[Level]) -> list[str]:
    """All columns any level groups by, in first-seen order."""
    return list(dict.fromkeys(name for level in levels for name in level))


def level_name(level: Level) -> str:
    return "-".join(level) or V.OVERALL


def level_mask(level: Level, keys: list[str]) -> int:
    """Grouping id of a level: one bit per key, set where the key is not used."""
    mask = 0
    for key in keys:
        mask = mask * 2 + (key not in level)
    return mask


def null_labelled(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(V.NULL_KEY))


def total_labelled(column: Column) -> Column:
    """Keys are labelled before grouping, so NULL now means "not grouped by"."""
    return F.coalesce(column, F.lit(V.TOTAL_KEY))
