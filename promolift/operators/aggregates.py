"""The levelled aggregates a caller can run on any frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolift.functions.columns import ratio
from promolift.operators.rollup import Measure, Part, Rows, report


def _all_rows(df: DataFrame, counted: str) -> Rows:
    return Rows("rows", df, F.lit(True), counted=counted)


def level_sum(df: DataFrame, levels: Sequence, measure: str, column: str) -> DataFrame:
    return report([Measure(measure, (_all_rows(df, column).sum(column),))], levels)


def level_count(df: DataFrame, levels: Sequence, measure: str, column: str) -> DataFrame:
    """Rows in which ``column`` is not NULL."""
    return report([Measure(measure, (_all_rows(df, column).count(column),))], levels)


def level_distinct_count(df: DataFrame, levels: Sequence, measure: str, column: str) -> DataFrame:
    return report([Measure(measure, (_all_rows(df, column).ids(),))], levels)


def level_average(
    df: DataFrame, levels: Sequence, measure: str, column: str, per: str
) -> DataFrame:
    """Sum of ``column`` over the rows in which ``per`` is not NULL."""
    rows = _all_rows(df, per)
    return report([Measure(measure, (rows.sum(column), rows.count(per)), ratio)], levels)


def level_distinct_average(
    df: DataFrame, levels: Sequence, measure: str, column: str, per: str
) -> DataFrame:
    """Sum of ``column`` over the distinct values of ``per``."""
    rows = _all_rows(df, per)
    return report([Measure(measure, (rows.sum(column), rows.ids()), ratio)], levels)


def level_distinct_count_average(
    df: DataFrame, levels: Sequence, measure: str, column: str, total: DataFrame | float
) -> DataFrame:
    """Distinct values of ``column`` over a total: a number or a one-cell frame."""
    return _over_total(measure, _all_rows(df, column).ids(), total, levels, ratio)


def level_count_average(
    df: DataFrame, levels: Sequence, measure: str, column: str, total: DataFrame | float
) -> DataFrame:
    return _over_total(measure, _all_rows(df, column).count(column), total, levels, ratio)


def level_percentage(
    df: DataFrame, levels: Sequence, measure: str, column: str, total: DataFrame | float
) -> DataFrame:
    return _over_total(measure, _all_rows(df, column).ids(), total, levels, percentage)


def percentage(count: Column, total: Column) -> Column:
    return ratio(count * 100, total)


def total_part(label: str, total: DataFrame) -> Part:
    """The single number of a one-row, one-column frame, for use as a measure total."""
    (column,) = total.columns
    return Rows(label, total, F.lit(True), overall=True).sum(column)


def _over_total(
    measure: str, part: Part, total: DataFrame | float, levels: Sequence, formula
) -> DataFrame:
    if isinstance(total, DataFrame):
        return report([Measure(measure, (part,), formula, totals=(total_part("total", total),))], levels)
    return report([Measure(measure, (part,), lambda count: formula(count, F.lit(total)))], levels)


def scalar_row(measure: str, parts: tuple[Part, ...], value=None) -> Measure:
    """A measure that exists for the campaign as a whole only."""
    if value is None:
        return Measure(measure, parts, overall_only=True)
    return Measure(measure, parts, value, overall_only=True)
