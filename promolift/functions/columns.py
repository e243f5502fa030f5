"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from promolift.functions import vocabulary as V


def stage_is(*stages: str) -> Column:
    return F.col("contact_stage_code").isin(*stages)


def is_digital() -> Column:
    return F.lower("channel_code").like("%digital%")


def is_paper() -> Column:
    return F.lower("channel_code").like("%paper%")


def is_targeted() -> Column:
    """Rows that cost money to target: activated digital, delivered otherwise.

    The channel test is case-sensitive and a NULL channel is never targeted.
    """
    digital = F.col("channel_code").like("%DIGITAL%")
    return (digital & stage_is(V.ACTIVATED)) | (~digital & stage_is(V.DELIVERED))


def is_unknown_id(column: str = "id") -> Column:
    value = F.col(column)
    return value.isNull() | (F.trim(value) == "") | (value == V.NULL_TEXT_ID)


def is_filled(column: str) -> Column:
    return F.trim(F.col(column)) != ""


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


def slot_segment(rank: Column, less_loyal: Column) -> Column:
    """Coupon-sheet segment of an offer rank; NULL inputs fall to the last name."""
    name, first, last = V.MAIN_SLOTS
    segment = F.when(rank.between(first, last) & (less_loyal != V.LESS_LOYAL_FLAG), name)
    name, first, last = V.LESS_LOYAL_SLOTS
    segment = segment.when(rank.between(first, last) & (less_loyal == V.LESS_LOYAL_FLAG), name)
    for name, first, last in V.COMMON_SLOTS:
        segment = segment.when(rank.between(first, last), name)
    return segment.otherwise(V.OTHER_SLOTS)


def age_band(birth_date: Column, on_date: Column) -> Column:
    """Age band at a date; ages stay fractional (days / 365)."""
    years = F.datediff(on_date, birth_date) / F.lit(365)
    (oldest, oldest_name), *younger = V.AGE_BANDS
    band = F.when(years > oldest, oldest_name)
    for older_than, name in younger:
        band = band.when(years > older_than, name)
    return band.otherwise(V.AGE_UNKNOWN)


def private_label(description: Column) -> Column:
    text = F.upper(description)
    private = any_of([text.contains(word) for word in V.PRIVATE_LABEL_WORDS])
    return F.when(private, V.PRIVATE).otherwise(V.NON_PRIVATE)


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def panel_arm(flag: str) -> Column:
    """Arm of a panel customer, 1 test and 0 control; a control flag Y or N does as well.

    Any other value stops the job with a message that names it.
    """
    text = F.upper(F.trim(F.col(flag).cast("string")))
    wrong = F.raise_error(F.concat(F.lit("panel flag must be 0, 1, Y or N, not "), text)).cast("int")
    return (
        F.when(text.isin("1", "N"), 1).when(text.isin("0", "Y"), 0)
        .when(text.isNull(), F.lit(None).cast("int")).otherwise(wrong)
    )
