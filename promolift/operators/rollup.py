"""Measures at many grouping levels in one pass per input frame.

A measure is built from *parts* (sums, counts, exact distinct counts) over named
rows of a frame. All parts over the same frame share one two-step aggregation:

1. grouping sets of every level plus the counted key; this leaves one row per
   (level, group, counted key) with a bit for each distinct count;
2. a sum of those flags per (level, group).

The input is expanded once per level, however many distinct counts are asked
for, and Spark combines on the map side before both shuffles. Since the counted
key is part of the first shuffle key, a group holding a third of all rows is
spread over the cluster, and a hot counted key is already reduced to one row per
group and map task. Parts of different frames meet by union before step 2, not
by one outer join per measure.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolift.functions import levels as L
from promolift.functions.columns import any_of
from promolift.sources.sinks import stage


@dataclass(frozen=True, eq=False)
class Rows:
    """The rows of ``frame`` that satisfy ``where``; ``label`` names them in plans.

    ``counted`` is the column whose distinct values ``ids`` counts. ``facts``
    holds extra attributes, at most one row per counted value; it is joined only
    after step 1, when the counted values are already collapsed. With
    ``overall`` the rows feed the overall row alone and need no key columns.
    """

    label: str
    frame: DataFrame
    where: Column
    counted: str = "id"
    facts: DataFrame | None = None
    overall: bool = False

    def sum(self, column: str) -> Part:
        return Part(self, "sum", column)

    def count(self, column: str) -> Part:
        """Rows in which ``column`` is not NULL."""
        return Part(self, "count", column)

    def ids(self) -> Part:
        """Distinct non-NULL counted values."""
        return Part(self, "ids")

    def ids_with(self, fact: str) -> Part:
        """Distinct counted values whose boolean ``fact`` is true."""
        return Part(self, "ids_with", fact)

    def weight(self, fact: str) -> Part:
        """Sum of the integer ``fact`` over distinct counted values."""
        return Part(self, "weight", fact)


@dataclass(frozen=True, eq=False)
class Part:
    rows: Rows
    kind: str
    column: str = ""

    @property
    def name(self) -> str:
        return f"_{self.rows.label}__{self.kind}__{self.column}"

    @property
    def needs_counted(self) -> bool:
        return self.kind in ("ids", "ids_with", "weight")

    @property
    def needs_facts(self) -> bool:
        return self.kind in ("ids_with", "weight")

    @property
    def hit(self) -> str:
        return f"_{self.rows.label}__hit"

    @property
    def seen(self) -> str:
        return f"_{self.rows.label}__seen"

    def matched(self) -> Column:
        """Whether a group holds any row behind this part."""
        return F.col(self.name) > 0 if self.needs_facts else F.col(self.seen) == 1


@dataclass(frozen=True, eq=False)
class Measure:
    """A report column: ``value`` turns its parts, then its totals, into a number.

    Totals are parts taken from the overall group. A group carries the measure
    only if every part in ``present`` (default: all parts) matched a row there;
    elsewhere the measure is 0, and a group that no measure carries is left out.
    An ``overall_only`` measure is shown in the overall row, asked for or not.
    """

    name: str
    parts: tuple[Part, ...]
    value: Callable[..., Column] = lambda part: part
    totals: tuple[Part, ...] = ()
    present: tuple[Part, ...] | None = None
    overall_only: bool = False

    def carried(self) -> Column:
        condition = F.lit(True)
        for part in self.parts if self.present is None else self.present:
            condition = condition & part.matched()
        return condition


def key_name(name: str) -> str:
    return f"_key_{name}"


#: Yes/no values kept in one number.
FLAGS_TOGETHER = 62


class Flags:
    """Yes/no conditions of the rows of one pass as bits of a few numbers.

    A group has a bit if any of its rows has it, so one ``bit_or`` stands for a
    maximum per condition, however many measures share the pass.
    """

    def __init__(self, number: int, conditions: dict[str, Column]) -> None:
        names = list(conditions)
        self._at = {
            name: (f"_bits_{number}_{place // FLAGS_TOGETHER}", place % FLAGS_TOGETHER)
            for place, name in enumerate(names)
        }
        bits: dict[str, Column] = {}
        for name, (column, place) in self._at.items():
            bit = F.when(conditions[name], F.lit(1 << place)).otherwise(0).cast("bigint")
            bits[column] = bits[column] + bit if column in bits else bit
        self.columns = bits

    def folds(self) -> dict[str, Column]:
        return {column: F.bit_or(column) for column in self.columns}

    def value(self, name: str) -> Column:
        """1 where the condition held in the group, else 0."""
        column, place = self._at[name]
        return F.shiftright(column, place).bitwiseAND(F.lit(1).cast("bigint"))


def _first_step(
    parts: list[Part], keys: list[str], sets: dict[int, L.Level], number: int
) -> tuple[DataFrame, Flags]:
    """Step 1 for the parts of one frame: level mask, labelled keys, part and flag columns."""
    rows = parts[0].rows
    counted = ["_counted"] if any(part.needs_counted for part in parts) else []
    by_label = {part.rows.label: part.rows.where for part in parts}

    columns = {key_name(key): L.null_labelled(F.col(key)) for key in keys}
    if counted:
        columns["_counted"] = F.col(rows.counted)
    folds: dict[str, Column] = {}
    conditions: dict[str, Column] = {}
    for part in parts:
        where = by_label[part.rows.label]
        conditions[part.seen] = where
        if part.needs_counted:
            conditions[part.hit] = where & F.col(rows.counted).isNotNull()
        elif part.kind == "sum":
            columns[part.name] = F.when(where, F.col(part.column))
            folds[part.name] = F.sum(part.name)
        else:
            columns[part.name] = F.when(where & F.col(part.column).isNotNull(), 1).otherwise(0)
            folds[part.name] = F.sum(part.name)
    flags = Flags(number, conditions)

    slim = rows.frame.filter(any_of(list(by_label.values()))).select(
        *[column.alias(name) for name, column in (columns | flags.columns).items()]
    )
    aggregates = [fold.alias(name) for name, fold in (folds | flags.folds()).items()]
    return _attach_facts(group_by_levels(slim, keys, sets, counted, aggregates), parts, flags), flags


def group_by_levels(
    slim: DataFrame,
    keys: list[str],
    sets: dict[int, L.Level],
    always: list[str],
    aggregates: list[Column],
) -> DataFrame:
    """Group labelled keys at every level, and by the ``always`` columns at each of them."""
    if len(sets) == 1:
        ((mask, level),) = sets.items()
        grouped = slim.groupBy(*[key_name(key) for key in level], *always).agg(*aggregates)
        return grouped.withColumn("_mask", F.lit(mask).cast("bigint"))
    wanted = [[key_name(key) for key in level] + always for level in sets.values()]
    return slim.groupingSets(wanted, *[key_name(key) for key in keys], *always).agg(
        F.shiftright(F.grouping_id(), len(always)).alias("_mask"), *aggregates
    )


def _attach_facts(grouped: DataFrame, parts: list[Part], flags: Flags) -> DataFrame:
    wanted = list(dict.fromkeys(part.column for part in parts if part.needs_facts))
    if wanted:
        rows = next(part.rows for part in parts if part.needs_facts)
        facts = rows.facts.select(F.col(rows.counted).alias("_counted"), *wanted)
        grouped = grouped.join(facts, "_counted", "left")
    values: dict[str, Column] = {}
    for part in parts:
        if part.kind == "ids":
            values[part.name] = flags.value(part.hit)
        elif part.kind == "ids_with":
            flagged = (flags.value(part.hit) == 1) & F.col(part.column)
            values[part.name] = F.when(flagged, 1).otherwise(0)
        elif part.kind == "weight":
            values[part.name] = F.when(flags.value(part.hit) == 1, F.coalesce(part.column, F.lit(0)))
        else:
            values[part.name] = F.col(part.name)
    keys = [name for name in grouped.columns if name.startswith("_key_")]
    return grouped.select(
        "_mask", *keys, *[value.alias(name) for name, value in values.items()], *flags.columns)


def _passes(parts: list[Part]) -> list[list[Part]]:
    """Parts that can share one pass: same frame, same counted column, one facts table."""
    shared: dict[tuple, list[Part]] = {}
    for part in parts:
        rows = part.rows
        shared.setdefault((id(rows.frame), rows.counted, rows.overall), []).append(part)
    for batch in shared.values():
        if len({id(part.rows.facts) for part in batch if part.needs_facts}) > 1:
            raise ValueError("rows of one frame must share one facts table")
    return list(shared.values())


def report(measures: Sequence[Measure], levels: Sequence, folder: str | None = None) -> DataFrame:
    """One row per level and group: key columns, ``grouping_level``, one column per measure.

    With ``folder`` the groups of each pass are written there when this is called,
    one pass after the other, so the shuffle files of only one pass exist at a time.
    """
    if not measures:
        raise ValueError("a report needs at least one measure")
    levels = L.parse_levels(levels)
    keys = L.key_columns(levels)
    spark = measures[0].parts[0].rows.frame.sparkSession
    overall = L.level_mask((), keys)

    sets = {L.level_mask(level, keys): level for level in levels}
    show_overall = () in levels or any(m.overall_only for m in measures)
    if show_overall or any(m.totals for m in measures):
        sets[overall] = ()

    parts = list({p.name: p for m in measures for p in (*m.parts, *m.totals, *(m.present or ()))}.values())
    steps, every_flag = [], []
    for number, batch in enumerate(_passes(parts)):
        wanted = ([], {overall: ()}) if batch[0].rows.overall else (keys, sets)
        step, flags = _first_step(batch, *wanted, number)
        if folder is not None:
            groups = [name for name in step.columns if name == "_mask" or name.startswith("_key_")]
            step = stage(step.groupBy(*groups).agg(
                *[F.sum(part.name).alias(part.name) for part in batch],
                *[fold.alias(name) for name, fold in flags.folds().items()]), f"{folder}/pass-{number}")
        steps.append(step)
        every_flag.append((batch, flags))
    if overall in sets:
        # An empty input must still give its overall row.
        spine = spark.range(0, 1, 1, 1).select(F.lit(overall).cast("bigint").alias("_mask"))
        steps.append(spine)

    partial = steps[0]
    for step in steps[1:]:
        partial = partial.unionByName(step, allowMissingColumns=True)
    key_names = [key_name(key) for key in keys]
    for name in key_names:
        if name not in partial.columns:
            partial = partial.withColumn(name, F.lit(None).cast("string"))
    groups = partial.groupBy("_mask", *key_names).agg(
        *[F.coalesce(F.sum(part.name), F.lit(0)).alias(part.name) for part in parts],
        *[fold.alias(name) for _, flags in every_flag for name, fold in flags.folds().items()],
    )
    groups = groups.withColumns({
        part.seen: flags.value(part.seen) for batch, flags in every_flag for part in batch})

    is_overall = F.col("_mask") == overall
    totals = list({p.name: p for m in measures for p in m.totals}.values())
    if totals:
        groups = _with_totals(groups, totals, is_overall, key_names)

    carried = [m.carried() for m in measures if not m.overall_only]
    shown = any_of(carried) if carried else F.lit(False)
    shown = (is_overall & F.lit(show_overall)) | (~is_overall & shown)
    return groups.filter(shown).select(
        *[L.total_labelled(F.col(key_name(key))).alias(key) for key in keys],
        level_names(levels, keys, show_overall).alias("grouping_level"),
        *[_value(m, is_overall, () in levels).alias(m.name) for m in measures],
    )


def _total(part: Part) -> str:
    return f"{part.name}__total"


def _with_totals(
    groups: DataFrame, totals: list[Part], is_overall: Column, key_names: list[str]
) -> DataFrame:
    """Put the overall values beside every group.

    The groups are dealt into as many buckets as the session shuffles into, with
    a copy of the overall row in each, so neither the groups are computed twice
    nor all of them meet in one task.
    """
    buckets = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = F.array(F.pmod(F.hash("_mask", *key_names), F.lit(buckets)))
    everywhere = F.sequence(F.lit(0), F.lit(buckets - 1))
    bucket = Window.partitionBy("_bucket")
    overall_value = lambda part: F.max(F.when(is_overall, F.col(part.name))).over(bucket)
    spread = groups.withColumn("_bucket", F.explode(F.when(is_overall, everywhere).otherwise(dealt)))
    spread = spread.select("*", *[overall_value(part).alias(_total(part)) for part in totals])
    return spread.filter(~is_overall | (F.col("_bucket") == 0))


def level_names(levels: list[L.Level], keys: list[str], show_overall: bool = False) -> Column:
    """Level names by mask; the same columns in two orders give a row for each name."""
    names: dict[int, list[str]] = {}
    for level in [*levels, *([()] if show_overall and () not in levels else [])]:
        names.setdefault(L.level_mask(level, keys), []).append(L.level_name(level))
    if all(len(same) == 1 for same in names.values()):
        chosen = F
        for mask, (name,) in names.items():
            chosen = chosen.when(F.col("_mask") == mask, name)
        return chosen
    chosen = F
    for mask, same in names.items():
        chosen = chosen.when(F.col("_mask") == mask, F.array(*[F.lit(name) for name in same]))
    return F.explode(chosen)


def _value(measure: Measure, is_overall: Column, overall_asked: bool) -> Column:
    values = [F.col(part.name) for part in measure.parts]
    values += [F.col(_total(part)) for part in measure.totals]
    value = measure.value(*values)
    if measure.overall_only:
        shown = is_overall
    elif overall_asked:
        shown = is_overall | measure.carried()
    else:
        shown = ~is_overall & measure.carried()
    return F.coalesce(F.when(shown, value), F.lit(0))
