"""Quality rules whose cutoffs come from quantile sketches of the corpus.

For every language and source a mergeable sketch of each measure is kept: the
number of documents in bins of equal width. Sketches of sources add up to those
of their language, and these to that of the corpus. A cutoff is the upper
quartile plus ``fence`` times the spread between the quartiles (never less than
``least_spread``), as for the whiskers of a box plot: it follows what is usual
in a source, and an ordinary source loses no fixed share of its documents.
Groups with fewer than ``least_group`` documents use the sketch of their
language, languages with fewer that of the corpus.

Repeated lines count per line, the least spreads lie inside what the base rule
leaves, and words can also be too short for their source, so that every measure
can reject a text. Bins of large values grow as powers: each value has one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolift.llm.common import WHITE_BYTES, staged

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_lines"]


class Measure(NamedTuple):
    """A share in bins, and the least spread that its cutoffs are apart from the quartiles."""

    numerator: str
    denominator: str
    bins_per_unit: int
    least_spread: int
    #: Least spread of a lower cutoff; None where no value is too low.
    least_below: int | None = None


Measures = dict[str, Measure]
MEASURES: Measures = {
    "word_length": Measure("word_chars", "n_words", 20, 20, 10),
    "symbols": Measure("n_symbols", "n_words", 200, 10),
    "dup_lines": Measure("n_dup_lines", "n_lines", 100, 10),
    "repeats": Measure("n_repeat_words", "n_words", 100, 5),
}
#: Bins up to here are of equal width; beyond, so many for each doubling.
EQUAL_BINS, BINS_OF_DOUBLE = 1000, 100
FENCE, LEAST_GROUP = 4, 50


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    n = len(words)
    if n <= width:
        return 0
    vocabulary = {word: number for number, word in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(vocabulary.__getitem__, words), np.uint64, n)
    if len(vocabulary) == n:
        return 0
    size = n - width + 1
    hashes = np.zeros(size, np.uint64)
    for offset in range(width):
        hashes = (hashes + ids[offset:offset + size] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    # Equal hashes are compared word by word before they count.
    left, right = order[:-1][same], order[1:][same]
    equal = np.ones(len(left), bool)
    for offset in range(width):
        equal &= ids[left + offset] == ids[right + offset]
    marks = np.zeros(n + 1, np.int64)
    found = np.unique(np.concatenate([left[equal], right[equal]]))
    marks[found] += 1
    marks[found + width] -= 1
    return int((np.cumsum(marks[:n]) > 0).sum())


def counted(text: str | None) -> tuple[int, ...]:
    """The counts of a text in the order of ``COUNTS``."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode()
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - (len(data) - len(data.translate(None, WHITE_BYTES))),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def measured(text: str | None) -> tuple[int, ...]:
    return counted(text)[:len(BASE)]


def _measure_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts = np.array([counted(text) for text in batch.pop("text")], np.int64)
        for place, name in enumerate(COUNTS):
            batch[name] = counts.reshape(-1, len(COUNTS))[:, place]
        yield batch


def with_measures(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` (scalar columns) and the counts of the column ``text``."""
    narrow = rows.select(*keys, "text")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema if f.name != "text"]
    schema = ", ".join([*fields, *(f"{name} bigint" for name in COUNTS)])
    return narrow.mapInPandas(_measure_batches, schema)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def bin_of(measure: Measure) -> Column:
    """The bin of a measure; integer arithmetic up to ``EQUAL_BINS``, so every engine agrees."""
    value = F.expr(
        f"({measure.bins_per_unit} * {measure.numerator}) div greatest({measure.denominator}, 1)")
    above = EQUAL_BINS + F.floor(BINS_OF_DOUBLE * F.log2(value / EQUAL_BINS))
    return F.when(value > EQUAL_BINS, above).otherwise(value).cast("bigint")


def sketches(counts: DataFrame, measures: Measures = MEASURES) -> DataFrame:
    """Mergeable sketches: documents per language, source, measure and bin.

    Only documents that pass the fixed base rules shape the cutoffs.
    """
    return (
        counts.where(~base_failed())
        .select("lang", "source", F.explode(F.array(*[
            F.struct(F.lit(name).alias("measure"), bin_of(m).alias("bin")) for name, m in measures.items()
        ])).alias("cell"))
        .groupBy("lang", "source", "cell.measure", "cell.bin").agg(F.count("*").alias("n"))
    )


def _limits(sketch: DataFrame, group: list[str], measures: Measures) -> DataFrame:
    """Cutoffs (``low``, ``high``) of each measure and group from the merged bins of the group."""
    merged = sketch.groupBy(*group, "measure", "bin").agg(F.sum("n").alias("n"))
    bins = merged.groupBy(*group, "measure").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    quantile = lambda share: F.expr(  # noqa: E731 - the first bin at which the share is reached
        f"""aggregate(bins, named_struct('seen', 0L, 'at', cast(null as bigint)), (a, b) -> named_struct(
            'seen', a.seen + b.n,
            'at', case when a.at is null and 4 * (a.seen + b.n) >= {share} * n then b.bin else a.at end)).at""")
    least = lambda field: F.create_map(*[  # noqa: E731 - null where a measure has none
        x for name, m in measures.items() for x in (F.lit(name), F.lit(getattr(m, field)).cast("bigint"))
    ])[F.col("measure")]
    wide = F.col("q3") - F.col("q1")
    high = F.col("q3") + FENCE * F.greatest(wide, least("least_spread"))
    low = F.when(least("least_below").isNotNull(), F.col("q1") - FENCE * F.greatest(wide, least("least_below")))
    return bins.withColumns({"q1": quantile(1), "q3": quantile(3)}).select(
        *group, "measure", "n", F.struct(
            low.cast("bigint").alias("low"), high.cast("bigint").alias("high")).alias("ends"))


def thresholds(sketch: DataFrame, measures: Measures = MEASURES) -> DataFrame:
    """A row of cutoffs for each language and source, from the sketch that is large enough."""
    own = _limits(sketch, ["lang", "source"], measures)
    language = _limits(sketch, ["lang"], measures).select(
        F.col("lang").alias("of"), "measure", F.col("n").alias("lang_n"), F.col("ends").alias("lang_ends"))
    everything = _limits(sketch, [], measures).select("measure", F.col("ends").alias("all_ends"))
    same = (own["measure"] == language["measure"]) & own["lang"].eqNullSafe(language["of"])
    long = own.join(language, same).drop(language["measure"]).join(everything, "measure")
    ends = (
        F.when(F.col("n") >= LEAST_GROUP, F.col("ends"))
        .when(F.col("lang_n") >= LEAST_GROUP, F.col("lang_ends")).otherwise(F.col("all_ends")))
    return long.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("measure") == name, ends)).alias(f"ends_{name}") for name in measures])


def judged(counts: DataFrame, limits: DataFrame, measures: Measures = MEASURES) -> DataFrame:
    """Add ``base_failed`` and ``kept``.

    The join leaves its strategy to Spark: a small table of cutoffs is broadcast
    after its size is known, a large one meets split partitions of a hot source.
    """
    outside = F.lit(False)
    for name, m in measures.items():
        for beyond in (bin_of(m) > F.col(f"ends_{name}.high"), bin_of(m) < F.col(f"ends_{name}.low")):
            outside = outside | F.coalesce(beyond, F.lit(False))
    on = counts["lang"].eqNullSafe(limits["lang"]) & counts["source"].eqNullSafe(limits["source"])
    joined = counts.join(limits, on, "left").drop(limits["lang"]).drop(limits["source"])
    return joined.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & ~outside).drop(*[f"ends_{name}" for name in measures])


def quality(docs: DataFrame, measures: Measures = MEASURES) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed`` and ``kept`` for every row.

    Null and empty texts have no words and fail; null languages and sources form
    groups of their own. Repeated rows are judged alike.
    """
    counts = staged(with_measures(docs, ["doc_id", "lang", "source"]), "measures")
    limits = thresholds(sketches(counts, measures), measures)
    return judged(counts, limits, measures).select(
        "doc_id", *BASE, "base_failed", "kept")


def keep_good(docs: DataFrame, measures: Measures = MEASURES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, whatever their names."""
    numbered = staged(
        docs.select(F.struct("*").alias("whole"), F.monotonically_increasing_id().alias("row")),
        "documents")
    narrow = numbered.select("row", "whole.lang", "whole.source", "whole.text")
    counts = staged(with_measures(narrow, ["row", "lang", "source"]), "measures")
    limits = thresholds(sketches(counts, measures), measures)
    kept = judged(counts, limits, measures).where("kept").select("row")
    return numbered.join(kept, "row", "left_semi").select("whole.*")
