"""Line deduplication with levelled runs of line hashes.

Documents are taken in batches of falling ``doc_id``. Each batch has a run, a
row per line key with the number of documents holding it and the largest of
their ids. A run first anti-joins the keys that are already settled, then is
added at level 0. When a level holds ``fan_in`` runs they are compacted into one
run of the next level; keys that have reached ``least_docs`` documents leave it
for the settled runs, because later batches only hold smaller ids and can no
longer change what becomes of them. At the end all runs, settled ones too, are
compacted once: an older run can hold the largest id of a settled key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolift.functions.joins import even_join
from promolift.llm.common import WHITE_BYTES, staged, whole_text

LEAST_CHARS, LEAST_DOCS = 20, 3
BATCHES, FAN_IN = 8, 4
KEY = ["h1", "h2"]


def trimmed_lines(text: Column) -> Column:
    """The lines of a text without white space at their ends."""
    return F.transform(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(WHITE_BYTES.decode())))


def lowered(line: Column) -> Column:
    """A to Z in lower case. Where no other letters are, the general way does that and is faster."""
    plain = F.octet_length(line) == F.length(line)
    return F.when(plain, F.lower(line)).otherwise(
        F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def line_keys(rows: DataFrame) -> DataFrame:
    """``doc_id, mark, place, h1, h2`` for each line long enough; places count from 1.

    ``mark`` tells rows with one ``doc_id`` and different texts apart.
    """
    lines = rows.select(
        "doc_id", F.xxhash64("text").alias("mark"),
        F.posexplode(trimmed_lines(whole_text())).alias("place", "line"))
    keyed = lines.where(F.length("line") >= LEAST_CHARS).select(
        "doc_id", "mark", (F.col("place") + 1).alias("place"), lowered(F.col("line")).alias("key"))
    return keyed.select(
        "doc_id", "mark", "place",
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineRuns:
    """The levelled store. Every run is a table in the shared folder."""

    def __init__(self, least_docs: int = LEAST_DOCS, fan_in: int = FAN_IN):
        self.least_docs, self.fan_in = least_docs, fan_in
        self.levels: list[list[DataFrame]] = []
        self.settled: DataFrame | None = None

    def add(self, run: DataFrame) -> None:
        """Add the run of the next batch: ``h1, h2, n_docs, keeper``."""
        if self.settled is not None:
            run = run.join(self.settled.select(*KEY), KEY, "left_anti")
        self._push(run, 0)

    def _push(self, run: DataFrame, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan_in:
            merged = self._compact(self.levels[level])
            self.levels[level] = []
            self._push(merged, level + 1)

    def _compact(self, runs: list[DataFrame]) -> DataFrame:
        """Merge runs; move the keys that have enough documents to the settled run."""
        table = self._merge(runs)
        done = table.where(F.col("n_docs") >= self.least_docs)
        self.settled = done if self.settled is None else self.settled.unionByName(done)
        return table.where(F.col("n_docs") < self.least_docs)

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        merged = reduce(DataFrame.unionByName, runs).groupBy(*KEY).agg(
            F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
        return staged(merged.sortWithinPartitions(*KEY), "compacted")

    def finish(self) -> DataFrame:
        """The keys with enough documents and their keeper. At least one run was added."""
        runs = [run for level in self.levels for run in level]
        if self.settled is not None:
            runs.append(self.settled)
        return self._merge(runs).where(F.col("n_docs") >= self.least_docs)


def batched_runs(docs: DataFrame, batches: int) -> list[DataFrame]:
    """One run per batch of falling ids, all made in a single pass over the texts.

    Bounds are approximate quantiles of the ids: they only decide the sizes of
    the batches, never the result. Rows without id form the last batch.
    """
    shares = [i / batches for i in range(1, batches)]
    bounds = sorted(set(docs.approxQuantile("doc_id", shares, 0.01)))
    number = sum(
        (F.when(F.col("doc_id") < bound, 1).otherwise(0) for bound in bounds), F.lit(0))
    batch = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(number)
    # A key counts once for each document.
    keys = docs.select("doc_id", "text").withColumn(
        "keys", F.array_distinct(F.transform(
            F.filter(trimmed_lines(whole_text()), lambda line: F.length(line) >= LEAST_CHARS), lowered)))
    rows = keys.select("doc_id", batch.alias("batch"), F.explode("keys").alias("key")).select(
        "batch", "doc_id", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    runs = rows.groupBy("batch", *KEY).agg(
        F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
    table = staged(runs, "runs")
    return [table.where(F.col("batch") == i).drop("batch") for i in range(len(bounds) + 2)]


def settled_keys(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Keys of at least three documents and the largest id that holds each."""
    store = LineRuns()
    for run in batched_runs(docs, batches):
        store.add(run)
    return store.finish()


def line_dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped, kept_text`` for every row.

    Null and empty texts are one empty line. Rows with one ``doc_id`` count as
    documents of their own and keep a line together; rows without id count as
    smaller than any id. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    dead = settled_keys(docs, batches)
    hits = even_join(line_keys(docs), dead.select(*KEY, "keeper"), KEY, "inner")
    dropped = (
        hits.where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("place")).alias("dropped"))
    )
    marked = docs.withColumn("mark", F.xxhash64("text"))
    on = marked["doc_id"].eqNullSafe(dropped["doc_id"]) & (marked["mark"] == dropped["mark"])
    joined = marked.join(dropped, on, "left").select(
        marked["doc_id"], marked["text"],
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
        F.split(whole_text(marked["text"]), "\n", -1).alias("lines"))
    # The kept lines are the stretches between dropped ones: one slice for each.
    ends = F.concat("dropped", F.array((F.size("lines") + 1)))
    kept = F.zip_with(
        F.concat(F.array(F.lit(0)), "dropped"), ends,
        lambda start, end: F.slice("lines", start + 1, end - start - 1))
    return joined.select(
        "doc_id", "text", F.size("lines").cast("bigint").alias("n_lines"),
        F.size("dropped").cast("bigint").alias("n_dropped"),
        F.array_join(F.flatten(kept), "\n").alias("kept_text"))
