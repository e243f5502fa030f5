"""Language-model scores from an n-gram trie in Elias-Fano levels.

A model of word pairs with a Dirichlet prior: the probability of a word after
another is (pairs + MU * p(word)) / (number of the first + MU), where p is the
add-one estimate of single words. It is stored per pair seen in training, as a
16-bit code of its logarithm; every other pair has the same formula without its
first term, for which the counts of words are enough.

Word ids are ranks by falling count. So the count of a word follows from its id
by a table with one entry for each different count, and these are at most
sqrt(2 * tokens): the one thing every task holds. Texts become chunks of ids;
words, pairs and questions travel as packed arrays, one row for each chunk and
shard. Pairs are dealt by their first word, a frequent one in several parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolift.llm.common import discard, spread, staged
from promolift.llm.elias_fano import Trie

MU = 200.0
#: Steps of a code for each unit of the decimal logarithm.
STEPS, MOST_CODE = 4096, 65535
#: A chunk ends with the text that reaches one of these.
CHUNK_TOKENS, CHUNK_WORDS = 1 << 20, 1 << 19
#: Rows taken from an Arrow batch at a time.
TAKEN = 256
#: The token after each text; no word is empty.
END = b""
U = np.uint64


def squeeze(array: np.ndarray) -> bytes:
    """Numbers as compressed bytes, equal places of all numbers together."""
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + (pa.Codec("zstd", 1).compress(planes, asbytes=True) if planes else b"")


def unsqueeze(data: bytes, kind: str) -> np.ndarray:
    size, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).reshape(-1)


def joined(words: list[bytes]) -> bytes:
    return squeeze(np.frombuffer(b"\n".join(words), np.uint8))


def parted(data: bytes) -> list[bytes]:
    return unsqueeze(data, "u1").tobytes().split(b"\n")


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


CHUNK = "chunk bigint, docs binary, named binary, training binary, lens binary"
WORDS = "shard int, words binary, counts binary"


def chunked(docs: DataFrame, training: Column) -> tuple[DataFrame, DataFrame]:
    """Chunks of texts with words numbered per chunk, and the words of each chunk by shard.

    Words are the runs of bytes between white space, A-Z lower-cased.
    """
    shards = spread(docs.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            chunk, made = (task << 24) + made, made + 1
            taught = np.repeat(np.array(learnt, bool), lens)
            codes = np.concatenate(parts)
            counts = np.bincount(codes[taught], minlength=len(numbers))
            words = list(numbers)
            own = np.fromiter((zlib.crc32(word) % shards for word in words), np.int64, len(words))
            by_word = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
            order = by_word[np.argsort(own[by_word], kind="stable")]
            cuts = np.searchsorted(own[order], np.arange(shards + 1))
            rows = [{"chunk": chunk, "docs": squeeze(np.array(ids, "<i8")), "named": squeeze(np.array(named, "u1")),
                     "training": squeeze(np.array(learnt, "u1")), "lens": squeeze(np.array(lens, "<u4")),
                     "codes": squeeze(codes.astype("<u4")), "order": squeeze(order.astype("<u4")),
                     "taught": int(sum(learnt)), "shard": None, "words": None, "counts": None}]
            for shard in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[shard]:cuts[shard + 1]]
                rows.append({"chunk": chunk, "shard": int(shard), "words": joined([words[i] for i in at]),
                             "counts": squeeze(counts[at].astype("<u4"))})
            return pa.RecordBatch.from_pylist(rows, SCHEMA)

        numbers, ids, named, learnt, lens, parts, size = Numbers(), [], [], [], [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, TAKEN):
                for doc, text, taught in zip(*batch.slice(start, TAKEN).to_pydict().values(), strict=True):
                    words = (text or "").encode().lower().split()
                    words.append(END)
                    parts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                    ids.append(doc or 0)
                    named.append(doc is not None)
                    learnt.append(bool(taught))
                    lens.append(len(words))
                    size += len(words)
                    if size >= CHUNK_TOKENS or len(numbers) >= CHUNK_WORDS:
                        yield flush()
                        numbers, ids, named, learnt, lens, parts, size = Numbers(), [], [], [], [], [], 0
        if lens:
            yield flush()

    binary = pa.binary()
    SCHEMA = pa.schema([
        ("chunk", pa.int64()), *((n, binary) for n in ("docs", "named", "training", "lens", "codes", "order")),
        ("taught", pa.int64()), ("shard", pa.int32()), ("words", binary), ("counts", binary)])
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", training.alias("taught"))
    table = staged(rows.mapInArrow(
        build, f"{CHUNK}, codes binary, order binary, taught bigint, {WORDS}"), "chunks")
    words = table.where("shard is not null").select("chunk", "shard", "words", "counts")
    chunks = table.where("shard is null").drop("shard", "words", "counts")
    chunks.staged_folder = table.staged_folder
    return chunks, words


@dataclass
class Counts:
    """Different counts of words, falling; the first id of each; known words, tokens, texts."""

    counts: np.ndarray
    starts: np.ndarray
    words: int
    tokens: int
    texts: int

    @property
    def unknown(self) -> int:
        return self.words

    @property
    def begin(self) -> int:
        """The id of what comes before the first word of a text."""
        return self.words + 1

    @property
    def base(self) -> int:
        return self.words + 2

    def of(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        known = ids < self.words
        if self.words:
            out[known] = self.counts[np.searchsorted(self.starts, ids[known], side="right") - 1]
        out[ids == self.begin] = self.texts
        return out

    def single(self, ids: np.ndarray) -> np.ndarray:
        """Add-one probabilities of words."""
        return (self.of(ids) + 1) / (self.tokens + self.words + 1)

    def codes(self, before: np.ndarray, ids: np.ndarray, pairs: np.ndarray | int) -> np.ndarray:
        """Codes of pairs that were seen (from 1 on) or not (from 0 on)."""
        share = (pairs + MU * self.single(ids)) / (self.of(before) + MU)
        return np.clip(np.rint(-STEPS * np.log10(share)), np.minimum(pairs, 1), MOST_CODE).astype(np.int64)

    def shard(self, before: np.ndarray, ids: np.ndarray, shards: int) -> np.ndarray:
        """Where a pair is kept; a word that is a large part of all tokens has several shards."""
        parts = (1 + 4 * shards * self.of(before) // max(self.tokens, 1)).astype(U)
        part = (ids.astype(U) * U(0x9E3779B97F4A7C15) >> U(32)) % parts
        mixed = (before.astype(U) * U(0xC2B2AE3D27D4EB4F) + part * U(0x165667B19E3779F9)) ^ U(0x27D4EB2F165667C5)
        return ((mixed * U(0x9E3779B97F4A7C15) >> U(33)) % U(shards)).astype(np.int64)


@dataclass
class Lexicon:
    """``shard, words, counts, starts``: the words of each shard by falling count; and the table of counts."""

    table: DataFrame
    counts: Counts


def build_lexicon(chunks: DataFrame, words: DataFrame) -> Lexicon:
    """Words of the training texts, in ids by falling count, then shard, then word."""
    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made() -> pd.DataFrame:
            known = sorted((-count, word) for word, count in total.items() if count)
            return pd.DataFrame([{
                "shard": here, "words": joined([word for _, word in known]) if known else None,
                "counts": squeeze(np.array([-count for count, _ in known], "<i8"))}])

        here, total = None, {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.shard != here:
                    if here is not None:
                        yield made()
                    here, total = row.shard, {}
                for word, count in zip(parted(row.words), unsqueeze(row.counts, "<u4").tolist(), strict=True):
                    total[word] = total.get(word, 0) + count
        if here is not None:
            yield made()

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                counts, n = np.unique(unsqueeze(row.counts, "<i8"), return_counts=True)
                yield pd.DataFrame({"shard": row.shard, "count": counts, "n": n})

    dealt = words.select("shard", "words", "counts").repartition("shard").sortWithinPartitions("shard")
    table = staged(dealt.mapInPandas(merge, "shard int, words binary, counts binary"), "lexicon")
    sizes = staged(table.select("shard", "counts").mapInPandas(histogram, "shard int, count bigint, n bigint"), "sizes")
    # At most sqrt(2 * tokens) rows, as each different count takes as many tokens.
    steps = sorted(((r["count"], r["n"]) for r in sizes.groupBy("count").agg(F.sum("n").alias("n")).collect()), reverse=True)
    counts = np.array([count for count, _ in steps], np.int64)
    numbers = np.array([n for _, n in steps], np.int64)
    texts = chunks.agg(F.sum("taught")).head()[0] or 0
    found = Counts(counts, np.append(0, np.cumsum(numbers))[:-1].astype(np.int64), int(numbers.sum()),
                   int((counts * numbers).sum()), int(texts))
    if found.base >= 1 << 32:
        raise OverflowError("pairs of word ids have 64 bits: at most 2^32 different words")
    earlier = Window.partitionBy("count").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).groupBy("shard").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("minus"), "before"))).alias("starts"))
    return Lexicon(table.join(starts, "shard").select(
        "shard", "words", "counts", F.col("starts.before").alias("starts")), found)


def numbered(chunks: DataFrame, words: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The chunks with the lexicon's ids (``ids``), staged; words it lacks have the id ``unknown``."""
    counts = lexicon.counts

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, ids = None, {}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.kind == 0:
                    here = row.shard
                    each = unsqueeze(row.counts, "<i8")
                    firsts = np.flatnonzero(np.append(True, each[1:] != each[:-1]))
                    group = np.cumsum(np.append(0, each[1:] != each[:-1]))
                    start = counts.starts[np.searchsorted(-counts.counts, -each[firsts])] + np.array(row.starts, np.int64)
                    known = start[group] + np.arange(len(each)) - firsts[group]
                    ids = dict(zip(parted(row.words), known.tolist(), strict=True))
                    continue
                known = ids if row.shard == here else {}
                out.append({"chunk": row.chunk, "shard": row.shard, "ids": squeeze(np.array(
                    [known.get(word, counts.unknown) for word in parted(row.words)], "<u4"))})
            if out:
                yield pd.DataFrame(out)

    held = lexicon.table.where("words is not null").select(
        F.lit(None).cast("bigint").alias("chunk"), "shard", "words", "counts", "starts", F.lit(0).alias("kind"))
    asked = words.select(
        "chunk", "shard", "words", F.lit(None).cast("binary").alias("counts"),
        F.lit(None).cast("array<bigint>").alias("starts"), F.lit(1).alias("kind"))
    answers = held.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind").mapInPandas(
        answer, "chunk bigint, shard int, ids binary")
    per_chunk = answers.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("shard", "ids"))).alias("found"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                codes, order, found = (one.column(i)[0].as_py() for i in (5, 6, 7))
                ids = np.zeros(0, "<u4") if not found else np.concatenate([unsqueeze(f["ids"], "<u4") for f in found])
                of_code = np.empty(len(ids), "<u4")
                of_code[unsqueeze(order, "<u4")] = ids
                tokens = squeeze(of_code[unsqueeze(codes, "<u4")])
                yield pa.RecordBatch.from_arrays(
                    [*(one.column(i) for i in range(5)), pa.array([tokens], pa.binary())],
                    [*batch.schema.names[:5], "ids"])

    whole = chunks.drop("taught").join(per_chunk, "chunk")
    names = [name.split()[0] for name in CHUNK.split(", ")]
    return staged(whole.select(*names, "codes", "order", "found").mapInArrow(number, f"{CHUNK}, ids binary"), "tokens")


def pairs_of(counts: Counts, ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id before each token and the pair as one number."""
    before = np.empty(len(ids), U)
    before[1:] = ids[:-1]
    before[(np.cumsum(lens) - lens).astype(np.int64)] = counts.begin
    return before, before * U(counts.base) + ids.astype(U)


def by_shard(counts: Counts, keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of rising pairs by shard, and where each shard begins."""
    before, ids = np.divmod(keys, U(counts.base))
    shard = counts.shard(before, ids, shards)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def rising(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=U(0)))


def unrisen(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, "<u8"), dtype=U)


@dataclass
class Model:
    """``shard, image``: a trie for each shard, staged; the table of word counts; how many shards."""

    tries: DataFrame
    counts: Counts
    shards: int


def each_row(batches: Iterator[pd.DataFrame], make) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            rows = make(row)
            if rows:
                yield pd.DataFrame(rows)


def build_model(tokens: DataFrame, lexicon: Lexicon) -> Model:
    """Tries of the pairs in training texts."""
    counts, shards = lexicon.counts, spread(tokens.sparkSession)

    def count(row) -> list[dict]:
        lens = unsqueeze(row.lens, "<u4")
        taught = np.repeat(unsqueeze(row.training, "u1").astype(bool), lens)
        _, pairs = pairs_of(counts, unsqueeze(row.ids, "<u4"), lens)
        keys, n = np.unique(pairs[taught], return_counts=True)
        order, cuts = by_shard(counts, keys, shards)
        return [{"shard": int(s), "pairs": rising(keys[at]), "n": squeeze(n[at].astype("<u4"))}
                for s in np.flatnonzero(np.diff(cuts)) for at in [order[cuts[s]:cuts[s + 1]]]]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made() -> pd.DataFrame:
            keys, n = np.concatenate(parts), np.concatenate(numbers)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            total = np.add.reduceat(n[order].astype(np.int64), first)
            grams = np.stack(np.divmod(keys[first], U(counts.base)), axis=1)
            codes = counts.codes(grams[:, 0], grams[:, 1], total)
            return pd.DataFrame([{"shard": here, "image": Trie.of(grams, codes).image()}])

        here, parts, numbers = None, [], []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.shard != here:
                    if here is not None:
                        yield made()
                    here, parts, numbers = row.shard, [], []
                parts.append(unrisen(row.pairs))
                numbers.append(unsqueeze(row.n, "<u4"))
        if here is not None:
            yield made()

    packed = tokens.select("training", "lens", "ids").mapInPandas(
        partial(each_row, make=count), "shard int, pairs binary, n binary")
    tries = packed.repartition("shard").sortWithinPartitions("shard").mapInPandas(build, "shard int, image binary")
    return Model(staged(tries, "tries"), counts, shards)


SCORES = (
    "doc_id bigint, training boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
    "score double")


def scored(tokens: DataFrame, model: Model) -> DataFrame:
    """``SCORES`` of every text. Each chunk asks the shards for its different pairs."""
    counts, shards = model.counts, model.shards

    def wanted(ids: np.ndarray, lens: np.ndarray) -> tuple:
        """Different pairs of known words in the order of their shards, and the place of each token's pair."""
        before, pairs = pairs_of(counts, ids, lens)
        known = (ids < counts.words) & (before != counts.unknown)
        keys, inverse = np.unique(pairs[known], return_inverse=True)
        return before, known, keys, inverse, *by_shard(counts, keys, shards)

    def ask(row) -> list[dict]:
        _, _, keys, _, order, cuts = wanted(unsqueeze(row.ids, "<u4"), unsqueeze(row.lens, "<u4"))
        return [{"chunk": row.chunk, "shard": int(s), "image": rising(keys[order[cuts[s]:cuts[s + 1]]])}
                for s in np.flatnonzero(np.diff(cuts))]

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, trie = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.kind == 0:
                    here, trie = row.shard, Trie.mapped(row.image)
                    continue
                keys = unrisen(row.image)
                codes = np.zeros(len(keys), "<u2")
                if row.shard == here:
                    codes = trie.lookup(np.stack(np.divmod(keys, U(counts.base)), axis=1))
                out.append({"chunk": row.chunk, "shard": row.shard, "codes": squeeze(codes)})
            if out:
                yield pd.DataFrame(out)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, lens = unsqueeze(row.ids, "<u4"), unsqueeze(row.lens, "<u4").astype(np.int64)
                before, known, keys, inverse, order, _ = wanted(ids, lens)
                found = np.zeros(len(keys), np.int64)
                if len(keys):
                    found[order] = np.concatenate([unsqueeze(part["codes"], "<u2") for part in row.found])
                codes = np.zeros(len(ids), np.int64)
                codes[known] = found[inverse]
                unseen = codes == 0
                codes[unseen] = counts.codes(before[unseen], ids[unseen], 0)
                starts = np.cumsum(lens) - lens
                per_text = lambda values: np.add.reduceat(values, starts)
                docs = pd.array(unsqueeze(row.docs, "<i8"), dtype="Int64")
                docs[unsqueeze(row.named, "u1") == 0] = pd.NA
                yield pd.DataFrame({
                    "doc_id": docs, "training": unsqueeze(row.training, "u1").astype(bool), "n_tokens": lens,
                    "n_known": per_text((ids < counts.words).astype(np.int64)), "train_tokens": counts.tokens,
                    "base_score": per_text(np.log10(counts.single(ids))), "score": -per_text(codes) / STEPS})

    asked = tokens.select("chunk", "lens", "ids").mapInPandas(
        partial(each_row, make=ask), "chunk bigint, shard int, image binary").withColumn("kind", F.lit(1))
    held = model.tries.select(F.lit(None).cast("bigint").alias("chunk"), "shard", "image", F.lit(0).alias("kind"))
    answers = held.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind").mapInPandas(
        answer, "chunk bigint, shard int, codes binary")
    per_chunk = answers.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("shard", "codes"))).alias("found"))
    return tokens.join(per_chunk, "chunk", "left").select(
        "docs", "named", "training", "lens", "ids", "found").mapInPandas(add_up, SCORES)


def score_texts(docs: DataFrame, training: Column) -> DataFrame:
    """Learn from the rows where ``training`` holds and score all: ``SCORES`` for every row.

    A null text has the end token only, and so has an empty one; a null
    ``training`` teaches nothing. A null ``doc_id`` stays null. Repeated rows
    count and are scored as often as they occur. Without training texts every
    score is 0. An empty table gives no rows. Other columns are not read.
    """
    chunks, words = chunked(docs, training)
    lexicon = build_lexicon(chunks, words)
    tokens = numbered(chunks, words, lexicon)
    discard(docs.sparkSession, chunks)
    return scored(tokens, build_model(tokens, lexicon))
