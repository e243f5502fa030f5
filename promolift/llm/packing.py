"""Packing documents into sequences by deficit round-robin over source queues.

Every source is a queue of tokens, its documents in hash order. A window is
``window`` sequences long. In each round every queue earns its share of a window
as credit and is served whole chunks of ``chunk`` tokens as far as its credit
reaches; the rest stays as its deficit for the next round. Credit grows by the
same amount in every round, so the round that serves chunk j of a queue follows
from j alone and no state passes between tasks: the deficit left by one window,
or by one partition, is part of that arithmetic. Served chunks in the order of
(round, source, place) form one stream, which is cut into sequences; only the
last can be short. Without weights the shares are those of the corpus, so that
all queues end together; with weights a queue that ends leaves the rest to the
others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.functions.joins import even_join
from promolift.llm.common import running_start, spread, staged
from promolift.llm.tokens import encode_all

SEQUENCE, WINDOW, CHUNK = 2048, 64, 512
#: Windows whose totals are summed in one step.
TOGETHER = 1024


def tokenised(docs: DataFrame, path: str, spaces: str, end_id: int) -> DataFrame:
    """``row, doc_id, queue, n, data`` for every document; ``data`` holds its ids, compressed.

    A null source shares the queue of the empty one.
    """
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = encode_all(path, spaces, list(batch.pop("text")), end_id)
            batch["n"] = [len(x) for x in ids]
            press = zstandard.ZstdCompressor(level=1)
            batch["data"] = [press.compress(x.tobytes()) for x in ids]
            yield batch

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("queue"), "text")
    table = staged(rows.mapInPandas(
        encode, "row bigint, doc string, queue string, n bigint, data binary"), "tokens")
    return table.withColumn("doc_id", F.col("doc").cast(docs.schema["doc_id"].dataType)).drop("doc")


def chunks(
    tokens: DataFrame, weights: dict[str, float] | None, sequence: int, window: int, chunk: int
) -> DataFrame:
    """``row, start, length, queue, place, round``: each document cut where chunks of its queue end."""
    spark = tokens.sparkSession
    narrow = tokens.select("row", "queue", "n").withColumns({
        "mix": F.xxhash64("row"),
        "bucket": F.pmod(F.xxhash64(F.lit(5), "row"), F.lit(spread(spark))).cast("int")})
    placed = running_start(narrow, ["queue"], "bucket", ["mix", "row"], "n", "first")
    totals = narrow.groupBy("queue").agg(F.sum("n").alias("queue_n"))
    whole = totals.agg(F.sum("queue_n")).first()[0] or 1
    if weights:
        table = spark.createDataFrame(list(weights.items()), "queue string, weight double")
        totals = totals.join(table, "queue", "left")
        share = F.coalesce("weight", F.lit(min(weights.values()))) / float(sum(weights.values()))
    else:
        share = F.col("queue_n") / float(whole)
    totals = totals.withColumn("quantum", share * float(sequence * window))
    cut = even_join(placed, totals.select("queue", "queue_n", "quantum"), ["queue"], "inner").select(
        "row", "queue", "first", "n", "queue_n", "quantum",
        F.explode(F.expr(f"sequence(first div {chunk}, (first + n - 1) div {chunk})")).alias("j"))
    start = F.greatest(F.col("j") * chunk, F.col("first"))
    end = F.least((F.col("j") + 1) * chunk, F.col("first") + F.col("n"))
    due = F.ceil(F.least((F.col("j") + 1) * chunk, F.col("queue_n")) / F.col("quantum"))
    return cut.select(
        "row", "queue", (start - F.col("first")).alias("start"), (end - start).alias("length"),
        start.alias("place"), due.cast("bigint").alias("round"))


def streamed(served: DataFrame) -> DataFrame:
    """``row, start, length, at``: the place of each chunk in the stream of all tokens."""
    turns = served.groupBy("round", "queue").agg(
        F.sum("length").alias("tokens"), F.min("place").alias("queue_place"))
    turns = turns.withColumns({
        "all": F.lit(0), "bucket": F.floor(F.col("round") / TOGETHER).cast("bigint")})
    turns = running_start(turns, ["all"], "bucket", ["round", "queue"], "tokens", "turn_start")
    joined = served.join(turns.select("round", "queue", "queue_place", "turn_start"), ["round", "queue"])
    return joined.select(
        "row", "start", "length",
        (F.col("turn_start") + F.col("place") - F.col("queue_place")).alias("at"))


def _pieces(parts: list, sequence: int) -> list[tuple[int, int, int]]:
    """(start, length, at): joined where chunks follow each other, cut at sequence ends."""
    joined: list[list[int]] = []
    for start, length, at in sorted((p["start"], p["length"], p["at"]) for p in parts):
        if joined and joined[-1][2] + joined[-1][1] == at:
            joined[-1][1] += length
        else:
            joined.append([start, length, at])
    out = []
    for start, length, at in joined:
        while length:
            take = min(length, sequence - at % sequence)
            out.append((start, take, at))
            start, length, at = start + take, length - take, at + take
    return out


def pack(
    docs: DataFrame, path: str, spaces: str, end_id: int, weights: dict[str, float] | None = None,
    sequence: int = SEQUENCE, window: int = WINDOW, chunk: int = CHUNK,
) -> DataFrame:
    """``doc_id, source, start, length, ids, doc_tokens, sequence_id, offset`` for each piece.

    ``ids`` are little-endian unsigned 32-bit numbers. A null text has only the
    end id, so every row has a piece; repeated rows are packed each. All
    sequences are full but the last. An empty table gives no pieces.
    """
    tokens = tokenised(docs, path, spaces, end_id)
    stream = streamed(chunks(tokens, weights, sequence, window, chunk))
    by_row = stream.groupBy("row").agg(F.collect_list(F.struct("start", "length", "at")).alias("parts"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc, queue, n, data, parts in zip(
                    batch["doc"], batch["queue"], batch["n"], batch["data"], batch["parts"], strict=True):
                raw = unpress.decompress(data)
                ids = np.frombuffer(raw, f"<u{len(raw) // n}")
                out += [(doc, queue, start, length, ids[start:start + length].astype("<u4").tobytes(), n,
                         at // sequence, at % sequence) for start, length, at in _pieces(parts, sequence)]
            yield pd.DataFrame(out, columns=[
                "doc", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    pieces = tokens.join(by_row, "row").select(
        F.col("doc_id").cast("string").alias("doc"), "queue", "n", "data", "parts").mapInPandas(
        cut, "doc string, source string, start bigint, length bigint, ids binary, doc_tokens bigint, "
             "sequence_id bigint, offset bigint")
    return pieces.select(
        F.col("doc").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        *[c for c in pieces.columns if c != "doc"])
