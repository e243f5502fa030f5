"""Token ids in files of wavelet matrices, one per block of documents.

A file holds the ids of consecutive documents as bit planes, from the highest
bit down; each plane is followed by the number of its ones before every 512th
bit. That is enough to read any token, count a token in a stretch and find its
occurrences without unpacking the file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.llm.common import running_start, staged
from promolift.llm.tokens import encode_all

MAGIC = b"WMX1"
STEP = 512
#: A file is closed after the document with which it reaches this many ids.
BLOCK_TOKENS = 1 << 20


class WaveletMatrix:
    """A sequence of numbers below ``2**bits`` as ``bits`` planes of one bit each."""

    def __init__(self, size: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.size, self.planes, self.zeros, self.ranks = size, planes, zeros, ranks

    @classmethod
    def of(cls, values: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        bits = bits or max(1, int(values.max(initial=0)).bit_length())
        planes, zeros, ranks = [], [], []
        for level in range(bits - 1, -1, -1):
            ones = (values >> level & 1).astype(bool)
            plane = np.packbits(ones, bitorder="little")
            counts = np.add.reduceat(
                np.bitwise_count(plane), np.arange(0, len(plane), STEP // 8), dtype=np.uint32
            ) if len(plane) else np.zeros(0, np.uint32)
            planes.append(plane)
            ranks.append(np.concatenate([[0], np.cumsum(counts)]).astype("<u4"))
            zeros.append(int(len(values) - ranks[-1][-1]))
            # By places: where ones and zeros mix, masks mislead the processor at every other one.
            values = np.concatenate([values.take(np.flatnonzero(~ones)), values.take(np.flatnonzero(ones))])
        return cls(int(values.size), planes, zeros, ranks)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QB", self.size, len(self.planes))
        return head + b"".join(
            struct.pack("<Q", zeros) + plane.tobytes() + rank.tobytes()
            for zeros, plane, rank in zip(self.zeros, self.planes, self.ranks, strict=True))

    @classmethod
    def from_bytes(cls, data: bytes | memoryview) -> WaveletMatrix:
        size, bits = struct.unpack_from("<QB", data)
        at, width = 9, -(-size // 8)
        steps = -(-width // (STEP // 8)) + 1
        planes, zeros, ranks = [], [], []
        for _ in range(bits):
            zeros.append(struct.unpack_from("<Q", data, at)[0])
            planes.append(np.frombuffer(data, np.uint8, width, at + 8))
            ranks.append(np.frombuffer(data, "<u4", steps, at + 8 + width))
            at += 8 + width + 4 * steps
        return cls(size, planes, zeros, ranks)

    def _ones_before(self, level: int, place: int) -> int:
        step, whole = place // STEP, place // 8
        ones = int(self.ranks[level][step])
        ones += int(np.bitwise_count(self.planes[level][step * STEP // 8:whole]).sum())
        if place % 8:
            ones += int(self.planes[level][whole] & ((1 << place % 8) - 1)).bit_count()
        return ones

    def access(self, place: int) -> int:
        """The number at a place."""
        value = 0
        for level in range(len(self.planes)):
            bit = self.planes[level][place // 8] >> place % 8 & 1
            ones = self._ones_before(level, place)
            place = self.zeros[level] + ones if bit else place - ones
            value = value << 1 | int(bit)
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a number before ``end`` lie below the last plane."""
        start = 0
        if value >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._ones_before(level, start), self._ones_before(level, end)
            if value >> (len(self.planes) - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, value: int, end: int) -> int:
        """How often a number occurs before place ``end``."""
        start, stop = self._range(value, end)
        return stop - start

    def count(self, value: int) -> int:
        return self.rank(value, self.size)

    def _place_of_bit(self, level: int, bit: int, nth: int) -> int:
        """Place of the nth (from 0) one or zero of a plane."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * STEP, self.size) - ranks
        step = int(np.searchsorted(before, nth, side="right")) - 1
        stretch = self.planes[level][step * STEP // 8:(step + 1) * STEP // 8]
        bits = np.unpackbits(stretch, bitorder="little")
        return step * STEP + int(np.flatnonzero(bits == bit)[nth - before[step]])

    def select(self, value: int, nth: int) -> int:
        """Place of the nth (from 0) occurrence of a number."""
        start, end = self._range(value, self.size)
        if not 0 <= nth < end - start:
            raise IndexError("no such occurrence")
        place = start + nth
        for level in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - level) & 1
            place = self._place_of_bit(level, bit, place - self.zeros[level] if bit else place)
        return place

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, nth) for nth in range(self.count(value))]

    def all(self) -> np.ndarray:
        """The whole sequence, unpacked from the lowest plane upwards."""
        dtype = np.uint16 if len(self.planes) <= 16 else np.uint32
        values = np.zeros(self.size, dtype)
        for level in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.size, bitorder="little").view(bool)
            above = np.empty_like(values)
            above[~ones] = values[:self.zeros[level]]
            above[ones] = values[self.zeros[level]:] | dtype(1 << (len(self.planes) - 1 - level))
            values = above
        return values


def pack_file(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A file: magic, the documents' ids and lengths, then the matrix of all token ids."""
    missing = np.array([doc is None for doc in doc_ids], np.uint8)
    numbers = np.array([0 if doc is None else doc for doc in doc_ids], "<i8")
    lengths = np.array([len(x) for x in ids], "<i8")
    head = MAGIC + struct.pack("<Q", len(ids)) + missing.tobytes() + numbers.tobytes() + lengths.tobytes()
    return head + WaveletMatrix.of(np.concatenate(ids)).to_bytes()


def open_file(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Documents' ids, lengths and the matrix of a file."""
    if bytes(data[:4]) != MAGIC:
        raise ValueError("not a token file")
    n = struct.unpack_from("<Q", data, 4)[0]
    missing = np.frombuffer(data, np.uint8, n, 12)
    numbers = np.frombuffer(data, "<i8", n, 12 + n)
    lengths = np.frombuffer(data, "<i8", n, 12 + 9 * n)
    docs = [None if gone else int(number) for gone, number in zip(missing, numbers, strict=True)]
    return docs, lengths, WaveletMatrix.from_bytes(memoryview(data)[12 + 17 * n:])


FILE_SCHEMA = "shard int, block int, n_docs bigint, n_tokens bigint, file binary"


def write_files(
    docs: DataFrame, path: str, spaces: str, end_id: int, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Write ``doc_id, text`` in ascending order of ``doc_id`` as token files.

    Rows are dealt by ranges of ``doc_id``, one shard each (rows without id come
    first), and encoded where they arrive. Every file is a row of the written
    table, so any store that Spark reaches can hold it. Null texts have no ids
    but the end id.
    """
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, block = TaskContext.get().partitionId(), 0
        held_docs: list = []
        held_ids: list = []
        held = 0

        def file() -> pd.DataFrame:
            return pd.DataFrame({
                "shard": [shard], "block": [block], "n_docs": [len(held_docs)], "n_tokens": [held],
                "file": [pack_file(held_docs, held_ids)]})

        for batch in batches:
            numbers = [None if pd.isna(x) else int(x) for x in batch["number"]]
            for number, ids in zip(numbers, encode_all(path, spaces, list(batch["text"]), end_id), strict=True):
                held_docs.append(number)
                held_ids.append(ids)
                held += len(ids)
                if held >= block_tokens:
                    yield file()
                    block, held_docs, held_ids, held = block + 1, [], [], 0
        if held_docs:
            yield file()

    # As text, because a null would turn the ids into floats on their way to pandas.
    ordered = (
        docs.select("doc_id", "text").repartitionByRange(F.asc_nulls_first("doc_id"))
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
        .select(F.col("doc_id").cast("string").alias("number"), "text"))
    return staged(ordered.mapInPandas(encode, FILE_SCHEMA), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """``doc_id, shard, block, inside, n_tokens, ids`` of the documents in token files.

    ``ids`` are little-endian unsigned 32-bit numbers, ``inside`` counts the ids
    before a document in its file; :func:`placed` turns it into its start.
    """
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, block, data in zip(batch["shard"], batch["block"], batch["file"], strict=True):
                docs, lengths, matrix = open_file(data)
                values = matrix.all().astype("<u4")
                ends = np.cumsum(lengths)
                yield pd.DataFrame({
                    "shard": shard, "block": block, "doc_id": pd.array(docs, "Int64"),
                    "inside": ends - lengths, "n_tokens": lengths,
                    "ids": [values[end - n:end].tobytes() for n, end in zip(lengths, ends, strict=True)]})

    return files.select("shard", "block", "file").mapInPandas(
        decode, "shard int, block int, doc_id bigint, inside bigint, n_tokens bigint, ids binary")


def placed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Replace shard, block and ``inside`` by ``start``: the ids of all documents before."""
    starts = running_start(
        files.select("shard", "block", "n_tokens").withColumn("all", F.lit(0)),
        ["all"], "shard", ["block"], "n_tokens", "file_start"
    ).select("shard", "block", "file_start")
    return rows.join(starts, ["shard", "block"]).withColumn(
        "start", F.col("file_start") + F.col("inside")).drop("file_start", "inside", "shard", "block")
