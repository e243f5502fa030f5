"""Whitening of embeddings with the leading components of their covariance.

Sums and centred products are made by the tasks and added up by Spark; what
reaches the driver is the covariance, a matrix of the dimensions. It is taken
apart by spectral divide and conquer: the polar factor of the covariance less a
shift is +1 on the components above the shift and -1 on those below, so it gives
the projector on either; both parts are projected and split again until one
component is left. The polar factor comes from the QR-based Halley iteration
with dynamic weights (QDWH), which needs no inverse. The components, a small
matrix again, then travel to the tasks that whiten.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.llm.vectors import common_length, matrix, usable

SCALE, OFFSET = 1024, 100_000
#: Entries of this size or more do not become exact whole numbers; their rows are left out.
MOST_ENTRY = float(1 << 30)
EPS = np.finfo(float).eps
#: Shifts that are tried: spreads of the eigenvalues away from their mean.
SHIFTS = (0.0, 0.11, -0.11, 0.29, -0.29, 0.53, -0.53)


def polar(matrix_: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by dynamically weighted Halley steps."""
    size = len(matrix_)
    norm = np.linalg.norm(matrix_)
    if norm == 0:
        return np.eye(size)
    x, lower = matrix_ / norm, EPS
    for _ in range(30):
        square = lower * lower
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        a = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(size)]))
        after = (b / c) * x + (a - b / c) / np.sqrt(c) * (q[:size] @ q[size:].T)
        after = (after + after.T) / 2
        moved = np.linalg.norm(after - x)
        x, lower = after, min(1.0, lower * (a + b * square) / (1 + c * square))
        if abs(1 - lower) < 10 * EPS and moved < 1e-6:
            break
    return x


def _halves(part: np.ndarray, shift: float) -> tuple[np.ndarray, int]:
    """An orthogonal basis whose first columns span the components above the shift; how many."""
    size = len(part)
    projector = (np.eye(size) + polar(part - shift * np.eye(size))) / 2
    above = int(round(float(np.trace(projector))))
    basis = np.random.default_rng(size).standard_normal((size, size))
    for _ in range(3):
        sides = projector @ basis[:, :above], basis[:, above:] - projector @ basis[:, above:]
        basis, _ = np.linalg.qr(np.hstack(sides))
    return basis, above


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix."""
    whole = np.linalg.norm(covariance)

    def split(part: np.ndarray) -> np.ndarray:
        """The eigenvectors of a part as columns; parts without a spread need no turning."""
        size = len(part)
        mean = np.trace(part) / size
        if size == 1 or np.linalg.norm(part - mean * np.eye(size)) <= size * EPS * whole:
            return np.eye(size)
        spread = np.linalg.norm(part - mean * np.eye(size)) / np.sqrt(size)
        best = None
        for way in SHIFTS:
            basis, above = _halves(part, mean + way * spread)
            if not 0 < above < size:
                continue
            turned = basis.T @ part @ basis
            left = np.linalg.norm(turned[:above, above:])
            if best is None or left < best[0]:
                best = (left, basis, above, turned)
            if left <= 4 * size * EPS * whole:
                break
        if best is None:
            raise ArithmeticError("no shift splits the covariance")
        _, basis, above, turned = best
        turned = (turned + turned.T) / 2
        return np.hstack([basis[:, :above] @ split(turned[:above, :above]),
                          basis[:, above:] @ split(turned[above:, above:])])

    if not len(covariance):
        return np.zeros(0), np.zeros((0, 0))
    vectors = split((covariance + covariance.T) / 2)
    values = np.einsum("ij,ij->j", vectors, covariance @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


@dataclass(frozen=True)
class Whitening:
    """A fit: rows, sums per dimension, and the components as (dimension, component) arrays."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    total: float

    @property
    def kept(self) -> int:
        """Components with a spread; the others cannot be scaled to 1."""
        return int((self.values > len(self.sums) * EPS * max(self.total, 0.0)).sum())


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * entries).astype(np.int64) + OFFSET


def taking_part(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """Key and vector of the usable rows of the common length; that length."""
    fine = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector")).where(usable("vector", MOST_ENTRY))
    length = common_length(fine, "vector")
    return fine.where(F.size("vector") == length), length


def _summed(frame: DataFrame, per_batch, kind: type, rows: int, columns: int) -> np.ndarray:
    """Add up a (rows, columns) matrix of ``kind``, int or float, over all batches.

    Each task adds its own batches and gives one row for each row of its matrix.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = per_batch(batch)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(rows), pa.int32()), pa.array(list(total), pa.list_(arrow))], ["i", "values"])

    arrow, name = (pa.int64(), "bigint") if kind is int else (pa.float64(), "double")
    parts = frame.mapInArrow(build, f"i int, values array<{name}>")
    cells = parts.select("i", F.posexplode("values").alias("j", "value")).groupBy("i", "j").agg(
        F.sum("value").alias("value")).collect()
    out = np.zeros((rows, columns), np.int64 if kind is int else np.float64)
    for cell in cells:
        out[cell["i"], cell["j"]] = cell["value"]
    return out


def fit(rows: DataFrame, length: int) -> Whitening:
    """Fit to all rows of :func:`taking_part`. The driver gets sums and the covariance only."""
    def totals(batch: pa.RecordBatch) -> np.ndarray:
        x = whole_numbers(matrix(batch.column(1), length))
        return np.append(x.sum(axis=0), len(x))[None, :]

    if not length:
        return Whitening(0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0)
    counted = _summed(rows, totals, int, 1, length + 1)[0]
    n, sums = int(counted[-1]), counted[:-1]

    def products(batch: pa.RecordBatch) -> np.ndarray:
        centred = (n * whole_numbers(matrix(batch.column(1), length)) - sums) / n
        return np.triu(centred.T @ centred)

    upper = _summed(rows, products, float, length, length) / n
    covariance = upper + np.triu(upper, 1).T
    values, vectors = components(covariance)
    return Whitening(n, sums, values, vectors, float(np.trace(covariance)))


def whiten(rows: DataFrame, model: Whitening, most: int) -> DataFrame:
    """``key, deviation, whitened``: the first ``most`` whitened components of every row.

    ``deviation`` is exact as decimal(38, 0). Components without a spread are null.
    """
    length, width = len(model.sums), min(most, len(model.sums))
    n, sums, kept = model.n, model.sums, min(width, model.kept)
    scaled = model.vectors[:, :kept] / np.sqrt(model.values[:kept])
    mask = (1 << 31) - 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = n * whole_numbers(matrix(batch.column(1), length)) - sums
            # Squares of numbers beyond 31 bits, added up in three parts that stay within 63 bits.
            high, low = apart >> 31, apart & mask
            square = low * low
            parts = (high * high, 2 * high * low + (square >> 31), square & mask)
            whitened = np.full((len(apart), width), np.nan)
            whitened[:, :kept] = (apart / n) @ scaled
            flat = pa.array(whitened.ravel(), from_pandas=True)
            ends = pa.array(np.arange(len(apart) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(part.sum(axis=1)) for part in parts),
                 pa.ListArray.from_arrays(ends, flat)],
                ["key", "high", "middle", "low", "whitened"])

    kind = rows.schema["key"].dataType.simpleString()
    made = rows.mapInArrow(build, f"key {kind}, high bigint, middle bigint, low bigint, whitened array<double>")
    part = lambda name, bits: F.col(name).cast("decimal(19,0)") * F.lit(1 << bits).cast("decimal(19,0)")
    deviation = (part("high", 62) + part("middle", 31) + F.col("low").cast("decimal(19,0)")).cast("decimal(38,0)")
    return made.select("key", deviation.alias("deviation"), "whitened")


def identity_error(rows: DataFrame, model: Whitening, most: int) -> float | None:
    """The largest entry of the whitened rows' covariance less the identity; None without components.

    Tasks centre their own rows; the part between tasks is added from their means.
    """
    kept = min(most, model.kept)
    if not kept:
        return None
    n, sums, length = model.n, model.sums, len(model.sums)
    scaled = model.vectors[:, :kept] / np.sqrt(model.values[:kept])

    def products(batch: pa.RecordBatch) -> np.ndarray:
        made = ((n * whole_numbers(matrix(batch.column(1), length)) - sums) / n) @ scaled
        mean = made.mean(axis=0)
        centred = made - mean
        inner = centred.T @ centred + len(made) * np.outer(mean, mean)
        return np.vstack([inner, len(made) * mean])

    added = _summed(rows, products, float, kept + 1, kept) / n
    covariance = added[:kept] - np.outer(added[kept], added[kept])
    return float(np.abs(covariance - np.eye(kept)).max())


def whitened_components(frame: DataFrame, most: int = 8) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Rows whose vector is null, holds a null, a non-finite entry or one of 2^30
    or more in size, or has another length than most vectors are left out. A
    null ``vec_id`` stays null, repeated rows count as often as they occur, other
    columns are not read and an empty table gives no rows. A component without
    any spread has a null ``whitened`` and is not part of ``identity_error``;
    ``explained`` is null if no dimension varies. A ``deviation`` beyond 63 bits
    is null here; :func:`whiten` has it exactly.
    """
    rows, length = taking_part(frame)
    model = fit(rows, length)
    error = identity_error(rows, model, most)
    total = model.total
    shares = [float(value / total) if total > 0 else None for value in model.values[:most]]
    made = whiten(rows, model, most) if length else rows.select(
        "key", F.lit(None).cast("decimal(38,0)").alias("deviation"),
        F.lit(None).cast("array<double>").alias("whitened"))
    return made.select(
        F.col("key").alias("vec_id"), "deviation", F.posexplode("whitened").alias("place", "whitened"),
    ).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"),
        F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened",
        F.element_at(F.array(*[F.lit(share).cast("double") for share in shares] or [F.lit(None).cast("double")]),
                     F.col("place") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))
