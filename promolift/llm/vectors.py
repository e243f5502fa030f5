"""Embedding columns as whole numbers: which rows take part, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str, most: float) -> Column:
    """Whether a vector is there and holds finite numbers smaller than ``most`` in size only.

    The bound keeps whole-number arithmetic on the entries exact.
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float(most))))
    return F.coalesce(F.col(vector).isNotNull() & fine, F.lit(False))


def common_length(rows: DataFrame, vector: str) -> int:
    """The length that most vectors have, the smallest of equally frequent ones; 0 without rows."""
    counts = rows.groupBy(F.size(vector).alias("length")).agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), "length").head()
    return 0 if first is None else first["length"]


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
