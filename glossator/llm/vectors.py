"""Vectors as exact integers: what the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vector: Column) -> Column:
    """Whether a vector is there and has finite components only."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~wrong, F.lit(False))


def largest(dims: int, spare: int) -> int:
    """Integers of up to this magnitude: the sum of ``dims`` products of two of them is below 2 ** (62 - spare)."""
    return 1 << ((62 - spare - max(1, dims - 1).bit_length()) // 2)


def integers(vectors: pa.Array, scale: int, dims: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that hold sound vectors, and floor(scale * x) of their components, ``dims`` to a row.

    Shorter vectors have zeros behind them; components beyond ``most`` are held there.
    """
    n = len(vectors)
    size = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    row = np.repeat(np.arange(n), size)
    keep = vectors.is_valid().to_numpy(zero_copy_only=False).astype(bool)
    keep[row[~np.isfinite(x)]] = False
    out = np.zeros((n, dims), np.int64)
    at = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    right = keep[row]
    out[row[right], at[right]] = np.clip(np.floor(x[right] * scale), -most, most).astype(np.int64)
    kept = np.flatnonzero(keep)
    return kept, out[kept]


def widest(rows: DataFrame, vector: str = "v") -> int:
    """The length of the longest vector, 0 if there is none."""
    return rows.agg(F.max(F.size(vector))).first()[0] or 0
