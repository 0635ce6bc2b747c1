"""Vectors as whole numbers: a component c becomes floor(256 c), so that sums and comparisons of them are exact.

Null vectors and those that hold null or non-finite components are left out. Vectors shorter than the longest count as padded by
zeros; components beyond ``MOST`` / ``SCALE`` in size (524,288) count as that, so that no sum of squares overflows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
MOST = 1 << 27
#: Bytes of a block of vectors in memory.
BLOCK_BYTES = 4 << 20


def usable(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is there and has finite components only."""
    own = F.col(f"`{vector}`").cast("array<double>")
    return df.where(own.isNotNull() & ~F.exists(own, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))


def doubles(vector: str) -> Column:
    return F.col(f"`{vector}`").cast("array<double>")


def width_of(df: DataFrame, vector: str) -> int:
    """Components of the longest vector, 0 where there is none."""
    return df.agg(F.max(F.size(F.col(f"`{vector}`")))).first()[0] or 0


def whole(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers from an Arrow array of lists of doubles."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    length = np.asarray(vectors.value_lengths().fill_null(0))
    flat = np.clip(np.floor(np.asarray(vectors.flatten(), np.float64) * SCALE), -MOST, MOST).astype(np.int64)
    if (length == width).all():
        return flat.reshape(len(length), width)
    out = np.zeros((len(length), width), np.int64)
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def rows_in_block(width: int) -> int:
    return max(1, BLOCK_BYTES // (8 * max(1, width)))
