"""What both vector operators need of a table of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """True for vectors that are there and hold finite numbers only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, width: int, kind=np.float64) -> np.ndarray:
    """A list column as rows of ``width`` numbers; shorter lists end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype=kind)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
    inner = np.arange(len(flat)) - np.repeat(starts, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), inner] = flat
    return out
