"""Vectors between Spark and numpy: validity, blocks of rows, and matrices out of Arrow lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """True where the vector and all of its components are there and finite."""
    inside = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(inside, F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of doubles; vectors shorter than ``dims`` are filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dims).all():
        return values.reshape(len(column), dims)
    out = np.zeros((len(column), dims))
    out[np.arange(dims)[None, :] < sizes[:, None]] = values
    return out


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
