"""What the two vector operators share: integer vectors, and Arrow batches of them as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    values = vector.cast("array<double>")
    # NaN counts as larger than infinity.
    return vector.isNotNull() & F.forall(values, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def scaled(vector: Column, factor: int) -> Column:
    """Components as integers: the floor of ``factor`` times the component as a double."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * float(factor)))


def matrices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors of one length at a time: the places of the rows, and the rows as a matrix of 64-bit
    integers. Null rows are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    column = column.drop_null()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths):
        these = np.flatnonzero(lengths == length)
        if len(these) == len(lengths):
            yield rows, values.reshape(len(these), length)
        else:
            yield rows[these], values[starts[these][:, None] + np.arange(length)]


def largest(matrix: np.ndarray) -> int:
    """Largest size of a component."""
    return max(int(matrix.max()), -int(matrix.min())) if matrix.size else 0
