"""Vectors as array columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity; null for vectors of no length."""
    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(lengths > 0, 1 - dot(a, b) / lengths)


def usable(vector: Column, dim: int) -> Column:
    """Of dim elements, all of them finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix_of(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix) of the usable vectors of an Arrow list column."""
    lengths, valid = np.diff(column.offsets.to_numpy()), column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero((lengths == dim) & valid)
    flat = column.values.to_numpy(zero_copy_only=False)
    matrix = flat[(column.offsets.to_numpy()[rows][:, None] + np.arange(dim)).ravel()].reshape(len(rows), dim) if len(rows) else np.zeros((0, dim))
    good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
    return rows[good], matrix[good]
