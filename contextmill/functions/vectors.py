"""Vector helpers that work on whole Arrow batches inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from contextmill.functions.numbers import SIMILARITY_PLACES


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of an Arrow list column as an (n, dim) array."""
    if column.null_count:
        raise ValueError("a vector is NULL")
    flat = column.flatten()
    if len(flat) != len(column) * dim or flat.null_count:
        raise ValueError(f"a vector does not have the declared {dim} elements")
    if dim and np.any(np.asarray(column.value_lengths()) != dim):
        raise ValueError(f"a vector does not have the declared {dim} elements")
    values = flat.to_numpy(zero_copy_only=False)
    if not np.isfinite(values).all():
        raise ValueError("a vector has an element that is not a finite number")
    return values.reshape(len(column), dim)


def norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


def row_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row pair in double precision, rounded; 0 for a zero vector."""
    a = a.astype(np.float64, copy=False)
    b = b.astype(np.float64, copy=False)
    scale = norms(a) * norms(b)
    dots = (a * b).sum(axis=1)
    return np.round(np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0), SIMILARITY_PLACES)


def has_dimension(vector: Column, dim: int) -> Column:
    """True for a usable vector: right size, every element a finite number."""
    # NULL, not False, where an element is NULL: the search cannot be sure.
    odd = [F.array_contains(vector, F.lit(x).cast("float")) for x in (float("nan"), float("inf"), float("-inf"))]
    return F.coalesce((F.size(vector) == dim) & ~(odd[0] | odd[1] | odd[2]), F.lit(False))
