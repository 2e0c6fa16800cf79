"""Vectors as the operators on embeddings take them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not all zeros, and no null or non-finite component."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0), F.lit(False))


def identity(*columns: Column) -> tuple[Column, Column]:
    """A 128-bit key of the columns' values, in two longs."""
    return F.xxhash64(*columns), F.xxhash64(F.lit("other"), *columns)


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    n = len(lists)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))
