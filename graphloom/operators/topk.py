"""Top-k with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def top(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows; the last key has to be unique. Spark keeps only k rows of each partition."""
    return rows.orderBy(*order).limit(k)


def top_with(rows: DataFrame, k: int, order: list, properties: DataFrame, on: str) -> DataFrame:
    """``top`` on narrow rows, then properties for those k rows only, in the same order."""
    return top(rows, k, *order).join(properties, on).orderBy(*order)
