"""Scalar functions on text columns and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column_of(row: Column, index: int, separator: str = "|") -> Column:
    """Field ``index`` (from 0) of a separated row; null beyond the last one."""
    return F.get(F.split(row, "\\" + separator, -1), F.lit(index))


def edge_type_of(info: Column) -> Column:
    """What stands before the first ``|`` of an edge's info."""
    return F.substring_index(info, "|", 1)


def edge_rest_of(info: Column) -> Column:
    """What stands after the first ``|``; empty if there is none."""
    at = F.locate("|", info)
    return F.when(at == 0, "").otherwise(info.substr(at + 1, F.length(info)))


def bit_length(x: Column) -> Column:
    """Bits of a non-negative whole number; 1 for 0."""
    return F.length(F.bin(x))


def concatenated(values: Column, separator: str = ";") -> Column:
    """Aggregate: the distinct order-free values of a group as one string."""
    return F.array_join(F.sort_array(F.collect_list(values)), separator)


def interaction_weight(n: Column) -> Column:
    return F.greatest(F.round(40 - F.sqrt(n)), F.lit(1.0))
