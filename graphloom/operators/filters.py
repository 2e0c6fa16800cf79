"""Predicates on typed columns."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def typed_compare(column: str, op: str, value: object, type: str = "string") -> Column:  # noqa: A002
    """``column`` against a literal of its type; timestamps compare by day, integers are signed."""
    c, v = F.col(column), F.lit(value)
    if type == "timestamp":
        c, v = F.to_date(c), F.to_date(v)
    elif type == "date":
        v = F.to_date(v)
    else:
        v = v.cast(type)
    return COMPARE[op](c, v)


def day_window(day: Column, start: str, days: int, skip: int = 0) -> Column:
    """start + skip <= day < start + skip + days."""
    first = F.date_add(F.to_date(F.lit(start)), skip)
    return (day >= first) & (day < F.date_add(first, days))


def month_band(day: Column, month: int) -> Column:
    """From the 21st of ``month`` to the 21st of the next one; December goes on in January."""
    return ((F.month(day) == month) & (F.dayofmonth(day) >= 21)) | ((F.month(day) == month % 12 + 1) & (F.dayofmonth(day) < 22))


def within(column: Column, low: int, high: int) -> Column:
    """low < column < high."""
    return (column > low) & (column < high)


def content_or(content: Column, other: Column) -> Column:
    """``content``, or ``other`` where it is empty or null."""
    return F.coalesce(F.nullif(content, F.lit("")), other)
