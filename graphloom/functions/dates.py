"""Dates and times as the data has them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of(text: Column) -> Column:
    """The day in the first ten characters of an ISO date or time."""
    return F.to_date(F.substring(text, 1, 10))


def epoch_ms(day: Column) -> Column:
    """Milliseconds from the epoch to the day's midnight, UTC."""
    return F.unix_date(day).cast("long") * 86_400_000


def day_of_ms(ms: Column) -> Column:
    return F.date_from_unix_date(F.floor(ms / 86_400_000).cast("int"))


def iso_ms(ms: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.000+0000`` of epoch milliseconds, UTC, whatever the session's zone."""
    day = F.date_format(F.date_from_unix_date(F.floor(ms / 86_400_000).cast("int")), "yyyy-MM-dd")
    s = F.pmod(F.floor(ms / 1000), F.lit(86_400)).cast("int")
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.concat(day, F.lit("T"), two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60), F.lit(".000+0000"))
