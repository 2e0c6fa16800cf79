"""Substring operators on text properties. Offsets are characters of the row, from 0; matches may overlap."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(pattern: str) -> str:
    """The pattern as a regular expression that matches just it."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", pattern)


def occurrences(text: Column, pattern: str) -> Column:
    """Overlapping occurrences of a literal pattern; an empty one has none."""
    if not pattern:
        return F.when(text.isNotNull(), 0)
    return F.regexp_count(text, F.lit(f"(?={literal(pattern)})"))


def count(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    return rows.agg(F.coalesce(F.sum(occurrences(F.col(text), pattern)), F.lit(0)).cast("long").alias("occurrences"))


def locate(rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """key, offset of every occurrence; only rows that contain the pattern are taken apart."""
    c, n = F.col(text), len(pattern)
    if not n:
        return rows.select(key, F.lit(0).alias("offset")).limit(0)
    # Cut in front of every match, overlapping ones too: offsets are running lengths, linear in the text.
    parts = F.split(c, f"(?={literal(pattern)})", -1)
    walked = F.aggregate(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.concat(a["out"], F.array(a["at"] + F.length(p))).alias("out")),
        lambda a: a["out"],
    )
    first = F.when(F.startswith(c, F.lit(pattern)), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return rows.where(F.contains(c, F.lit(pattern))).select(key, F.explode(F.concat(first, walked)).alias("offset"))


def extract(rows: DataFrame, key: str, text: str, start: int, length: int) -> DataFrame:
    """key, piece; null where the range leaves the text."""
    c = F.col(text)
    inside = (F.lit(start) >= 0) & (F.lit(length) >= 0) & (F.lit(start + length) <= F.length(c))
    return rows.select(key, F.when(inside, c.substr(start + 1, length)).alias("piece"))


def rows_containing(rows: DataFrame, key: str, text: str, pattern: str, low: int, high: int) -> DataFrame:
    """Keys in [low, high] whose text contains the pattern."""
    return rows.where(F.col(key).between(low, high) & F.contains(F.col(text), F.lit(pattern))).select(key)


def statistics(rows: DataFrame, text: str) -> DataFrame:
    """rows, characters, bytes, alphabet (distinct characters)."""
    c = F.col(text)
    total = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length(c)), F.lit(0)).alias("characters"), F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).cast("long").alias("bytes"))
    letters = rows.select(F.explode(F.array_distinct(F.split(c, ""))).alias("ch")).where("ch != ''").agg(F.countDistinct("ch").alias("alphabet"))
    return total.join(F.broadcast(letters)).select("rows", "characters", "bytes", "alphabet")  # one row each
