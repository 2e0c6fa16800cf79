"""Labelled rows for learning: a bounded sample and the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 5, is 0; a null doc_id is never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(True))


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """text, y of at most ``rows`` labelled documents outside the held-out fold, one row for each doc_id.

    The sample is the ``rows`` ids of least hash, so it is the same on every run; only
    it is broadcast, and its size is bound by ``rows``. A doc_id with labels of both values is
    not learnt from; of several texts of one doc_id the least counts.
    """
    y = F.col(label).cast("int")
    picked = (
        labels.where(~held_out(F.col("doc_id")) & y.isin(0, 1)).groupBy(F.col("doc_id").alias("__id")).agg(F.min(y).alias("y"), F.max(y).alias("most")).where("y = most")
        .select("__id", "y", F.xxhash64("__id").alias("h")).orderBy("h", "__id").limit(rows).select("__id", "y")
    )
    found = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))
    return found.groupBy("__id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")
