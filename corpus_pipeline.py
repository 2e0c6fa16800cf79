"""A corpus pipeline of five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import documents, staged, table
from graphloom.llm.line_dedup import line_dedup
from graphloom.llm.near_copies import near_copy_dedup
from graphloom.llm.packing import best_fit_pack
from graphloom.llm.pii import redact
from graphloom.llm.quality import quality_filter


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated three-line windows go; a document that is all repetition becomes empty."""
    return _counted(line_dedup(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: SimHash links, and MinHash keys beyond its cut, of Jaccard similarity 0.8 or more."""
    return near_copy_dedup(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and credentials become tags of their kind."""
    return _counted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of each document, or of its pieces."""
    return best_fit_pack(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", packing),
]

#: The classifier, the fingerprints and the packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
