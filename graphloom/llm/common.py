"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from graphloom.storage import shared_dir, staged

__all__ = ["documents", "map_last", "quoted", "same", "shared_dir", "staged", "table", "unused"]


def unused(columns: Iterable[str], *wanted: str) -> list[str]:
    """Names like those wanted that do not clash with ``columns`` (case ignored)."""
    taken = {c.lower() for c in columns}
    out = []
    for w in wanted:
        name = f"__{w}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def same(a: Column, b: Column) -> Column:
    """Null-safe equality."""
    return a.eqNullSafe(b)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_last(df: DataFrame, column: str, run: Callable, added: str) -> DataFrame:
    """``df`` through ``run`` (Arrow batches, ``column`` last), with the ``added`` columns in its place.

    The other columns pass through under names of place, as any name is allowed; an
    added column takes the place of one of the same name.
    """
    new = StructType.fromDDL(added)
    rest = [c for c in df.columns if c != column and c.lower() not in {n.lower() for n in new.names}]
    kept = df.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(rest)), quoted(column).alias("body"))
    schema = StructType([StructField(f.name, f.dataType) for f in kept.schema.fields[:-1]] + new.fields)
    return kept.mapInArrow(run, schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(rest)), *new.names)
