"""Typed neighbour expansion: equi-joins with edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def out_neighbours(frontier: DataFrame, edges: DataFrame, vid: str = "vid", to: str = "nbr", where: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Every row of ``frontier`` with each out-neighbour as ``to``; parallel edges give parallel rows.

    ``where`` is a predicate on the edge's columns, ``keep`` names edge columns to carry along.
    """
    e = edges if where is None else edges.where(where)
    return frontier.join(e.select(F.col("src").alias(vid), F.col("dst").alias(to), *keep), vid)


def in_neighbours(frontier: DataFrame, edges: DataFrame, vid: str = "vid", to: str = "nbr", where: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """As ``out_neighbours``, against the edges' direction."""
    e = edges if where is None else edges.where(where)
    return frontier.join(e.select(F.col("dst").alias(vid), F.col("src").alias(to), *keep), vid)


def both_neighbours(frontier: DataFrame, edges: DataFrame, vid: str = "vid", to: str = "nbr") -> DataFrame:
    """Distinct neighbours in either direction."""
    return out_neighbours(frontier, edges, vid, to).unionByName(in_neighbours(frontier, edges, vid, to)).distinct()


def conditional_fetch(frontier: DataFrame, edges: DataFrame, vertices: DataFrame, edge_where: Column | None = None, vertex_where: Column | None = None, vid: str = "vid") -> DataFrame:
    """Out-neighbours that pass a predicate on the edge and one on the neighbour's own properties."""
    v = vertices if vertex_where is None else vertices.where(vertex_where)
    return out_neighbours(frontier, edges, vid, "nbr", edge_where).join(v.select(F.col("id").alias("nbr")), "nbr", "left_semi")


def edges_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """All parallel edges of each (src, dst) pair."""
    return edges.join(pairs.select("src", "dst").distinct(), ["src", "dst"])


def degrees(vertices: DataFrame, edges: DataFrame, column: str = "src") -> DataFrame:
    """id, degree of every vertex, 0 included; ``column``: src for out-degree, dst for in-degree."""
    d = edges.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("degree"))
    return vertices.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_statistics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertices, edges, max_out, max_in, avg_out in one row."""
    out = degrees(vertices, edges, "src").agg(F.count("*").alias("vertices"), F.sum("degree").alias("edges"), F.max("degree").alias("max_out"), F.avg("degree").alias("avg_out"))
    into = edges.groupBy("dst").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_in"))
    return out.join(F.broadcast(into)).select("vertices", "edges", "max_out", "max_in", "avg_out")  # one row each


def first_neighbours(edges: DataFrame, vid: int, n: int, after: int | None = None) -> DataFrame:
    """The first ``n`` distinct out-neighbours of a vertex by id, from beyond ``after`` on: a list read in parts."""
    near = edges.where(F.col("src") == vid).select(F.col("dst").alias("nbr")).distinct()
    return (near if after is None else near.where(F.col("nbr") > after)).orderBy("nbr").limit(n)


def single_neighbour(frontier: DataFrame, edges: DataFrame, vid: str = "vid", to: str = "nbr") -> DataFrame:
    """Every row with its one out-neighbour; an error where a vertex has none or several."""
    n = edges.groupBy(F.col("src").alias(vid)).agg(F.count("*").alias("__n"), F.min("dst").alias(to))
    found = frontier.join(n, vid, "left")
    checked = F.when(F.col("__n") == 1, F.col(to)).otherwise(F.raise_error(F.concat(F.lit("not exactly one neighbour: "), F.col(vid).cast("string"))).cast("long"))
    return found.withColumn(to, checked).drop("__n")
