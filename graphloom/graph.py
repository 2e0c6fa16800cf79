"""Labeled property multigraphs as typed DataFrames."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class EdgeKind(NamedTuple):
    """Source label, edge type and destination label."""

    src: str
    type: str
    dst: str


class PropertyGraph:
    """Vertices by label and edges by kind.

    A vertex table has ``id`` and its properties; an edge table has ``src``,
    ``dst`` and its properties (null where an edge has none). The label of a vertex and
    the type of an edge are the choice of table, so a label or type
    predicate prunes whole tables before anything is read.
    """

    def __init__(self, vertices: dict[str, DataFrame], edges: dict[EdgeKind, DataFrame]):
        self.vertices, self.edges = vertices, edges

    # Vertices.

    def vertex(self, label: str, vid: int) -> DataFrame:
        """The row with this id; no row if there is none."""
        return self.vertices[label].where(F.col("id") == F.lit(vid))

    def by_property(self, label: str, column: str, value: object) -> DataFrame:
        """The vertex with this value; of several, the smallest id."""
        found = self.vertices[label].where(F.col(column) == F.lit(value))
        return found.orderBy("id").limit(1)

    def require(self, label: str, column: str, value: object) -> DataFrame:
        """``by_property`` that raises if no vertex has the value."""
        found = self.by_property(label, column, value)
        if found.isEmpty():
            raise LookupError(f"no {label} with {column} = {value!r}")
        return found

    def label_counts(self) -> DataFrame:
        each = [v.agg(F.count("*").alias("vertices")).select(F.lit(k).alias("label"), "vertices") for k, v in self.vertices.items()]
        return reduce(DataFrame.unionAll, each)

    def edge_kind_counts(self) -> DataFrame:
        each = [e.agg(F.count("*").alias("edges")).select(*(F.lit(x).alias(n) for n, x in zip(EdgeKind._fields, k, strict=True)), "edges") for k, e in self.edges.items()]
        return reduce(DataFrame.unionAll, each)

    # Edges.

    def kinds(self, src: str | None = None, type: str | None = None, dst: str | None = None) -> list[EdgeKind]:  # noqa: A002
        """Kinds of these labels and this type; case is ignored."""
        want = [w if w is None else w.lower() for w in (src, type, dst)]
        return [k for k in self.edges if all(w in (None, x.lower()) for w, x in zip(want, k, strict=True))]

    def edge(self, type: str, src: str | None = None, dst: str | None = None) -> DataFrame:  # noqa: A002
        """The one edge table of this type (and labels); where labels differ, ids alone do not tell vertices apart."""
        kinds = self.kinds(src, type, dst)
        if len(kinds) != 1:
            raise LookupError(f"{len(kinds)} edge tables of type {type!r} from {src or 'any'} to {dst or 'any'}: {kinds}")
        return self.edges[kinds[0]]

    def edges_of(self, *kinds: EdgeKind) -> DataFrame:
        """src_label, src, type, dst_label, dst, info (type and properties, joined by ``|``) of every edge of these kinds."""

        def plain(k: EdgeKind, e: DataFrame) -> DataFrame:
            return e.select(F.lit(k.src).alias("src_label"), "src", F.lit(k.type).alias("type"), F.lit(k.dst).alias("dst_label"), "dst", edge_info(k.type, e).alias("info"))

        return reduce(DataFrame.unionAll, (plain(k, self.edges[k]) for k in kinds))

    def all_edges(self) -> DataFrame:
        """As ``edges_of``, of every kind."""
        return self.edges_of(*self.edges)

    def size(self) -> DataFrame:
        """vertices, edges: how many there are in all."""
        return self.label_counts().agg(F.sum("vertices").alias("vertices")).join(F.broadcast(self.edge_kind_counts().agg(F.sum("edges").alias("edges"))))  # one row each

    def all_vertices(self) -> DataFrame:
        """label, id of every vertex."""
        return reduce(DataFrame.unionAll, (v.select(F.lit(k).alias("label"), "id") for k, v in self.vertices.items()))


def edge_info(type: str, edges: DataFrame) -> Column:  # noqa: A002
    """Type and properties of an edge as one string; absent properties are left out."""
    return F.concat_ws("|", F.lit(type), *(F.col(c).cast("string") for c in edges.columns if c not in ("src", "dst")))


def symmetrized(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, with the same properties."""
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))
