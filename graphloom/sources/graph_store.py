"""A graph as a directory of Parquet tables, edges clustered by source and again by destination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.graph import EdgeKind, PropertyGraph


def save(graph: PropertyGraph, directory: str, max_records_per_file: int | None = None) -> None:
    """Vertices by label sorted by id; edges by kind, sorted by both ends, for either direction of expansion."""

    def put(df: DataFrame, path: str, *keys: str) -> None:
        w = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite")
        (w.option("maxRecordsPerFile", max_records_per_file) if max_records_per_file else w).parquet(path)

    for label, v in graph.vertices.items():
        put(v, f"{directory}/vertices/{label}", "id")
    for kind, e in graph.edges.items():
        put(e, f"{directory}/edges/{'-'.join(kind)}/by_src", "src", "dst")
        put(e, f"{directory}/edges/{'-'.join(kind)}/by_dst", "dst", "src")
    rows = [("vertex", k, "", "") for k in graph.vertices] + [("edge", *k) for k in graph.edges]
    graph_rows = next(iter(graph.vertices.values())).sparkSession.createDataFrame(rows, "what string, a string, b string, c string")
    graph_rows.coalesce(1).write.mode("overwrite").parquet(f"{directory}/catalog")


def load(spark: SparkSession, directory: str, by: str = "src") -> PropertyGraph:
    """The saved graph; ``by``: which copy of the edges to read, src or dst."""
    names = spark.read.parquet(f"{directory}/catalog").collect()  # one row for each label and kind
    vertices = {r.a: spark.read.parquet(f"{directory}/vertices/{r.a}") for r in names if r.what == "vertex"}
    edges = {EdgeKind(r.a, r.b, r.c): spark.read.parquet(f"{directory}/edges/{r.a}-{r.b}-{r.c}/by_{by}") for r in names if r.what == "edge"}
    return PropertyGraph(vertices, edges)


def register(graph: PropertyGraph) -> None:
    """A temporary view for every label and edge type, for SQL."""
    for label, v in graph.vertices.items():
        v.createOrReplaceTempView(label)
    for kind, e in graph.edges.items():
        name = kind.type if len(graph.kinds(type=kind.type)) == 1 else "_".join(kind)
        e.createOrReplaceTempView(f"edge_{name}")
