"""Graphs from directories of CSV files with headers: the social-network layout and the offshore-leaks layout."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import EdgeKind, PropertyGraph, symmetrized

#: Types of properties by lower-case column name; every other column has to be an id.
# The columns of the two public data layouts.
TYPES = {
    "length": "int", "classyear": "int", "workfrom": "int", "birthday": "date", "creationdate": "timestamp", "joindate": "timestamp",
    "firstname": "string", "lastname": "string", "gender": "string", "locationip": "string", "browserused": "string", "name": "string", "url": "string", "type": "string",
    "title": "string", "imagefile": "string", "language": "string", "content": "string", "email": "string",
}
SYMMETRIC = "knows"


#: Types of the leaks layout; every other column of it is text.
LEAKS_TYPES = {"internal_id": "long", "ibcruc": "long"}


def csv_files(spark: SparkSession, directory: str) -> dict[str, list[str]]:
    """All ``.csv`` and ``.csv.gz`` files below a directory by path (without ``.gz``); the parts of a folder ``name.csv`` that Spark wrote count as one file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{*.csv,*.csv.gz}").load(directory).select("path")
    out: dict[str, list[str]] = defaultdict(list)
    for r in found.collect():  # names of files, not their contents
        folder, name = r.path.rsplit("/", 1)
        out[folder if name.startswith("part-") and folder.endswith(".csv") else r.path.removesuffix(".gz")].append(r.path)
    return {k: sorted(v) for k, v in sorted(out.items())}


def _rows(spark: SparkSession, paths: list[str], columns: int, sep: str, quoted: bool) -> DataFrame:
    """The lines after each file's header as text columns c0, c1, ...; columns go by place, as two may have one name."""
    plain = {} if quoted else {"quote": "", "escape": ""}  # a quotation mark is a character like any other
    return spark.read.options(header=True, sep=sep, **plain).schema(", ".join(f"c{i} string" for i in range(columns))).csv(paths)


def header(spark: SparkSession, path: str, sep: str = "|") -> list[str]:
    """The lower-case column names of a file, as they stand in its first line."""
    first = spark.read.text(path).first()
    return [c.strip().strip('"') for c in first[0].lower().lstrip("\ufeff").split(sep)] if first else []


def classify(name: str, columns: list[str]) -> str:
    """vertex, edge, attribute or ignored, by file name and header; anything else is an error."""
    if name.lower().startswith("updatestream"):
        return "ignored"
    if columns and columns[0] == "id":
        return "vertex"
    if len(columns) >= 2 and columns[0].endswith(".id"):
        return "edge" if columns[1].endswith(".id") else "attribute"
    raise ValueError(f"{name}: neither vertices nor edges: {columns}")


def id_of(c: Column) -> Column:
    """An id as a long; one that is missing or beyond a signed long is an error, not a lost row or a wrong number."""
    return F.coalesce(c.try_cast("long"), F.raise_error(F.concat(F.lit("id out of range: "), F.coalesce(c, F.lit("none")))).cast("long"))


def typed(column: str, name: str) -> Column:
    """A property in its type; strings are never null. Unknown names are an error."""
    c = F.col(f"`{column}`")
    if name == "id" or name.endswith(".id"):
        return id_of(c)
    if name not in TYPES:
        raise ValueError(f"unknown property {name}")
    kind = TYPES[name]
    if kind == "string":
        return F.coalesce(c, F.lit(""))
    if kind == "timestamp":
        return F.coalesce(F.try_to_timestamp(c), F.timestamp_millis(c.try_cast("long")))
    return c.try_cast(kind)


def social_csv(spark: SparkSession, directory: str, sep: str = "|") -> PropertyGraph:
    """Vertex files ``label_...csv``, edge files ``src_type_dst...csv``, attribute files ``label_attribute...csv``."""
    vertices: dict[str, list[DataFrame]] = defaultdict(list)
    edges: dict[EdgeKind, list[DataFrame]] = defaultdict(list)
    attributes: dict[tuple[str, str], list[DataFrame]] = defaultdict(list)
    for path, files in csv_files(spark, directory).items():
        name = path.rsplit("/", 1)[1][: -len(".csv")]
        columns = header(spark, files[0], sep)
        kind = classify(name, columns)
        if kind == "ignored":
            continue
        parts = name.split("_")
        df = _rows(spark, files, len(columns), sep, quoted=False)
        if kind == "vertex":
            vertices[parts[0].lower()].append(df.select(*(typed(f"c{i}", c).alias(c) for i, c in enumerate(columns))))
        elif kind == "edge":
            ends = [c[: -len(".id")] for c in columns[:2]]
            rest = [typed(f"c{i}", c).alias(c) for i, c in enumerate(columns) if i > 1]
            edges[EdgeKind(ends[0], parts[1], ends[1])].append(df.select(typed("c0", columns[0]).alias("src"), typed("c1", columns[1]).alias("dst"), *rest))
        else:
            attributes[columns[0][: -len(".id")], columns[1]].append(df.select(typed("c0", columns[0]).alias("id"), F.coalesce("c1", F.lit("")).alias("value")))
    v = {k: _union(d) for k, d in sorted(vertices.items())}
    for (label, attribute), dfs in attributes.items():
        v[label] = attach(v[label], _union(dfs), attribute)
    e = {k: _union(d) for k, d in sorted(edges.items())}
    return PropertyGraph(v, {k: symmetrized(d) if k.type.lower() == SYMMETRIC else d for k, d in e.items()})


def _union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def attach(vertices: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """A multi-valued attribute as an array, sorted; empty where a vertex has none."""
    each = values.groupBy("id").agg(F.sort_array(F.collect_list("value")).alias(name))
    return vertices.join(each, "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def leaks_csv(spark: SparkSession, directory: str) -> PropertyGraph:
    """``nodes-<label>.csv`` with node_id and ``edges-<src>-<type>-<dst>.csv`` with node_id_start, node_id_end.

    Labels and types are in lower case; files of one label or kind, in any folder, are one table.
    """
    vertices: dict[str, list[DataFrame]] = defaultdict(list)
    edges: dict[EdgeKind, list[DataFrame]] = defaultdict(list)
    ids = {"node_id": "id", "node_id_start": "src", "node_id_end": "dst"}
    for path, files in csv_files(spark, directory).items():
        parts = path.rsplit("/", 1)[1][: -len(".csv")].lower().split("-")
        columns = header(spark, files[0], ",")
        if not (parts[0] == "nodes" and len(parts) == 2 and "node_id" in columns) and not (parts[0] == "edges" and len(parts) == 4 and {"node_id_start", "node_id_end"} <= set(columns)):
            raise ValueError(f"{path}: neither nodes nor edges: {columns}")
        kept = lambda i, c: F.col(f"c{i}").try_cast(LEAKS_TYPES[c]) if c in LEAKS_TYPES else F.coalesce(F.col(f"c{i}"), F.lit(""))
        df = _rows(spark, files, len(columns), ",", quoted=True).select(*(id_of(F.col(f"c{i}")).alias(ids[c]) if c in ids else kept(i, c).alias(c) for i, c in enumerate(columns)))
        (vertices[parts[1]] if parts[0] == "nodes" else edges[EdgeKind(parts[1], parts[2], parts[3])]).append(df)
    return PropertyGraph({k: _union(d) for k, d in sorted(vertices.items())}, {k: _union(d) for k, d in sorted(edges.items())})
