"""Connected components of an edge table: a small one in a task, a larger one by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import staged


#: Distinct edges that one task may take whole (16 bytes each); the driver then plans no rounds.
SMALL_LINKS = 1 << 20


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of these edges, and the smallest node that it reaches."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(ends, 2)
    root = np.arange(len(ids))
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return ids, ids[root]
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        node, component = least_reached(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield from pa.table({"node": node, "component": component}).to_batches(1 << 16)


def components(edges: DataFrame, u: str = "u", v: str = "v", small: int = SMALL_LINKS) -> DataFrame:
    """node, component (its smallest node) for every node that has an edge.

    At most ``small`` distinct edges, counted first, of long nodes are read by one task. Of
    more, rounds grow with the logarithm of a component's diameter. Each is two
    aggregations with partial sums and two joins whose sides come from written
    tables, so a node of very many edges is split by adaptive execution.
    """
    e = staged(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u != v").distinct(), "cc-edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, before = mark(e), None
    if now[0] <= small and {f.dataType.simpleString() for f in e.schema} == {"bigint"}:
        return staged(e.coalesce(1).mapInArrow(_in_task, "node long, component long"), "cc-found")
    while now != before:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large-star: each larger neighbour goes to the least of the neighbourhood
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
        big = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        big = staged(big, "cc-edges")
        # small-star: each smaller neighbour, and the node, go to the least one
        low = staged(big.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = big.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = staged(small.distinct(), "cc-edges")
        now, before = mark(e), now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
