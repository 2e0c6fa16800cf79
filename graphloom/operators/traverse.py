"""Level-synchronous traversal. A level is a join, a distinct and an anti-join; each is written out, so the plan stays short."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.storage import bucketed, discard, staged


def bfs_levels(start: DataFrame, edges: DataFrame, max_depth: int | None = None, target: int | None = None) -> DataFrame:
    """vid, depth of every vertex reached over out-edges; ``start`` has vid, which may be a struct.

    Stops at ``max_depth``, or at the level in which ``target`` appears.
    """
    levels = [staged(start.select("vid").distinct().withColumn("depth", F.lit(0)), "bfs")]
    e = edges.select(F.col("src").alias("vid"), "dst")
    if max_depth != 1:
        e = bucketed(e, "bfs_edges", "vid")  # derived and dealt once, not each level
    while max_depth is None or len(levels) <= max_depth:
        seen = reduce(DataFrame.unionAll, levels).select("vid")
        step = levels[-1].select("vid").join(e, "vid").select(F.col("dst").alias("vid")).distinct().join(seen, "vid", "left_anti")
        step = staged(step.withColumn("depth", F.lit(len(levels))), "bfs")
        if step.isEmpty():
            break
        levels.append(step)
        if target is not None and not step.where(F.col("vid") == target).isEmpty():
            break
    return reduce(DataFrame.unionAll, levels)


def one(edges: DataFrame, vid: int) -> DataFrame:
    """A frontier of one vertex."""
    return edges.sparkSession.range(1).select(F.lit(vid).cast("long").alias("vid"))


def bfs(vertices: DataFrame, edges: DataFrame, source: int) -> DataFrame:
    """id, depth of every vertex; null where it is not reached. An unknown source reaches nothing."""
    start = vertices.where(F.col("id") == source).select(F.col("id").alias("vid"))
    return vertices.select("id").join(bfs_levels(start, edges).select(F.col("vid").alias("id"), "depth"), "id", "left")


def friends(edges: DataFrame, person: int, least: int = 1, most: int = 1) -> DataFrame:
    """vid, depth at distance ``least`` to ``most`` of a person."""
    return bfs_levels(one(edges, person), edges, most).where(F.col("depth").between(least, most))


def khop_count(edges: DataFrame, person: int, k: int = 3) -> DataFrame:
    """Number of distinct vertices within ``k`` hops, the start left out."""
    return friends(edges, person, 1, k).agg(F.count("*").alias("vertices"))


def shortest_path_length(edges: DataFrame, a: int, b: int) -> DataFrame:
    """Hops from a to b: 0 if equal, -1 if b is not reached."""
    found = bfs_levels(one(edges, a), edges, target=b).where(F.col("vid") == b)
    return found.agg(F.coalesce(F.min("depth"), F.lit(-1)).alias("hops"))


def search_paths(start: DataFrame, edges: DataFrame, k: int, direction: str = "out") -> DataFrame:
    """vid, depth, path of every vertex within ``k`` hops.

    ``path`` grows by (vid, info) at each hop; of several ways of the same length the
    one with the least path stays, so the result does not depend on partitioning.
    ``edges``: src, dst, info.
    """
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    e = edges.select(F.col(a).alias("vid"), F.col(b).alias("to"), "info")
    if k > 1:
        e = bucketed(e, "path_edges", "vid")
    step0 = F.array(F.struct(F.col("vid"), F.lit("").alias("info")))
    levels = [staged(start.select("vid").distinct().select("vid", F.lit(0).alias("depth"), step0.alias("path")), "path")]
    for depth in range(1, k + 1):
        seen = reduce(DataFrame.unionAll, levels).select("vid")
        grown = levels[-1].join(e, "vid").select(F.col("to").alias("vid"), F.concat("path", F.array(F.struct(F.col("to").alias("vid"), "info"))).alias("path"))
        step = staged(grown.join(seen, "vid", "left_anti").groupBy("vid").agg(F.min("path").alias("path")).select("vid", F.lit(depth).alias("depth"), "path"), "path")
        if step.isEmpty():
            break
        levels.append(step)
    return reduce(DataFrame.unionAll, levels)


def in_out_paths(start: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """``search_paths`` over in-edges and over out-edges, told apart by ``direction``."""
    return search_paths(start, edges, k, "in").withColumn("direction", F.lit("in")).unionByName(search_paths(start, edges, k).withColumn("direction", F.lit("out")))


def format_path(path: Column) -> Column:
    """The vertices of a path with the edges that lead to them."""
    return F.array_join(F.transform(path, lambda p: F.when(p["info"] == "", p["vid"].cast("string")).otherwise(F.concat(F.lit("["), p["info"], F.lit("]"), p["vid"].cast("string")))), "->")


def children(paths: DataFrame) -> DataFrame:
    """parent, children: the vertices of ``paths`` under the one before them."""
    last = paths.where("depth > 0").select(F.get("path", F.col("depth") - 1)["vid"].alias("parent"), "vid")
    return last.groupBy("parent").agg(F.sort_array(F.collect_list("vid")).alias("children"))


def roots(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, root, depth in a reply forest (``src`` replies to ``dst``), by doubling the reach of each pointer.

    A reply to a vertex that is not in ``vertices``, or to itself, is a root; of several
    parents the smallest id counts. Vertices on a cycle of replies, or that lead to one, have null root and depth.
    """
    known = vertices.select("id").distinct()
    parent = edges.where("src != dst").join(known.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("up"))
    now = staged(known.join(parent, "id", "left").select("id", F.coalesce("up", "id").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("up").isNull().alias("done")), "roots")
    left, reach, most = now.where("not done").count(), 1, now.count()
    while left and reach < 2 * most:  # beyond that, what is not done runs in circles
        far = now.select(F.col("id").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        moved = now.where("not done").join(far, "up").select("id", F.col("top").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("done"))
        after = staged(now.where("done").unionByName(moved), "roots")
        discard(now)
        now, reach, left = after, 2 * reach, after.where("not done").count()
    return now.select("id", F.when(F.col("done"), F.col("up")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"))
