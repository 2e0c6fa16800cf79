"""Whole-graph algorithms: PageRank, projected weights, weighted shortest paths."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.graph import PropertyGraph
from graphloom.operators.components import components
from graphloom.operators.traverse import bfs_levels
from graphloom.storage import bucketed, discard, staged


#: Edges of a graph that may go to every task whole (24 bytes each), and cells of a task's matrix.
SMALL_EDGES, CELLS = 2_000_000, 1 << 19
#: Edges of a connected component that a task may hold, links whose components one task finds, and
#: sources times edges of a component's part; of a component there are at most PARTS.
COMPONENT_EDGES, COMPONENT_LINKS, WORK, PARTS = 1 << 22, 1 << 22, 1 << 24, 32
#: Whole weights from 1 to this are relaxed by cost with sets of sources as bits: words of such a table, words of a vertex, in-edges of a
#: vertex that are read side by side.
WHOLE, WORDS, WIDE, SLOTS = 64, 1 << 20, 16, 48


def page_rank(vertices: DataFrame, edges: DataFrame, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """id, rank after a fixed number of rounds.

    Ranks start at 1/N; the rank of vertices without out-edges is spread evenly. Edges get
    their source's degree and lie in buckets of it, so a round deals ranks and contributions, no edges.
    ``vertices``: id; ``edges``: src, dst. Parallel edges count each.
    """
    e = bucketed(edges.select(F.col("src").alias("id"), "dst", F.count("*").over(Window.partitionBy("src")).alias("deg")), "rank_edges", "id")
    v = bucketed(vertices.select("id").distinct().join(e.select("id", "deg").distinct(), "id", "left"), "rank_vertices", "id")
    n = v.count()
    if not n:
        return v.select("id", F.lit(0.0).alias("rank"))
    ranks = v.withColumn("rank", F.lit(1.0 / n))
    for _ in range(iterations):
        lost = ranks.where("deg is null").agg(F.sum("rank")).first()[0] or 0.0
        gained = ranks.select("id", "rank").join(e, "id").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        base = (1 - damping + damping * lost) / n
        after = staged(v.join(gained, "id", "left").select("id", "deg", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")), "rank")
        if ranks is not v:
            discard(ranks)
        ranks = after
    discard(e, v)
    return ranks.select("id", "rank")


def keyed_edges(graph: PropertyGraph) -> DataFrame:
    """src, dst of the edges of every kind, as (label, id)."""
    key = lambda a, b: F.struct(F.col(a).alias("label"), F.col(b).alias("id"))
    return graph.all_edges().select(key("src_label", "src").alias("src"), key("dst_label", "dst").alias("dst"))


def _start(graph: PropertyGraph, label: str, vid: int) -> DataFrame:
    """The vertex as a frontier; none if there is no such vertex."""
    return graph.vertices[label].where(F.col("id") == vid).select(F.struct(F.lit(label).alias("label"), F.col("id").cast("long").alias("id")).alias("vid")).limit(1)


def bfs_all_labels(graph: PropertyGraph, label: str, vid: int) -> DataFrame:
    """label, id, depth of every vertex over the edges of every kind, to the end; -1 where it is not reached."""
    levels = bfs_levels(_start(graph, label, vid), keyed_edges(graph))
    every = graph.all_vertices().select(F.struct("label", F.col("id").cast("long").alias("id")).alias("vid"))
    return every.join(levels, "vid", "left").select("vid.label", "vid.id", F.coalesce("depth", F.lit(-1)).alias("depth"))


def khop_any_label(graph: PropertyGraph, label: str, vid: int, k: int) -> DataFrame:
    """Number of vertices of any label within ``k`` hops over the edges of every kind, the start left out."""
    return bfs_levels(_start(graph, label, vid), keyed_edges(graph), k).where("depth > 0").agg(F.count("*").alias("vertices"))


def page_rank_all_labels(graph: PropertyGraph, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """label, id, rank of every vertex, over the edges of every kind."""
    key = lambda a, b: F.struct(F.col(a).alias("label"), F.col(b).alias("id"))
    ranks = page_rank(graph.all_vertices().select(key("label", "id").alias("id")), keyed_edges(graph), iterations, damping)
    return ranks.select("id.label", "id.id", "rank")


def interaction_weights(knows: DataFrame, replies: DataFrame) -> DataFrame:
    """src, dst, weight of every edge: max(1, round(40 - sqrt(replies between the two))).

    ``replies``: one row (a, b) for each reply of a to b, of either direction.
    """
    low, high = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    n = replies.where("a != b").groupBy(low, high).agg(F.count("*").alias("n"))
    pairs = knows.select("src", "dst", F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high"))
    return pairs.join(n, ["low", "high"], "left").select("src", "dst", F.greatest(F.round(40 - F.sqrt(F.coalesce("n", F.lit(0)))), F.lit(1.0)).alias("weight"))


def shortest_costs(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None, small: int = SMALL_EDGES, component: int = COMPONENT_EDGES) -> DataFrame:
    """source, vid, cost of the cheapest path from each source to each vertex (or target) it reaches.

    ``edges``: src, dst, weight >= 0; ``sources`` and ``targets``: vid. Take the smaller side
    as sources. A graph of at most ``small`` edges goes to every task, which relaxes its
    share of the sources as matrices. Of a larger one every connected component goes to
    tasks of its own; a component of more than ``component`` edges is relaxed by rounds of joins.
    """
    e = staged(edges.select(F.col("src").alias("vid"), "dst", "weight"), "cost-edges")
    starts = sources.select(F.col("vid").cast("long").alias("vid")).distinct()
    if e.count() <= small:
        return _relaxed_in_tasks(e, starts, targets)
    return _relaxed_by_component(e, starts, targets, component)


def _relaxed_by_component(e: DataFrame, starts: DataFrame, targets: DataFrame | None, component: int) -> DataFrame:
    """Costs of a larger graph: a source meets the edges and targets of its own component only."""
    of = staged(components(e.select("vid", "dst"), "vid", "dst", COMPONENT_LINKS), "cost-components").select(F.col("node").alias("vid"), F.col("component").alias("c"))
    s = staged(starts.join(of, "vid", "left").select("vid", F.coalesce("c", "vid").alias("c")), "cost-starts")  # a source without an edge reaches itself
    t = (of if targets is None else targets.select(F.col("vid").cast("long").alias("vid")).distinct().join(of, "vid", "left").select("vid", F.coalesce("c", "vid").alias("c")))
    n = e.join(of, "vid").groupBy("c").agg(F.count("*").alias("edges"))
    parts = F.ceil(F.col("sources") * F.coalesce("edges", F.lit(0)) / WORK).cast("int")
    sizes = staged(s.groupBy("c").agg(F.count("*").alias("sources")).join(n, "c", "left").select("c", (F.coalesce("edges", F.lit(0)) > component).alias("large"), F.greatest(F.lit(1), F.least(F.lit(PARTS), parts)).alias("parts")), "cost-sizes")
    mine = sizes.where("not large").select("c", "parts")
    none, weight = F.lit(None).cast("long"), F.lit(None).cast("double")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    rows = (
        e.join(of, "vid").join(mine, "c").select("c", each, F.lit(0).alias("what"), "vid", "dst", F.col("weight").cast("double").alias("weight"))
        .unionByName(s.join(mine, "c").select("c", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("what"), "vid", none.alias("dst"), weight.alias("weight")))
        .unionByName(t.join(mine, "c").select("c", each, F.lit(2).alias("what"), "vid", none.alias("dst"), weight.alias("weight")))
    )
    if targets is None:  # a source without an edge is no vertex of ``of``
        rows = rows.unionByName(s.join(mine, "c").join(of.select("vid"), "vid", "left_anti").select("c", each, F.lit(2).alias("what"), "vid", none.alias("dst"), weight.alias("weight")))
    found = staged(rows.groupBy("c", "part").applyInArrow(_component_costs, "source long, vid long, cost double"), "cost-found")
    large = staged(sizes.where("large").select("c"), "cost-large")
    if large.isEmpty():
        return found
    rest = e.join(of, "vid").join(large, "c", "left_semi").select("vid", "dst", "weight")
    return found.unionByName(_relaxed_in_rounds(staged(rest, "cost-rest"), s.join(large, "c", "left_semi").select("vid"), targets))


def _component_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A component's edges (what = 0), some of its sources (1) and all its targets (2) to costs."""
    held = [[b.column(b.schema.get_field_index(x)).fill_null(0).to_numpy(zero_copy_only=False) for x in ("what", "vid", "dst", "weight")] for b in batches]
    what, vid, dst, weight = (np.concatenate(x) for x in zip(*held, strict=True))
    del held
    edge, sources, ends = what == 0, vid[what == 1], vid[what == 2]
    if not len(sources) or not len(ends):
        return
    ids = np.unique(np.concatenate([vid, dst[edge]]))
    src, dst, weight = np.searchsorted(ids, vid[edge]).astype(np.int32), np.searchsorted(ids, dst[edge]).astype(np.int32), weight[edge]
    del what, vid, edge
    order = np.argsort(dst, kind="stable")
    src, weight = src[order], weight[order]
    into, first = np.unique(dst[order], return_index=True)
    for source, at, cost in _relaxed(len(ids), src, weight, into, first, np.searchsorted(ids, sources), np.searchsorted(ids, np.unique(ends))):
        yield pa.RecordBatch.from_arrays([pa.array(ids[source]), pa.array(ids[at]), pa.array(cost)], names=["source", "vid", "cost"])


def _relaxed(many: int, src: np.ndarray, weight: np.ndarray, into: np.ndarray, first: np.ndarray, sources: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """source, vertex, cost for some sources at a time; edges are sorted by end, whose edges begin at ``first``."""
    if len(weight) and weight.min() >= 1 and weight.max() <= WHOLE and (weight == np.floor(weight)).all():
        yield from _relaxed_by_cost(many, src, np.repeat(into.astype(np.int32), np.diff(first, append=len(src))), weight.astype(np.int8), sources, wanted)
        return
    chunk = max(1, CELLS // max(1, len(src), many))
    for at in range(0, len(sources), chunk):
        place = sources[at : at + chunk]
        n = len(place)
        cost = np.full((many, n), np.inf)
        cost[place, np.arange(n)] = 0
        over, least, old = np.empty((len(src), n)), np.empty((len(into), n)), np.empty((len(into), n))
        falls = bool(len(src))
        while falls:
            np.take(cost, src, axis=0, out=over, mode="clip")
            over += weight[:, None]
            np.minimum.reduceat(over, first, axis=0, out=least)
            np.take(cost, into, axis=0, out=old, mode="clip")
            falls = bool((least < old).any())
            cost[into] = np.minimum(least, old, out=least)
        found = cost[wanted]
        row, col = np.nonzero(np.isfinite(found))
        yield place[col], wanted[row], found[row, col]


def _rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of a table of words: taken as one item each, which is two to three times faster than as rows."""
    return np.take(table.view(f"V{8 * table.shape[1]}")[:, 0], at).view(np.uint64).reshape(-1, table.shape[1])


def _put(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    item = f"V{8 * table.shape[1]}"
    table.view(item)[:, 0][at] = np.ascontiguousarray(rows).view(item)[:, 0]


class _Edges:
    """The edges of one weight: from sets of sources at their starts to those at their ends."""

    def __init__(self, many: int, src: np.ndarray, dst: np.ndarray) -> None:
        """``dst`` is sorted."""
        into, first, n = np.unique(dst, return_index=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        self.into, first, n = into[order], first[order], n[order]
        ends = [int(np.searchsorted(-n, -k)) for k in range(min(SLOTS, int(n[0])))]  # vertices of more than k in-edges
        self.slots = [src[first[:m] + k] for k, m in enumerate(ends)]
        more = int(np.searchsorted(-n, -SLOTS))  # the in-edges beyond come in a row
        rest = [np.arange(a + SLOTS, a + k) for a, k in zip(first[:more], n[:more], strict=True)]
        self.more, self.rest = more, src[np.concatenate(rest)] if rest else src[:0]
        self.at = np.cumsum([0, *map(len, rest)])[:-1]
        by = np.argsort(src, kind="stable")
        self.out, self.degree = dst[by], np.bincount(src, minlength=many).astype(np.int32)
        self.begin = (np.cumsum(self.degree) - self.degree).astype(np.int32)

    def few(self, ids: np.ndarray) -> bool:
        return 8 * int(self.degree[ids].sum()) < len(self.out)

    def push(self, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.degree[ids]
        edge = np.repeat(self.begin[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())
        if not len(edge):
            return ids[:0], rows[:0]
        to = self.out[edge]
        order = np.argsort(to, kind="stable")
        to, owner = to[order], np.repeat(np.arange(len(ids)), n)[order]
        first = np.flatnonzero(np.diff(to, prepend=-1))
        return to[first], np.bitwise_or.reduceat(_rows(rows, owner), first, axis=0)

    def pull(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        met = _rows(whole, self.slots[0])
        for place in self.slots[1:]:
            met[: len(place)] |= _rows(whole, place)
        if self.more:
            met[: self.more] |= np.bitwise_or.reduceat(_rows(whole, self.rest), self.at, axis=0)
        return self.into, met


def _relaxed_by_cost(many: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, sources: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As ``_relaxed``, of whole weights: from cost to cost, each vertex with the set of sources that reach it there first.

    A set is a row of bits, so an edge is read once for very many sources at each cost at which its start is new to some.
    """
    edges = {int(w): _Edges(many, src[weight == w], dst[weight == w]) for w in np.unique(weight)}
    heaviest = max(edges)
    asked = np.zeros(many, dtype=bool)
    asked[wanted] = True
    width = max(1, min(WIDE, WORDS // many, -(-len(sources) // 64)))
    seen, fresh, whole = (np.zeros((many, width), dtype=np.uint64) for _ in range(3))
    touched = np.zeros(many, dtype=bool)
    for at in range(0, len(sources), 64 * width):
        place = sources[at : at + 64 * width]
        k = np.arange(len(place))
        seen.fill(0)
        fresh[place, k // 64] = np.uint64(1) << (k % 64).astype(np.uint64)
        touched[place] = True
        new: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        left, cost, ahead = len(place) * len(wanted), 0, set()
        while True:
            ids = np.flatnonzero(touched).astype(np.int32)
            touched[ids] = False
            rows, known = _rows(fresh, ids), _rows(seen, ids)
            _put(fresh, ids, np.zeros_like(rows))
            rows &= ~known
            some = np.flatnonzero(reduce(np.bitwise_or, rows.T))
            if len(some) < len(ids):
                ids, rows, known = ids[some], _rows(rows, some), _rows(known, some)
            if len(ids):
                known |= rows
                _put(seen, ids, known)
                new[cost] = ids, rows
                ahead.update(cost + w for w in edges)
                mine = np.flatnonzero(asked[ids])
                found, sets = ids[mine], rows[mine]
                step = max(1, 2 * CELLS // (64 * width))
                for a in range(0, len(found), step):
                    bit = np.flatnonzero(np.unpackbits(sets[a : a + step].view(np.uint8).reshape(-1), bitorder="little"))
                    left -= len(bit)
                    yield place[bit % (64 * width)], found[a : a + step][bit // (64 * width)], np.full(len(bit), float(cost))
            if not left or not ahead:
                break
            cost = min(ahead)
            ahead.remove(cost)
            new = {c: x for c, x in new.items() if c >= cost - heaviest}
            for w, of in edges.items():
                if cost - w in new:
                    ids, rows = new[cost - w]
                    if of.few(ids):
                        to, met = of.push(ids, rows)
                    else:
                        _put(whole, ids, rows)
                        to, met = of.pull(whole)
                        _put(whole, ids, np.zeros_like(rows))
                    met |= _rows(fresh, to)
                    _put(fresh, to, met)
                    touched[to] = True


def _relaxed_in_tasks(e: DataFrame, starts: DataFrame, targets: DataFrame | None) -> DataFrame:
    """Costs over a graph whose size is checked; every source is one row of a matrix of costs."""
    spark = e.sparkSession
    rows = e.toPandas()
    ids, ends = np.unique(np.concatenate([rows["vid"].to_numpy(np.int64), rows["dst"].to_numpy(np.int64)]), return_inverse=True)
    src, dst = np.split(ends, 2)
    order = np.argsort(dst, kind="stable")
    src, dst, weight = src[order], dst[order], rows["weight"].to_numpy(np.float64)[order]
    into, first = np.unique(dst, return_index=True)
    wanted = np.ones(len(ids), dtype=bool)
    if targets is not None:  # of the targets only those in the graph, which is bounded
        ends = e.select("vid").unionAll(e.select("dst")).distinct().join(targets.select("vid").distinct(), "vid", "left_semi").toPandas()["vid"]
        wanted = np.isin(ids, ends.to_numpy(np.int64))
    graph = spark.sparkContext.broadcast((ids, src, weight, into, first, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, src, weight, into, first, wanted = graph.value
        at_wanted = np.flatnonzero(wanted)
        for b in batches:
            every = b.column(0).to_numpy()
            place = np.minimum(np.searchsorted(ids, every), max(0, len(ids) - 1))
            known = ids[place] == every if len(ids) else np.zeros(len(every), dtype=bool)
            alone, place = every[~known], place[known]
            # A source without an edge reaches itself.
            yield pa.RecordBatch.from_arrays([pa.array(alone), pa.array(alone), pa.array(np.zeros(len(alone)))], names=["source", "vid", "cost"])
            for source, vertex, cost in _relaxed(len(ids), src, weight, into, first, place, at_wanted):
                yield pa.RecordBatch.from_arrays([pa.array(ids[source]), pa.array(ids[vertex]), pa.array(cost)], names=["source", "vid", "cost"])

    # Written, as a sort after it would compute it twice.
    found = staged(starts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vid").mapInArrow(run, "source long, vid long, cost double"), "cost-found")
    return found if targets is None else found.join(targets.select("vid").distinct(), "vid", "left_semi").select("source", "vid", "cost")


def _relaxed_in_rounds(e: DataFrame, starts: DataFrame, targets: DataFrame | None) -> DataFrame:
    """Costs by joins; a source that has reached all targets drops what costs as much as the dearest of them."""
    ends = None if targets is None else staged(targets.select("vid").distinct(), "cost-targets")
    many = ends.count() if ends is not None else 0
    best = staged(starts.select(F.col("vid").alias("source"), "vid", F.lit(0.0).alias("cost")), "cost")
    new = best
    while True:
        step = new.join(e, "vid").groupBy("source", F.col("dst").alias("vid")).agg(F.min(F.col("cost") + F.col("weight")).alias("cost"))
        if ends is not None:
            reached = best.join(ends, "vid", "left_semi").groupBy("source").agg(F.count("*").alias("n"), F.max("cost").alias("most")).where(F.col("n") == many)
            step = step.join(reached.select("source", "most"), "source", "left").where("most is null or cost < most").select("source", "vid", "cost")
        after = staged(step.join(best.withColumnRenamed("cost", "old"), ["source", "vid"], "left").where("old is null or cost < old").select("source", "vid", "cost"), "cost-new")
        if after.isEmpty():
            break
        whole = staged(best.unionByName(after).groupBy("source", "vid").agg(F.min("cost").alias("cost")), "cost")
        discard(best, new)
        best, new = whole, after
    return best if ends is None else best.join(ends, "vid", "left_semi").select("source", "vid", "cost")


def project(edges: DataFrame, weight: Column | None = None, direction: str = "out") -> DataFrame:
    """src, dst, weight (1 without an expression) of a projected graph; ``direction``: out, in or both."""
    out = edges.select("src", "dst", (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"))
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]
