"""Approximate nearest neighbours by robust-pruned directed graphs.

Distinct vectors are dealt into shards of bounded size. In each, nodes enter in
random order and growing batches: a greedy beam search proposes neighbours,
relaxed distance pruning keeps edges that no kept, closer neighbour makes
superfluous, and the reverse edges are pruned in turn. Each shard's graph stays in one
task (one for every ``BLOCKS`` blocks of queries), through which the blocks of queries
stream, one at a time; the shards' best are merged.

The measure is the largest inner product. Graphs are built in the space with
one more component that makes all norms equal, where nearest and largest
inner product are the same; returned scores are inner products of the original
vectors in double precision.

Defined results
* vectors that are null, zero, or hold null or non-finite components take no part;
* equal vectors are one node; of each the ``k`` + 1 smallest vec_ids are kept, enough for
  any result, as ties go to the smaller vec_id;
* vectors compare with those of their own length; repeated rows are candidates each;
* null vec_ids take no part; fewer than ``k`` candidates give fewer rows; an empty
  table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import quoted, staged, table
from graphloom.llm.vectors import identity, usable

K, DEGREE, RELAX, BUILD_BEAM, BEAM, SEED = 20, 32, 1.2, 64, 192, 3
SHARD_ROWS, QUERY_ROWS, BLOCKS, BATCH, STARTS, EXPAND = 16_384, 4_096, 16, 1_024, 4, 4


def beam_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and inner products of the ``beam`` best nodes met by each query, best first (-1: none)."""
    m = len(q)
    ids = np.full((m, beam), -1, dtype=np.int32)
    score = np.full((m, beam), -np.inf, dtype=np.float32)
    done = np.ones((m, beam), dtype=bool)
    seen = np.zeros((m, len(x)), dtype=bool)
    s = starts[:beam]
    ids[:, : len(s)], score[:, : len(s)], done[:, : len(s)] = s, q @ x[s].T, False
    seen[:, s] = True
    live = np.arange(m)
    while len(live):
        open_score = np.where(done[live], -np.inf, score[live])
        top = np.argpartition(-open_score, EXPAND - 1, axis=1)[:, :EXPAND] if beam > EXPAND else np.tile(np.arange(beam), (len(live), 1))
        can = np.take_along_axis(open_score, top, 1) > -np.inf
        go = can.any(axis=1)
        live, top, can = live[go], top[go], can[go]
        if not len(live):
            break
        done[live[:, None], top] |= can
        new_ids, new_score = [], []
        for e in range(top.shape[1]):
            node = np.where(can[:, e], ids[live, top[:, e]], 0)
            near = np.where(can[:, e, None], graph[node], -1)
            near[seen[live[:, None], near] | (near < 0)] = -1
            row, col = np.nonzero(near >= 0)
            found = near[row, col]
            seen[live[row], found] = True
            v = np.full(near.shape, -np.inf, dtype=np.float32)
            v[row, col] = np.einsum("ij,ij->i", x[found], q[live[row]])
            new_ids.append(near)
            new_score.append(v)
        all_ids = np.concatenate([ids[live], *new_ids], axis=1)
        all_score = np.concatenate([score[live], *new_score], axis=1)
        all_done = np.concatenate([done[live], np.zeros((len(live), all_ids.shape[1] - beam), dtype=bool)], axis=1)
        best = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
        ids[live], score[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_score, best, 1)
        done[live] = np.take_along_axis(all_done, best, 1) | (ids[live] < 0)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int = DEGREE, relax: float = RELAX) -> np.ndarray:
    """Kept neighbours of each node from its candidates (-1: none), nearest first."""
    out = np.full((len(nodes), degree), -1, dtype=np.int32)
    for at in range(0, len(nodes), 128):
        p, c = nodes[at : at + 128], cand[at : at + 128]
        v = x[np.maximum(c, 0)]
        d = ((v - x[p][:, None]) ** 2).sum(axis=2)
        d[(c < 0) | (c == p[:, None])] = np.inf
        order = np.argsort(d, axis=1)
        c, d, v = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(v, order[:, :, None], 1)
        alive = np.isfinite(d)
        alive[:, 1:] &= c[:, 1:] != c[:, :-1]
        n = (v * v).sum(axis=2)
        between = n[:, :, None] + n[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
        rows = np.arange(len(p))
        for r in range(degree):
            first = alive.argmax(axis=1)
            some = alive[rows, first]
            if not some.any():
                break
            out[at + rows[some], r] = c[rows[some], first[some]]
            alive[rows, first] = False
            alive &= ~some[:, None] | (relax * relax * between[rows, first] > d)
    return out


def _reverse(x: np.ndarray, graph: np.ndarray, source: np.ndarray, out: np.ndarray) -> None:
    """Adds to each neighbour an edge back, pruning where there is no room."""
    src = np.repeat(source, out.shape[1])
    dst = out.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    near = ((x[src] - x[dst]) ** 2).sum(axis=1)
    order = np.lexsort((near, dst))
    src, dst = src[order], dst[order]
    nodes, first, many = np.unique(dst, return_index=True, return_counts=True)
    wide = int(min(many.max(), 3 * DEGREE)) if len(many) else 0
    place = np.arange(len(dst)) - np.repeat(first, many)
    new = np.full((len(nodes), wide), -1, dtype=np.int32)
    fits = place < wide
    new[np.repeat(np.arange(len(nodes)), many)[fits], place[fits]] = src[fits]
    both = np.concatenate([graph[nodes], new], axis=1)
    full = (both >= 0).sum(axis=1) > DEGREE
    rest = np.sort(-both[~full], axis=1)[:, :DEGREE]  # no more than fit, empty places last
    graph[nodes[~full]] = -rest
    if full.any():
        graph[nodes[full]] = robust_prune(x, nodes[full], both[full])


def build(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Graph (neighbours, -1: none) over the rows of ``v``, and the nodes that searches start from."""
    norm = (v.astype(np.float64) ** 2).sum(axis=1)
    x = np.concatenate([v, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], axis=1).astype(np.float32)
    n = len(x)
    graph = np.full((n, DEGREE), -1, dtype=np.int32)
    order = np.random.default_rng(SEED).permutation(n).astype(np.int32)
    core = order[: min(n, 256)]
    graph[core] = robust_prune(x, core, np.tile(core, (len(core), 1)))
    starts, at = core[:STARTS], len(core)
    while at < n:
        p = order[at : at + min(at, BATCH)]
        cand, _ = beam_search(x, graph, starts, x[p], BUILD_BEAM)
        graph[p] = robust_prune(x, p, cand)
        _reverse(x, graph, p, graph[p])
        at += len(p)
    return graph, starts


def _index(shard: pd.DataFrame) -> pd.DataFrame:
    shard = shard.sort_values("uid", ignore_index=True)
    v = np.stack(shard["v"].to_numpy()).astype(np.float64)
    graph, starts = build(v)
    return pd.DataFrame({"dim": shard["dim"].iloc[:1], "shard": shard["shard"].iloc[:1], "uids": [shard["uid"].to_numpy().astype("<i8").tobytes()], "vectors": [v.astype("<f8").tobytes()], "graph": [graph.astype("<i4").tobytes()], "starts": [starts.astype("<i4").tobytes()]})


def _packed(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("uid", ignore_index=True)
    return pd.DataFrame({"dim": block["dim"].iloc[:1], "qb": block["qb"].iloc[:1], "uids": [block["uid"].to_numpy().astype("<i8").tobytes()], "vectors": [np.stack(block["v"].to_numpy()).astype("<f8").tobytes()]})


def _searched(k: int, beam: int):  # noqa: ANN202
    """Rows in order: a shard's index, then the blocks of queries for it, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for b in batches:
            for i in range(b.num_rows):
                r = {name: b.column(name)[i].as_py() for name in ("qb", "uids", "vectors", "graph", "starts")}
                uids = np.frombuffer(r["uids"], "<i8")
                v = np.frombuffer(r["vectors"], "<f8").reshape(len(uids), -1)
                if r["qb"] < 0:
                    index = uids, v, v.astype(np.float32), np.frombuffer(r["graph"], "<i4").reshape(len(uids), -1), np.frombuffer(r["starts"], "<i4")
                    continue
                own, vectors, low, graph, starts = index
                for at in range(0, len(v), BATCH):
                    part = v[at : at + BATCH]
                    ids, _ = beam_search(low, graph, starts, part.astype(np.float32), max(beam, 2 * k))
                    ids = ids[:, : 2 * k]  # more than k + 1, as single precision may order near ties otherwise
                    row, col = np.nonzero(ids >= 0)
                    found = ids[row, col]
                    yield pa.RecordBatch.from_arrays([pa.array(uids[at + row]), pa.array(own[found]), pa.array(np.einsum("ij,ij->i", part[row], vectors[found]))], names=["quid", "uid", "score"])

    return run


def nearest(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 20, k: int = K, beam: int = BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose vec_id is divisible by ``every``."""
    good = vectors.where(usable(quoted(embedding)) & quoted(vec_id).isNotNull())
    h, g = identity(quoted(embedding))
    rows = staged(good.select(quoted(vec_id).alias("vec_id"), h.alias("h"), g.alias("g")), "ann-rows")
    first = Window.partitionBy("h", "g").orderBy("vec_id")
    kept = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("h", "g").agg(F.collect_list("vec_id").alias("vec_ids"))
    one = good.select(h.alias("h"), g.alias("g"), quoted(embedding).cast("array<double>").alias("v")).groupBy("h", "g").agg(F.first("v").alias("v"))
    one = staged(one.join(kept, ["h", "g"]).withColumn("uid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "ann-distinct")
    asked = staged(rows.where(F.pmod("vec_id", F.lit(every)) == 0).join(one.select("h", "g", "uid"), ["h", "g"]).select(F.col("vec_id").alias("query_id"), F.col("uid").alias("quid")), "ann-queries")
    shards = max(1, -(-one.count() // shard_rows))
    index = staged(
        one.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards))).select("dim", "shard", "uid", "v").groupBy("dim", "shard").applyInPandas(_index, "dim int, shard long, uids binary, vectors binary, graph binary, starts binary"),
        "ann-index",
    )
    who = asked.select(F.col("quid").alias("uid")).distinct()
    blocks = max(1, -(-who.count() // QUERY_ROWS))
    packed = staged(one.join(who, "uid", "left_semi").withColumn("qb", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(blocks)).cast("int")).select("dim", "qb", "uid", "v").groupBy("dim", "qb").applyInPandas(_packed, "dim int, qb int, uids binary, vectors binary"), "ann-packed")
    tasks = -(-blocks // BLOCKS)
    none = F.lit(None).cast("binary")
    order = ["dim", "shard", "turn", "qb"]
    held = index.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("turn"), F.lit(-1).alias("qb"), "uids", "vectors", "graph", "starts")
    sent = packed.join(index.select("dim", "shard"), "dim").select("dim", "shard", F.pmod("qb", F.lit(tasks)).alias("turn"), "qb", "uids", "vectors", none.alias("graph"), none.alias("starts"))
    dealt = held.unionByName(sent).repartition(shards * tasks, "dim", "shard", "turn").sortWithinPartitions(*order)
    found = staged(dealt.mapInArrow(_searched(k, beam), "quid long, uid long, score double"), "ann-found")
    named = found.join(one.select("uid", "vec_ids"), "uid").select("quid", "score", F.explode("vec_ids").alias("vec_id"))
    best = Window.partitionBy("quid").orderBy(F.col("score").desc(), "vec_id")
    top = staged(
        named.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
        .groupBy("quid").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("top")),
        "ann-top",
    )
    own = F.filter("top", lambda t: t["vec_id"] != F.col("query_id"))
    return asked.join(top, "quid").select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "t")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
