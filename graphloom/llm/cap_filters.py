"""Near-dedup of embeddings with spherical-cap filters.

Filter directions are structured: a vector is cut into two blocks, each block
has a random code of ``CODE`` unit words, and every pair of words is a
direction, a million in all. Two sorted lists of block scores decode a vector to
all directions that exceed its threshold, a share of its best score, so that no
vector is left without filters. Vectors of a cap and label are verified in
double precision.

Equal vectors are one from the start and count by their number. The members of
a cap are dealt into blocks of bounded size and pairs of blocks are verified
as matrices; each yields a link count and a spanning forest for its
members, not the pairs. A pair met in several caps counts in the first one.

Defined results
* vectors that are null, zero, or hold null or non-finite components, and those without a
  label, link with nothing: n_links 0, component_id their own vec_id;
* vectors of different lengths never link; repeated rows count as vectors each;
* a null vec_id takes part; the smallest non-null vec_id names a component;
* an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import quoted, staged, table
from graphloom.llm.components import components
from graphloom.llm.vectors import identity, matrix, usable

COSINE, CODE, SHARE, SEED = 0.98, 1024, 0.86, 5
#: Members of a block; a task holds two blocks at a time.
BLOCK = 512


def code(dim: int, words: int = CODE) -> tuple[np.ndarray, np.ndarray]:
    """Unit words of the two blocks of vectors of length ``dim``."""
    rng = np.random.default_rng(SEED + dim)
    halves = []
    for n in ((dim + 1) // 2, dim // 2):
        w = rng.normal(size=(words if n else 1, max(n, 1)))
        halves.append(w / np.linalg.norm(w, axis=1, keepdims=True) if n else np.zeros((1, 0)))
    return halves[0], halves[1]


def decode(units: np.ndarray, words: tuple[np.ndarray, np.ndarray], share: float = SHARE) -> list[np.ndarray]:
    """Of each unit vector all directions that score at least ``share`` of its best, sorted."""
    cut, out = words[0].shape[1], []
    a, b = units[:, :cut] @ words[0].T, units[:, cut:] @ words[1].T
    ia, ib = np.argsort(-a, axis=1), np.argsort(-b, axis=1)
    sa, sb = np.take_along_axis(a, ia, 1), np.take_along_axis(b, ib, 1)
    for k in range(len(units)):
        least = share * (sa[k, 0] + sb[k, 0])
        # In each list only words that exceed together with the other's best.
        na, nb = np.searchsorted(-sa[k], sb[k, 0] - least, side="right"), np.searchsorted(-sb[k], sa[k, 0] - least, side="right")
        x, y = np.nonzero(sa[k, :na, None] + sb[k, None, :nb] >= least)
        out.append(np.sort(ia[k, x] * len(words[1]) + ib[k, y]))
    return out


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict = {}
    for b in batches:
        dims = b.column("dim").to_numpy()
        lists: list = [None] * len(dims)
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            for at in range(0, len(rows), 1024):
                part = rows[at : at + 1024]
                v = matrix(b.column("v").take(pa.array(part)))
                if d not in words:
                    words[d] = code(int(d))
                for i, found in zip(part, decode(v / np.linalg.norm(v, axis=1, keepdims=True), words[d]), strict=True):
                    lists[i] = found
        yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(lists, pa.list_(pa.int32()))], names=["uid", "caps"])


def _forest(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id reachable in the block for each row of a symmetric link matrix."""
    root = ids.copy()
    while True:
        least = np.minimum(root, np.where(links, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (least == root).all():
            return root
        root = least


def _first_met(caps: list[np.ndarray], cap: int) -> np.ndarray:
    """Whether two members share no cap before this one."""
    before = [c[: np.searchsorted(c, cap)] for c in caps]
    names = np.unique(np.concatenate(before))
    held = np.zeros((len(caps), len(names)), dtype=np.float32)
    for i, c in enumerate(before):
        held[i, np.searchsorted(names, c)] = 1
    return held @ held.T == 0


def _verify(g: dict, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """uid, links, root of the members of one pair of blocks that have a link in it."""
    v = g["v"][lo:hi]
    near = v @ v.T >= COSINE
    np.fill_diagonal(near, False)
    if g["bi"][lo] != g["bj"][lo]:  # pairs inside a block belong to its own group
        near &= g["own"][lo:hi, None] != g["own"][None, lo:hi]
    uid = g["uid"][lo:hi]
    some = np.flatnonzero(near.any(axis=1))
    if not len(some):
        return uid[:0], uid[:0], uid[:0]
    near, uid = near[np.ix_(some, some)], uid[some]
    counted = near & _first_met([g["caps"][lo + i] for i in some], g["cap"][lo])
    return uid, counted @ g["n"][lo:hi][some], _forest(near, uid)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of sorted rows, which may go on over batches."""
    rest: pa.Table | None = None

    def run(t: pa.Table, last: bool) -> tuple[list, pa.Table | None]:
        key = np.stack([t.column(c).to_numpy() for c in ("label", "dim", "cap", "bi", "bj")])
        starts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [t.num_rows]])
        end = len(starts) - 1 if last else len(starts) - 2
        found = []
        if end > 0:
            part = t.slice(0, int(starts[end])).combine_chunks()
            cols = {c: part.column(c).to_numpy() for c in ("uid", "n", "cap", "bi", "bj", "own", "dim")}
            caps = part.column("caps").combine_chunks()
            caps = caps.chunk(0) if isinstance(caps, pa.ChunkedArray) else caps
            off, flat = caps.offsets.to_numpy(), caps.values.to_numpy()
            held = [flat[a:b] for a, b in zip(off, off[1:], strict=False)]
            vectors = part.column("v").combine_chunks()
            vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
            for lo, hi in zip(starts[:end], starts[1 : end + 1], strict=True):
                v = matrix(vectors.slice(lo, hi - lo))
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                g = {c: a[lo:hi] for c, a in cols.items()} | {"v": v, "caps": held[lo:hi]}
                found.append(_verify(g, 0, hi - lo))
        return found, (None if last else t.slice(int(starts[end])))

    def rows(found: list) -> Iterator[pa.RecordBatch]:
        found = [f for f in found if len(f[0])]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], names=["uid", "links", "root"])

    for b in batches:
        t = pa.Table.from_batches([b])
        found, rest = run(pa.concat_tables([rest, t]) if rest is not None and rest.num_rows else t, False) if b.num_rows else ([], rest)
        yield from rows(found)
    if rest is not None and rest.num_rows:
        yield from rows(run(rest, True)[0])


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept, for each row."""
    good = usable(quoted(embedding)) & quoted(label).isNotNull()
    h, g = identity(quoted(label), quoted(embedding))
    rows = staged(vectors.select(quoted(vec_id).alias("vec_id"), F.when(good, h).alias("h"), F.when(good, g).alias("g")), "caps-rows")
    one = (
        vectors.where(good).select(h.alias("h"), g.alias("g"), quoted(vec_id).alias("vec_id"), quoted(embedding).cast("array<double>").alias("v"), F.xxhash64(quoted(label)).alias("label"))
        .groupBy("h", "g").agg(F.first("v").alias("v"), F.first("label").alias("label"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
        .withColumn("dim", F.size("v")).withColumn("uid", F.monotonically_increasing_id())
    )
    one = staged(one, "caps-distinct")  # row numbers must not change between uses
    lists = staged(one.select("uid", "dim", "v").mapInArrow(_decoded, "uid long, caps array<int>"), "caps-lists")
    cells = one.select("uid", "label", "dim").join(lists.select("uid", F.explode("caps").alias("cap")), "uid")
    sizes = staged(cells.groupBy("label", "dim", "cap").agg(F.count("*").alias("size")).where("size > 1"), "caps-sizes")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.hash("uid"), blocks).cast("int")
    met = (
        cells.join(sizes, ["label", "dim", "cap"]).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("label", "dim", "cap", "uid", "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))
    )
    met = staged(met, "caps-met")
    whole = met.join(one.select("uid", "v", "n"), "uid").join(lists, "uid").select("label", "dim", "cap", "bi", "bj", "own", "uid", "n", "v", "caps")
    order = ["label", "dim", "cap", "bi", "bj"]
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = staged(whole.repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(_verified, "uid long, links long, root long"), "caps-found")
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    joined = components(found.where("uid != root").select(F.col("uid").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("uid"), F.col("component").alias("c"))
    named = staged(one.select("uid", "h", "g", "n", "least").join(links, "uid", "left").join(joined, "uid", "left").select("h", "g", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least", F.coalesce("c", "uid").alias("c")), "caps-named")
    first = staged(named.groupBy("c").agg(F.min("least").alias("component_id")), "caps-first")
    named = staged(named.join(first, "c").select("h", "g", "n_links", "component_id"), "caps-named")
    out = rows.join(named, ["h", "g"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id
"""
