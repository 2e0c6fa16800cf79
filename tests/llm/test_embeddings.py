import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import cap_filters, graph_search


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def vectors():
    """Clusters of near copies of several tightness, exact copies, scaled copies, and lone vectors."""
    rng = np.random.default_rng(2)
    rows = []
    for c in range(20):
        base = unit(rng.normal(size=(1, 32)))
        for _ in range(1 + 6 * (c % 5)):
            rows.append((c % 3, (base + rng.normal(size=(1, 32)) * rng.choice([0.005, 0.02, 0.03]))[0] * rng.choice([1.0, 3.0])))
    rows += [(k % 3, v) for k, v in enumerate(rng.normal(size=(150, 32)))]
    rows += [rows[3]] * 4
    order = rng.permutation(len(rows))
    return [(int(i), [float(x) for x in rows[k][1]], rows[k][0]) for i, k in enumerate(order)]


ODD = [(9000, None, 1), (9001, [0.0] * 32, 1), (9002, [float("nan")] * 32, 1), (9003, [1.0, None] + [1.0] * 30, 1), (9004, [float("inf")] * 32, 1), (9005, [1.0] * 32, None), (9006, [1.0] * 5, 1), (9007, [], 1)]


def test_links_against_all_pairs(spark, vectors, monkeypatch):
    df = spark.createDataFrame(vectors + ODD, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit(1)).repartition(3)
    v, lab = unit(np.array([r[1] for r in vectors])), np.array([r[2] for r in vectors])
    near = (v @ v.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(near, False)
    root = np.arange(len(v))
    while True:
        new = np.minimum(root, np.where(near, root[None, :], len(v)).min(axis=1))
        if (new == root).all():
            break
        root = new
    for block in (512, 3):  # small blocks: pairs of blocks give the same
        monkeypatch.setattr(cap_filters, "BLOCK", block)
        got = {r.vec_id: r for r in cap_filters.near_duplicates(df).collect()}
        assert len(got) == len(vectors) + len(ODD)
        for i in range(len(v)):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), root[i], root[i] == i)
        assert all((got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (0, r[0], True) for r in ODD)
    assert cap_filters.near_duplicates(df.limit(0)).collect() == []


def test_decode_lists_all_that_exceed():
    rng = np.random.default_rng(0)
    words = cap_filters.code(10, 40)
    u = unit(rng.normal(size=(30, 10)))
    every = (u[:, :5] @ words[0].T)[:, :, None] + (u[:, 5:] @ words[1].T)[:, None, :]
    for k, got in enumerate(cap_filters.decode(u, words)):
        flat = every[k].ravel()
        want = np.flatnonzero(flat >= cap_filters.SHARE * flat.max() - 1e-12)
        assert got.tolist() == want.tolist()


def exact(rows, every, k):
    good = [(i, np.array(v)) for i, v, _ in rows if i is not None and v and len(v) == 32 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([g[0] for g in good]), np.stack([g[1] for g in good])
    out = {}
    for i, q in good:
        if i % every == 0:
            s = x @ q
            s[ids == i] = -np.inf
            out[i] = [int(ids[j]) for j in np.lexsort((ids, -s))[:k]]
    return out


def test_search(spark, vectors):
    rows = vectors + [(20_000 + i, vectors[0][1], 0) for i in range(40)] + ODD
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit(1)).repartition(3)
    got: dict = {}
    for r in graph_search.nearest(df, every=10, shard_rows=150).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    want = exact(rows, 10, 20)
    five = {9006, 9007}
    assert set(got) - five == set(want)
    hit = sum(len({r.vec_id for r in got[q]} & set(w)) for q, w in want.items()) / sum(map(len, want.values()))
    assert hit >= 0.97
    assert all([r["rank"] for r in own] == list(range(1, len(own) + 1)) and q not in {r.vec_id for r in own} for q, own in got.items())
    place = {i: np.array(v) for i, v, _ in rows if v}
    assert all(r.score == pytest.approx(float(place[q] @ place[r.vec_id]), rel=1e-12) for q, own in got.items() for r in own)
    assert graph_search.nearest(df.limit(0)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.vec_id) for r in graph_search.nearest(few).collect()} == {(0, 20), (20, 0)}


def test_recall_of_the_graph():
    x = unit(np.random.default_rng(5).normal(size=(3000, 64)))
    graph, starts = graph_search.build(x)
    ids, _ = graph_search.beam_search(x.astype(np.float32), graph, starts, x[:200].astype(np.float32), graph_search.BEAM)
    want = np.argsort(-(x[:200] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a[:20]) & set(b)) / 20 for a, b in zip(ids, want, strict=True)]) >= 0.95
