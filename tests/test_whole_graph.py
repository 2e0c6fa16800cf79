"""Queries over whole graphs, against brute force and SQL on the smallest tables."""

import os

import pytest

from graphloom.plans.registry import QUERIES, SQL
from graphloom.sources.fixture import social_graph

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def whole(spark):
    """Vertices, and out-neighbours of each, over all labels."""
    g = social_graph(spark, DATA)
    out = {}
    for r in g.all_edges().select("src_label", "src", "dst_label", "dst").collect():
        out.setdefault((r[0], r[1]), []).append((r[2], r[3]))
    return [tuple(r) for r in g.all_vertices().collect()], out


def test_bfs_to_the_end(spark, whole):
    vertices, out = whole
    depth, level = {("person", 0): 0}, [("person", 0)]
    while level:
        step = []
        for v in level:
            for w in out.get(v, []):
                if w not in depth:
                    depth[w] = depth[v] + 1
                    step.append(w)
        level = step
    got = [tuple(r) for r in QUERIES["bfs_whole_graph"](spark, DATA).collect()]
    assert sorted(got) == sorted((*v, depth.get(v, -1)) for v in vertices)


def brute_ranks(vertices, out, rounds, damping=0.85):
    n = len(vertices)
    rank = dict.fromkeys(vertices, 1 / n)
    for _ in range(rounds):
        base = (1 - damping + damping * sum(rank[v] for v in vertices if v not in out)) / n
        got = dict.fromkeys(vertices, base)
        for v, near in out.items():
            for w in near:
                if v in rank and w in got:
                    got[w] += damping * rank[v] / len(near)
        rank = got
    return rank


def test_page_rank_of_every_label(spark, whole):
    want = brute_ranks(*whole, 5)
    got = {(r.label, r.id): r.rank for r in QUERIES["page_rank_all_labels"](spark, DATA).collect()}
    assert got == pytest.approx(want, abs=2e-9) and len({k for k, _ in got}) == 8


def test_runner_ranks_every_label(spark, whole):
    from graphloom.plans.runner import NAMED

    want = brute_ranks(*whole, 2, 0.5)
    got = {(r.label, r.id): r.rank for r in NAMED["page_rank"](social_graph(spark, DATA), 2, 0.5).collect()}
    assert got == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("name", ["expand_out_typed", "expand_in_typed", "union_neighbors", "edges_between", "single_neighbour"])
def test_expansion_from_every_vertex(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
