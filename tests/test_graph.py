"""A hand-made graph with known answers, one test for each kind of operator and each documented pitfall."""

import datetime
import heapq
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.graph import EdgeKind, PropertyGraph, edge_info, symmetrized
from graphloom.operators import algorithms, expand, filters, text, topk, traverse
from graphloom.plans import intelligence, interactive

D = datetime.date


@pytest.fixture(scope="module")
def g(spark):
    """Persons 0-9: 9 is alone, 7-8 a component of its own; 0-1-2-3-0 is a cycle, 4 and 5 hang on it, 6 on 5."""
    person = [(i, f"F{i % 3}", f"L{i}", D(1980, 12, 25) if i == 2 else D(1981, 1, 5) if i == 5 else D(1980, 6, 1), "x", i % 2) for i in range(10)]
    knows = [(0, 1), (1, 2), (2, 3), (0, 3), (3, 4), (4, 5), (5, 6), (7, 8)]
    # post 0 <- comment 1 <- comment 2 (the tag is only on the leaf); post 3 stands alone; post 4 <- comment 5
    message = [(0, 0, D(2020, 1, 1), 10, "en", "post", "", "a.jpg"), (1, 1, D(2020, 1, 2), 20, "xx", "comment", "hi", ""), (2, 0, D(2020, 1, 3), 30, "xx", "comment", "yo", ""),
               (3, 2, D(2020, 4, 15), 0, "de", "post", "text", "b.jpg"), (4, 3, D(2020, 1, 1), 50, "en", "post", "more", ""), (5, 0, D(2020, 1, 9), 5, "xx", "comment", "re", "")]
    frame = spark.createDataFrame
    edge = lambda rows, extra="": frame(rows, "src long, dst long" + extra)
    return PropertyGraph(
        {
            "person": frame(person, "id long, firstName string, lastName string, birthday date, gender string, cityId long"),
            "city": frame([(0, "C0", 0), (1, "C1", 1)], "id long, name string, countryId long"),
            "country": frame([(0, "North"), (1, "South")], "id long, name string"),
            "tag": frame([(0, "t0", "A"), (1, "t1", "B"), (2, "unused", "A")], "id long, name string, tagclass string"),
            "tagclass": frame([(0, "A"), (1, "B")], "id long, name string"),
            "message": frame(message, "id long, creator long, day date, length long, language string, kind string, content string, imageFile string"),
            "forum": frame([(0, "f0"), (1, "f1")], "id long, title string"),
            "organisation": frame([(0, "university", "U", 0), (1, "company", "W", 1)], "id long, type string, name string, placeId long"),
        },
        {
            EdgeKind("person", "knows", "person"): symmetrized(edge(knows)),
            EdgeKind("person", "isLocatedIn", "city"): edge([(i, i % 2) for i in range(10)]),
            EdgeKind("city", "isPartOf", "country"): edge([(0, 0), (1, 1)]),
            EdgeKind("message", "hasCreator", "person"): edge([(m[0], m[1]) for m in message]),
            EdgeKind("message", "replyOf", "message"): edge([(1, 0), (2, 1), (5, 4)]),
            EdgeKind("message", "hasTag", "tag"): edge([(2, 0), (3, 0), (3, 1), (4, 1)]),
            EdgeKind("tag", "hasType", "tagclass"): edge([(0, 0), (1, 1), (2, 0)]),
            EdgeKind("forum", "containerOf", "message"): edge([(0, 0), (1, 3), (1, 4)]),
            EdgeKind("forum", "hasMember", "person"): edge([(0, 1, D(2020, 1, 5)), (0, 0, D(2019, 1, 1)), (1, 3, D(2021, 1, 1)), (1, 3, D(2018, 1, 1))], ", joinDate date"),
            EdgeKind("forum", "hasModerator", "person"): edge([(0, 0), (1, 1)]),
            EdgeKind("person", "hasInterest", "tag"): edge([(0, 0)]),
            EdgeKind("person", "studyAt", "organisation"): edge([(1, 0, 1999)], ", classYear int"),
            EdgeKind("person", "workAt", "organisation"): edge([(1, 1, 2005), (1, 1, 2001)], ", workFrom int"),
        },
    )


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def test_lookup(g):
    assert rows(g.vertex("person", 0), "lastName") == [("L0",)]  # id 0 is a vertex like any other
    assert rows(g.vertex("person", 77)) == []  # an unknown id has no row
    assert rows(g.by_property("person", "firstName", "F1"), "id") == [(1,)]  # of several, the smallest
    assert rows(g.by_property("person", "firstName", "none")) == []
    with pytest.raises(LookupError):
        g.require("tag", "name", "none")


def test_counts_and_degrees(g):
    assert ("person", 10) in rows(g.label_counts())
    assert ("person", "knows", "person", 16) in rows(g.edge_kind_counts())
    deg = dict(rows(expand.degrees(g.vertices["person"], g.edge("knows"))))
    assert deg[9] == 0 and deg[3] == 3 and sum(deg.values()) == 16
    assert rows(expand.degree_statistics(g.vertices["person"], g.edge("knows"))) == [(10, 16, 3, 3, 1.6)]


def test_edge_info_and_parallel_edges(g, spark):
    e = g.edge("hasMember").where("src = 1")
    assert sorted(rows(e.select(edge_info("hasMember", e)))) == [("hasMember|2018-01-01",), ("hasMember|2021-01-01",)]
    late = expand.out_neighbours(g.vertices["forum"].select(F.col("id").alias("vid")), g.edge("hasMember"), where=F.col("joinDate") > F.lit(D(2020, 6, 1)))
    assert rows(late) == [(1, 3)]  # the second of two parallel edges decides
    pair = spark.createDataFrame([(1, 3)], "src long, dst long")
    assert expand.edges_between(g.edge("hasMember"), pair).count() == 2


def test_expand(g):
    f = g.vertices["person"].where("id = 3").select(F.col("id").alias("vid"))
    assert sorted(rows(expand.out_neighbours(f, g.edge("knows")), "nbr")) == [(0,), (2,), (4,)]
    assert sorted(rows(expand.both_neighbours(f, g.edge("knows")), "nbr")) == [(0,), (2,), (4,)]
    assert sorted(rows(expand.in_neighbours(f, g.edge("hasCreator")), "nbr")) == [(4,)]
    found = expand.conditional_fetch(g.vertices["forum"].select(F.col("id").alias("vid")), g.edge("hasMember"), g.vertices["person"], None, F.col("firstName") == "F0")
    assert sorted(rows(found.select("vid", "nbr"))) == [(0, 0), (1, 3), (1, 3)]


def test_filters(g, spark):
    m = g.vertices["message"]
    assert sorted(rows(m.where(filters.typed_compare("length", "<", -1, "long")))) == []  # signed
    assert m.where(filters.typed_compare("day", "=", "2020-01-01", "date")).count() == 2
    t = spark.createDataFrame([(datetime.datetime(2020, 1, 1, 23, 59),)], "ts timestamp")
    assert t.where(filters.typed_compare("ts", "<=", "2020-01-01", "timestamp")).count() == 1  # by day
    assert sorted(rows(g.vertices["person"].where(filters.month_band(F.col("birthday"), 12)), "id")) == [(2,), (5,)]  # December goes on in January
    assert rows(m.where("id = 0").select(filters.content_or(F.col("content"), F.col("imageFile")))) == [("a.jpg",)]
    assert sorted(rows(m.where(filters.day_window(F.col("day"), "2020-01-01", 100, 100)), "id")) == [(3,)]


def test_bfs(g, spark):
    depth = dict(rows(traverse.bfs(g.vertices["person"], g.edge("knows"), 0)))
    assert depth == {0: 0, 1: 1, 3: 1, 2: 2, 4: 2, 5: 3, 6: 4, 7: None, 8: None, 9: None}
    for r in g.edge("knows").collect():
        if depth[r.src] is not None:
            assert abs(depth[r.src] - depth[r.dst]) <= 1
    assert set(dict(rows(traverse.bfs(g.vertices["person"], g.edge("knows"), 99))).values()) == {None}
    again = traverse.bfs(g.vertices["person"].repartition(7), g.edge("knows").repartition(3), 0)
    assert dict(rows(again)) == depth  # whatever the partitions


def test_hops(g):
    k = g.edge("knows")
    assert rows(traverse.khop_count(k, 0, 2)) == [(4,)]
    assert sorted(rows(traverse.friends(k, 0, 3, 4), "vid")) == [(5,), (6,)]
    assert rows(interactive.ic13(g, 0, 6)) == rows(interactive.ic13(g, 6, 0)) == [(4,)]
    assert rows(interactive.ic13(g, 0, 0)) == [(0,)] and rows(interactive.ic13(g, 0, 9)) == [(-1,)]


def test_paths(g):
    e = g.edge("knows").withColumn("info", F.lit("k"))
    p = traverse.search_paths(traverse.one(e, 0), e, 2)
    told = dict(rows(p.select("vid", traverse.format_path(F.col("path")))))
    assert told == {0: "0", 1: "0->[k]1", 3: "0->[k]3", 2: "0->[k]1->[k]2", 4: "0->[k]3->[k]4"}
    assert dict(rows(traverse.children(p)))[0] == [1, 3]
    r = g.edge("replyOf").withColumn("info", F.lit("r"))
    both = traverse.in_out_paths(traverse.one(r, 1), r, 3)
    assert sorted(rows(both, "vid", "depth", "direction")) == [(0, 1, "out"), (1, 0, "in"), (1, 0, "out"), (2, 1, "in")]


def test_roots(g):
    assert sorted(rows(traverse.roots(g.edge("replyOf"), g.vertices["message"]))) == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 3, 0), (4, 4, 0), (5, 4, 1)]


def test_roots_of_odd_replies(spark):
    """A reply to an unknown vertex or to itself is a root; cycles have none; of two parents the smaller counts."""
    v = spark.range(10)
    e = spark.createDataFrame([(1, 0), (2, 99), (3, 2), (4, 4), (5, 6), (6, 7), (7, 5), (8, 5), (9, 3), (9, 1)], "src long, dst long")
    got = {r.id: (r.root, r.depth) for r in traverse.roots(e, v).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (2, 0), 3: (2, 1), 4: (4, 0), 5: (None, None), 6: (None, None), 7: (None, None), 8: (None, None), 9: (0, 2)}


def test_long_chain_roots(spark):
    v = spark.range(300)
    e = spark.range(1, 300).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    assert rows(traverse.roots(e, v).agg(F.max("root"), F.max("depth"))) == [(0, 299)]


def test_page_rank(g, spark):
    r = dict(rows(algorithms.page_rank(g.vertices["person"], g.edge("knows"), 20, 0.85)))
    assert abs(sum(r.values()) - 1) < 1e-9 and r[3] == max(r.values())
    again = dict(rows(algorithms.page_rank(g.vertices["person"].repartition(5), g.edge("knows").repartition(6), 20, 0.85)))
    assert all(abs(r[k] - again[k]) < 1e-12 for k in r)
    line = spark.createDataFrame([(0, 1)], "src long, dst long")  # 1 is a sink
    got = dict(rows(algorithms.page_rank(spark.range(2), line, 1, 0.5)))
    assert got == {0: pytest.approx(0.25 + 0.125), 1: pytest.approx(0.25 + 0.125 + 0.25)}


def test_weights_and_costs(g, spark):
    w = {(a, b): x for a, b, x in rows(intelligence.weighted_knows(g))}
    assert w[0, 1] == w[1, 0] == 39 and w[0, 3] == 39 and w[7, 8] == 40  # two replies between 0 and 1, one between 0 and 3
    many = spark.createDataFrame([(0, 1)] * 1600, "a long, b long")
    assert {x for *_, x in rows(algorithms.interaction_weights(g.edge("knows").where("src = 0 and dst = 1"), many))} == {1.0}
    cost = {(a, b): c for a, b, c in rows(algorithms.shortest_costs(intelligence.weighted_knows(g), g.vertices["person"].where("id = 0").select(F.col("id").alias("vid"))), "source", "vid", "cost")}
    hops = dict(rows(traverse.bfs(g.vertices["person"], g.edge("knows"), 0)))
    assert all(hops[b] <= c <= 40 * hops[b] for (_, b), c in cost.items()) and (0, 9) not in cost
    got = {(a, b): x for a, b, x in rows(intelligence.bi19(g, 0, 1))}
    back = {(b, a): x for a, b, x in rows(intelligence.bi19(g, 1, 0))}
    assert got == back and got[0, 1] == 39 and (0, 9) not in got


def test_interactive(g):
    recent = rows(interactive.ic2(g, 0, "2020-01-02"), "personId", "messageId", "content")
    assert recent == [(1, 1, "hi"), (3, 4, "more")]  # latest first, up to and with the day
    assert [r[1] for r in rows(interactive.ic9(g, 0, "2020-12-31"), "personId", "messageId")] == [3, 1, 4]
    ic1 = rows(interactive.ic1(g, 0, "F1"), "id", "distance", "universities", "companies")
    assert ic1 == [(1, 1, "U,1999,C0", "W,2001,C1;W,2005,C1"), (4, 2, "", "")]
    assert rows(interactive.ic5(g, 0, "2020-01-01")) == [("f1", 1, 1), ("f0", 0, 0)]
    assert rows(interactive.ic10(g, 0, 12), "id", "score") == [(2, 1)]
    assert rows(interactive.khops(g, 0)) == [(5,)]


def test_intelligence(g):
    assert rows(intelligence.bi2(g, "2020-01-01", "A")) == [("t0", 1, 1, 0), ("unused", 0, 0, 0)]
    assert rows(intelligence.bi3(g, "A", "North")) == [(0, "f0", 0, 1)]  # only the leaf comment has the tag; moderator, not member
    assert rows(intelligence.bi10(g, 0, "North", "A", 2, 4)) == [(2, "t0", 1), (2, "t1", 1)]
    assert rows(intelligence.bi12(g, "2020-01-01", 40, ["en"])) == [(1, 1), (2, 1)] or rows(intelligence.bi12(g, "2020-01-01", 40, ["en"])) == [(2, 1), (1, 1)]
    assert rows(intelligence.bi16(g, 0, "2020-04-15", 1, "2020-04-15")) == [(2, 1, 1)]
    assert rows(intelligence.bi16(g, 0, "2020-04-15", 0, "2020-04-15")) == [(2, 1, 1)]  # the same tag twice
    assert rows(intelligence.bi16(g, 0, "2020-01-03", 0, "2020-01-03")) == [(0, 1, 1)]  # person 0 counts


def test_top(g):
    full = rows(g.vertices["message"].orderBy(F.col("length").desc(), "id"), "id")
    assert rows(topk.top(g.vertices["message"], 3, F.col("length").desc(), "id"), "id") == full[:3]


def test_text(spark):
    t = spark.createDataFrame([(1, "aaaa"), (2, "b.b"), (3, ""), (4, None), (5, "é𝒳aa")], "k long, s string")
    assert rows(text.count(t, "s", "aa")) == [(4,)]  # overlapping
    assert rows(text.count(t, "s", "")) == [(0,)]
    assert rows(text.count(t, "s", ".")) == [(1,)]  # literal
    assert sorted(rows(text.locate(t, "k", "s", "aa"))) == [(1, 0), (1, 1), (1, 2), (5, 2)]
    assert text.locate(t, "k", "s", "").count() == 0
    for p in ("a", "aa", "b", "."):
        assert rows(text.count(t, "s", p))[0][0] == text.locate(t, "k", "s", p).count()
    assert dict(rows(text.extract(t, "k", "s", 1, 2))) == {1: "aa", 2: ".b", 3: None, 4: None, 5: "𝒳a"}
    assert rows(text.rows_containing(t, "k", "s", "a", 2, 9)) == [(5,)]
    assert rows(text.statistics(t, "s")) == [(5, 11, 15, 5)]


def test_lists_in_parts(g):
    k = g.edge("knows")
    assert rows(expand.first_neighbours(k, 3, 2)) == [(0,), (2,)]
    assert rows(expand.first_neighbours(k, 3, 2, after=2)) == [(4,)]
    m = g.vertices["message"].select(F.col("id").alias("vid"))
    assert dict(rows(expand.single_neighbour(m, g.edge("hasCreator"))))[5] == 0
    with pytest.raises(Exception, match="not exactly one neighbour"):
        expand.single_neighbour(m, g.edge("hasTag")).collect()


def test_projection(g, tmp_path):
    one = g.edge("replyOf").where("src = 1")
    assert rows(algorithms.project(one)) == [(1, 0, 1.0)] and rows(algorithms.project(one, F.col("src") * 2, "in")) == [(0, 1, 2.0)]
    assert algorithms.project(one, direction="both").count() == 2
    path = str(tmp_path / "weights")
    first = sorted(rows(intelligence.saved_weights(g, path)))
    assert first == sorted(rows(intelligence.saved_weights(g, path))) == sorted(rows(intelligence.weighted_knows(g)))
    assert rows(intelligence.bi19(g, 0, 1, intelligence.saved_weights(g, path))) == rows(intelligence.bi19(g, 0, 1))


def test_costs_by_component(spark, monkeypatch):
    """Sources of a large graph meet the edges of their own component; the rows are those of the other ways."""
    rng = random.Random(11)
    edges = [(base + rng.randrange(30), base + rng.randrange(30), float(rng.randint(1, 40))) for base in (0, 100, 200) for _ in range(70)] + [(300, 300, 1.0)]
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    sources, targets = (spark.createDataFrame([(x,) for x in xs], "vid long") for xs in ([0, 1, 2, 105, 106, 210, 300, 999], [3, 0, 107, 108, 211, 999, 1000]))
    monkeypatch.setattr(algorithms, "WORK", 100)  # several parts of a component
    for ends in (None, targets):
        want = sorted(rows(algorithms.shortest_costs(e, sources, ends), "source", "vid", "cost"))
        assert sorted(rows(algorithms.shortest_costs(e, sources, ends, small=0), "source", "vid", "cost")) == want
        assert sorted(rows(algorithms.shortest_costs(e, sources, ends, small=0, component=60), "source", "vid", "cost")) == want  # by rounds
    assert {(0, 0, 0.0), (999, 999, 0.0)} <= set(want)


def _dijkstra(n, edges, start):
    out, heap, near = {}, [(0, start)], [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
    while heap:
        cost, v = heapq.heappop(heap)
        if v not in out:
            out[v] = cost
            for b, w in near[v]:
                heapq.heappush(heap, (cost + w, b))
    return out


@pytest.mark.parametrize("most, hub", [(1, 0), (4, 0), (64, 0), (3, 150)])
def test_whole_weights_go_by_cost(monkeypatch, most, hub):
    """Sets of sources as bits give the costs of Dijkstra's search; a vertex may have very many in-edges."""
    monkeypatch.setattr(algorithms, "WIDE", 1)  # more than one run of sources
    rng = np.random.default_rng(most)
    n = 300
    src, dst = rng.integers(0, n, 700 + hub), np.concatenate([rng.integers(0, n, 700), np.full(hub, 7)])
    order = np.argsort(dst, kind="stable")
    src, dst, weight = src[order], dst[order], rng.integers(1, most + 1, 700 + hub)[order].astype(float)
    into, first = np.unique(dst, return_index=True)
    sources, wanted = rng.permutation(n)[:130], np.unique(rng.integers(0, n, 90))
    rows = [(int(a), int(b), c) for x in algorithms._relaxed(n, src, weight, into, first, sources, wanted) for a, b, c in zip(*x, strict=True)]
    edges = list(zip(src.tolist(), dst.tolist(), weight.tolist(), strict=True))
    want = {(s, v): c for s in sources.tolist() for v, c in _dijkstra(n, edges, s).items() if v in set(wanted.tolist())}
    assert len(rows) == len(want) and {(a, b): c for a, b, c in rows} == want


def test_many_sources_read_an_edge_together():
    """Whole weights cost a fraction of others, whose sources are relaxed each by itself."""
    rng = np.random.default_rng(3)
    n, m = 20_000, 80_000
    src, dst = rng.integers(0, n, m), np.sort(rng.integers(0, n, m))
    into, first = np.unique(dst, return_index=True)
    took, rows = [], []
    for part in (0.0, 0.5):
        weight = rng.integers(39, 41, m) + part
        began = time.process_time()
        rows.append(sum(len(x[0]) for x in algorithms._relaxed(n, src, weight, into, first, np.arange(256), np.arange(100))))
        took.append(time.process_time() - began)
    assert rows[0] == rows[1] and 2 * took[0] < took[1]
