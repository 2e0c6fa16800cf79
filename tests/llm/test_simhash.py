import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import simhash
from graphloom.llm.common import staged
from graphloom.llm.components import components
from graphloom.llm.simhash import fingerprint, groups, simhash_components, simhash_dedup


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    s = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps):
    """Component (least index) of each fingerprint."""
    par = list(range(len(fps)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint(spark):
    for t in [None, "", " \t\x0b\n", "One", "a b c", "a b c d", "A  b\nc d e", "É b c d é", "x " * 70_000]:
        assert fingerprint(t) == plain(t)
    same = spark.createDataFrame([("a b c d",)], "s string").select(F.xxhash64("s")).first()[0] & (1 << 64) - 1
    assert same == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_groups_against_all_pairs(spark):
    rng = random.Random(3)
    fps = [0, (1 << 64) - 1, 1 << 63]
    for _ in range(40):
        base = rng.getrandbits(64)
        fps.append(base)
        for _ in range(12):
            x = rng.choice(fps[-5:])
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            fps.append(x)
    want = brute(fps)
    rows = [(i, i, int(np.uint64(x).astype(np.int64))) for i, x in enumerate(fps)]
    df = spark.createDataFrame(rows, "doc_id long, t long, fp long")
    for length in (None, simhash.LONG):  # keys of either width find the same
        got = {r.fp: r.component_id for r in groups(df, length).collect()}
        assert [got[r[2]] for r in rows] == want


def test_patterns_meet_every_pair():
    rng = random.Random(1)
    for length, equal, many in ((simhash.SHORT, 3, 5), (simhash.LONG, 4, 14)):
        patterns = simhash._patterns(length)
        assert len(patterns) == many and {len(p) for p in patterns} == {equal}
        for _ in range(20_000):
            d = [0] * 8
            for b in rng.sample(range(64), simhash.MAX_BITS):
                d[b // 8] += 1
            assert any(not any(d[(start + k) % 8] for k in p) for start in range(8) for p in patterns)


@pytest.mark.parametrize("length", [simhash.SHORT, simhash.LONG])
def test_every_way_to_differ(spark, length):
    """Any four or fewer bits are found, five are not."""
    rng = random.Random(5)
    rows, base = [], 0
    for k in range(1, 6):
        for _ in range(60):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), k):
                b ^= 1 << bit
            rows += [(base, k, a), (base + 1, k, b)]
            base += 2
    df = spark.createDataFrame([(i, k, int(np.uint64(x).astype(np.int64))) for i, k, x in rows], "doc_id long, t long, fp long")
    got = {r.fp: r.component_id for r in groups(df, length).collect()}
    for (i, k, a), (_, _, b) in zip(rows[::2], rows[1::2], strict=True):
        a, b = (got[int(np.uint64(x).astype(np.int64))] for x in (a, b))
        assert (a == b) == (k <= 4), k


def test_odd_input(spark):
    rows = [(5, "a b c d e", 1), (3, "A B C D E", 2), (None, "a b c d e", 3), (7, None, 4), (8, "  ", 5), (9, "other words here now", 6), (9, "other words here now", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = [(r.doc_id, r.component_id) for r in simhash_components(df).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (None, 3), (7, 7), (8, 7), (9, 9), (9, 9)], key=str)
    kept = sorted(((r.doc_id, r.fp) for r in simhash_dedup(df).collect()), key=str)
    assert kept == sorted([(None, 3), (7, 4), (9, 6)], key=str)  # null ids come first; all columns stay
    assert simhash_components(df.limit(0)).collect() == [] and simhash_dedup(df.limit(0)).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, k) for k in range(1001, 1200)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[k] == 1000 for k in range(1000, 1200))
    assert simhash.MAX_BITS == 4


def test_small_components_take_few_jobs(spark):
    """The driver keeps the plan and the tasks of each job, so a small edge table is no matter for rounds."""
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(300)] + [(5000, k) for k in range(5001, 5200)] + [(rng.randrange(10_000, 10_400), rng.randrange(10_000, 10_400)) for _ in range(150)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(3)
    spark.sparkContext.setJobGroup("few", "few")
    one = {r.node: r.component for r in components(df).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    spark.sparkContext.setJobGroup("rounds", "rounds")
    assert one == {r.node: r.component for r in components(df, small=0).collect()}  # a large one goes by rounds
    assert jobs <= 8
    assert components(df.limit(0)).collect() == []


def test_candidates_join_what_four_bits_link(spark):
    rng = random.Random(9)
    fps = [0]
    for _ in range(25):
        fps.append(rng.getrandbits(64))
        for _ in range(6):
            x = rng.choice(fps[-4:])
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps))
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    pairs = simhash.candidates(spark.createDataFrame([(x,) for x in signed], "fp long"))
    found = {r.node: r.component for r in components(pairs).collect()}
    assert all(bin((r.u ^ r.v) & (1 << 64) - 1).count("1") <= simhash.MAX_BITS for r in pairs.collect())
    groups_of = {}
    for x, c in zip(signed, brute(fps), strict=True):
        groups_of.setdefault(c, set()).add(found.get(x, x))
    assert all(len(g) == 1 for g in groups_of.values()) and len(set.union(*groups_of.values())) == len(groups_of)


def test_keys_are_not_broadcast(spark):
    """Spark sizes exploded keys as the table before, far below what the driver would have to hold."""
    rows = [(i * 0x9E3779B97F4A7C15 % (1 << 63), i) for i in range(2000)]
    dense = staged(spark.createDataFrame(rows, "fp long, g long"), "test-dense")
    for length in (simhash.SHORT, simhash.LONG):
        met = simhash._met(dense, length)
        met.collect()
        assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
