import random
from collections import Counter

import numpy as np
import xxhash

import corpus_pipeline
from graphloom.llm import near_copies
from graphloom.llm.common import staged
from graphloom.llm.near_copies import near_copy_dedup
from graphloom.llm.simhash import fingerprint


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similar(a, b):
    return len(a & b) * 5 >= 4 * len(a | b)


def brute(texts):
    """Indices that stay (the least of each component), by all pairs of shingle sets."""
    sets = [shingles(t) for t in texts]
    par = list(range(len(texts)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    return {find(i) for i in range(len(texts))}


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


def test_stage_takes_similarity_not_bits(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(300)]
        rows += [" ".join(base)] + [" ".join(edited(rng, base, rng.randint(1, 9))) for _ in range(5)]
    rows += [None, " ", "one two", "ONE  two", "one two three"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(rows)], "doc_id long, text string, lang string")
    far = [i for i in range(0, 150, 6) for j in range(1, 6) if bin(fingerprint(rows[i]) ^ fingerprint(rows[i + j])).count("1") > 4 and similar(shingles(rows[i]), shingles(rows[i + j]))]
    assert len(far) > 10  # pairs that a cut at four bits does not link
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} == brute(rows)


def test_dense_group_and_chain(spark):
    """Many copies of one text, and a chain whose ends are far from each other."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    rows = [" ".join(edited(rng, base, 3)) for _ in range(150)]
    chain = [f"c{i}" for i in range(200)]
    for k in range(40):
        chain[k * 5] = f"d{k}"
        rows.append(" ".join(chain))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id for r in near_copy_dedup(df).collect()} == brute(rows)


def test_group_that_lies_just_apart(spark, monkeypatch):
    """A key of many texts of which few pairs are similar, over several blocks."""
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = [" ".join(edited(rng, base, rng.randint(1, 4))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = brute(rows)
    assert 10 < len(want) < 110 and {r.doc_id for r in near_copy_dedup(df).collect()} == want


def test_shared_shingles(monkeypatch):
    monkeypatch.setattr(near_copies, "_COLUMNS", 3)
    rng = random.Random(5)
    sets = [np.unique([rng.randrange(40) for _ in range(rng.randint(1, 30))]) for _ in range(20)]
    got = near_copies.shared_shingles(np.concatenate(sets), np.array([len(s) for s in sets]))
    assert (got - np.diag(np.diag(got)) == [[len(set(a) & set(b)) if i != j else 0 for j, b in enumerate(sets)] for i, a in enumerate(sets)]).all()


def test_odd_input(spark):
    rows = [(5, "a b c d e f", 1), (3, "A B C D E F", 2), (None, "a b c d e f", 3), (7, None, 4), (8, "  ", 5), (9, "other words here now", 6), (9, "other words here now", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sig int")
    kept = Counter((r.doc_id, r.sig) for r in near_copy_dedup(df).collect())
    assert kept == Counter([(None, 3), (7, 4), (9, 6)])
    assert near_copy_dedup(df.limit(0)).collect() == []


def test_simhash_links_first(spark, monkeypatch):
    """Links of four bits or fewer are checked first, on whole sets; what is farther apart is left to MinHash."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    bits = lambda a, b: bin(near_copies.majority(near_copies.hashes(a)) ^ near_copies.majority(near_copies.hashes(b))).count("1")
    base = [word() for _ in range(400)]
    close = next(t for t in (" ".join([*base[:-1], word()]) for _ in range(100)) if 0 < bits(" ".join(base), t) <= 4)
    far = next(t for t in (" ".join(word() if k in (40, 90, 150, 210, 260, 310) else w for k, w in enumerate(base)) for _ in range(100)) if bits(" ".join(base), t) > 4 and bits(close, t) > 4)
    texts = [" ".join(base), close, far, " ".join(word() for _ in range(400))]
    sig = [int(np.uint64(xxhash.xxh3_64_intdigest(near_copies.shingles(t).tobytes(), near_copies.SEED)).astype(np.int64)) for t in texts]
    asked, check = [], near_copies._linked
    monkeypatch.setattr(near_copies, "_linked", lambda pairs, sets: asked.append(sorted(map(tuple, pairs.collect()))) or check(pairs, sets))
    kept = near_copies.near_copy_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3]
    assert asked[0] == [(min(sig[:2]), max(sig[:2]))]
    assert asked[1] and all(sig[2] in pair for pair in asked[1])


def test_joins_on_keys_are_not_broadcast(spark, monkeypatch):
    """Spark sizes exploded or coded rows far below what the driver would have to hold."""
    plans = {}

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return staged(df, name)

    monkeypatch.setattr(near_copies, "staged", seen)
    rng = random.Random(4)
    base = [rng.choice("abcdefghij") * 3 + str(rng.randrange(50)) for _ in range(120)]
    texts = [" ".join(w if rng.random() > 0.01 else "odd" for w in base) for _ in range(60)]
    near_copies.near_copy_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {"near-shared", "near-apart"} <= set(plans)
    assert not [x for x in ("near-shared", "near-apart", "near-pairs") if any("Broadcast" in line and "key#" in line for line in plans[x].splitlines())]
