import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import quality, toxicity
from graphloom.llm.labelled import held_out, learning_rows


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 8)))
    vocabulary, docs, labels = [word() for _ in range(300)], [], []
    for i in range(900):
        words = [str(w) for w in rng.choice(vocabulary, rng.integers(20, 150))]
        toxic, good = i % 5 == 0, i % 4 != 1
        if toxic:
            for k in rng.integers(0, len(words), max(1, len(words) // 15)):
                words[k] = str(rng.choice(["zidiot", "zmoron"])) if i % 2 else "vile" + word()
        text = " ".join(words)
        docs.append((i, text if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def accuracy(scored, labels, label, cut):
    rows = scored.join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    return np.mean([(r.score >= cut) == (r[label] == 1) for r in rows])


def test_fold(spark):
    got = {r.id: r.h for r in spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_sample_is_bounded_and_outside_the_fold(spark, corpus):
    docs, labels = corpus
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (4, 7, 7)], labels.schema))
    assert learning_rows(docs, odd, "quality", 40).count() == 40
    out = learning_rows(docs.withColumn("text", F.col("doc_id").cast("string")), odd, "quality", 10_000).collect()
    assert out and all(zlib.crc32(r.text.encode()) % 5 for r in out)


def test_quality(spark, corpus):
    docs, labels = corpus
    model = quality.learn(docs, labels)
    assert accuracy(docs.select("doc_id", quality.score(model, F.col("text")).alias("score")), labels, "quality", quality.CUT) > 0.95
    odd = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "\n \t", 3), (4, "é" * 100_000, 4)], "doc_id long, text string, score int")
    got = [r.p for r in odd.select(quality.score(model, F.col("text")).alias("p")).collect()]
    assert all(0 <= p <= 1 for p in got) and got[0] == got[1] == got[2]
    kept = quality.quality_filter(docs.withColumn("score", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "score"] and 600 < kept.count() < 760
    assert quality.score(None or quality.fit(np.zeros((0, 21)), np.zeros(0)), F.col("text")) is not None
    assert set(quality.probabilities(quality.fit(np.zeros((0, 21)), np.zeros(0)), np.zeros((2, 21)))) == {0.5}
    assert quality.quality_filter(docs.limit(0), labels).collect() == []


def test_bradley_terry_orders_by_preference():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 21))
    y = (x[:, 3] - x[:, 5] > 0).astype(int)
    p = quality.probabilities(quality.fit(x, y), x)
    assert p[y == 1].mean() > 0.8 > 0.4 > p[y == 0].mean()
    assert abs((p >= quality.CUT).mean() - y.mean()) < 0.02  # the cut is a quantile of the scores


def test_toxicity(spark, corpus):
    docs, labels = corpus
    model = toxicity.learn(docs, labels)
    assert accuracy(toxicity.with_scores(docs, model), labels, "toxic", 0.5) > 0.93
    odd = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "... !!", 3), (4, "word " * 60_000 + "zidiot", 4), (5, "x" * 200_000, 5)], "doc_id long, text string, `a.b` int")
    got = {r.doc_id: r for r in toxicity.with_scores(odd, model).collect()}
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1].score == got[2].score and got[4]["a.b"] == 4
    assert toxicity.with_scores(odd.limit(0), model).collect() == []
    assert {r.score for r in toxicity.with_scores(odd, None).collect()} == {0.5}
    assert toxicity.learn(docs, labels.where("toxic = 0")) is None and toxicity.learn(docs.limit(0), labels) is None


def test_gradients():
    """Back-propagation against finite differences."""
    rng = np.random.default_rng(1)
    net = {k: v.astype(np.float64) for k, v in toxicity.new_network(rng).items()}
    x, codes = rng.normal(size=(6, toxicity.INPUTS)), rng.integers(0, 6, 20)
    start, n, y, w = np.array([0, 5, 12]), np.array([7, 6, 3]), np.array([1.0, 0.0, 1.0]), np.array([0.5, 0.2, 0.3])

    def loss():
        z = toxicity.window_logits(net, x, codes, start, n).astype(np.float64)
        return float((w * (np.log1p(np.exp(z)) - y * z)).sum())

    g = toxicity._grads(net, x, codes, start, n, y, w)
    for k in net:
        at = tuple(0 for _ in net[k].shape)
        old, step = net[k][at], 1e-2
        net[k][at] = old + step
        up = loss()
        net[k][at] = old - step
        down = loss()
        net[k][at] = old
        assert abs((up - down) / (2 * step) - g[k][at]) < 2e-3, k


def test_windows_overlap_and_cover():
    start, n, doc = toxicity.windows_of(np.array([0, 10, 10 + toxicity.WINDOW, 500]))
    covered = np.zeros(500, dtype=int)
    for s, k in zip(start, n, strict=True):
        covered[s : s + k] += 1
    assert covered.min() >= 1 and covered.max() == 2 and n.max() == toxicity.WINDOW and 0 not in doc
    codes, ends, words = toxicity.words_of(pa.array(["A b  a", None, " ", "b\nc."]))
    assert ends.tolist() == [3, 3, 3, 5] and [words[int(i)].as_py() for i in codes] == ["a", "b", "a", "b", "c"]
