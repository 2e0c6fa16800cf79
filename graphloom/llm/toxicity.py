"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

Inputs of a word, all learnt from the labelled sample: the log-odds of the word
itself (word input) and of its byte n-grams, at its start and anywhere in it
(character inputs). The network reads windows of ``WINDOW`` words that overlap
by ``WINDOW - STRIDE``, all of them; attention weighs the words of a window, and
the mean and the greatest window logit give the document's score. Forward and
backward passes and the optimiser are numpy.

The log-odds that the network is trained on are cross-fitted: each half of the
sample is described by the other half's counts, so words seen once do not
look more telling than they will be on new texts.

Defined results
* a null text counts as empty; a text without words gets the score of no evidence;
* very long texts are scored whole, in blocks of windows;
* repeated rows get the same score; without learning rows of both labels every
  score is 0.5; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import documents, map_last, table
from graphloom.llm.labelled import held_out, learning_rows

#: Bound of the labelled sample that the model is fitted on.
LEARN_ROWS = 8_000
WINDOW, STRIDE = 96, 64
HIDDEN, EPOCHS, LEAST_STEPS, BATCH, RATE, SEED = 8, 1, 400, 256, 0.02, 11
BITS, PRIOR = 17, 10.0
STARTS, GRAM = (4, 5, 6, 7, 8, 10), 4
INPUTS = 1 + len(STARTS) + 2
BLOCK_WINDOWS, BLOCK_BYTES = 8192, 1 << 22
_TRIM = " \t\r\n.,;:!?#$%&*|\"'()[]{}<>-_=+/\\`~@^"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Code of each word, end of each text in the codes, the distinct words."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(full)])[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()]
    coded = pc.dictionary_encode(flat.filter(pa.array(full)))
    return coded.indices.to_numpy(), ends, pc.utf8_trim(coded.dictionary, _TRIM)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * _MIX
    return ((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)


def buckets(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word a bucket for itself and for each start (-1: none); n-grams' buckets, and their words' bounds."""
    held = words.cast(pa.large_string())
    off = np.frombuffer(held.buffers()[1], dtype=np.int64)[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, np.int64)
    data = np.frombuffer(held.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]].astype(np.uint64)
    off = off - off[0]
    n = np.diff(off)
    longest = int(n.max()) if len(n) else 0
    power = np.cumprod(np.full(longest + 1, 0x100000001B3, dtype=np.uint64))
    total = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * power[np.arange(len(data)) - np.repeat(off[:-1], n)])])
    own = np.empty((1 + len(STARTS), len(n)), dtype=np.int64)
    own[0] = np.where(n > 0, _bucket(total[off[1:]] - total[off[:-1]], 1), -1)
    for k, length in enumerate(STARTS):
        own[1 + k] = np.where(n >= length, _bucket(total[np.minimum(off[:-1] + length, len(data))] - total[off[:-1]], 2 + k), -1)
    at = np.flatnonzero(np.arange(len(data)) + GRAM <= np.repeat(off[1:], n)) if len(data) else np.zeros(0, np.int64)
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(GRAM):
        h |= data[at + k] << np.uint64(8 * k)
    count = np.maximum(n - GRAM + 1, 0)
    return own, _bucket(h, 99), np.concatenate([[0], np.cumsum(count)])[:-1], count


def inputs(words: pa.Array, odds: np.ndarray) -> np.ndarray:
    """Of each distinct word its inputs; ``odds``: log-odds by kind and bucket."""
    own, gram, start, count = buckets(words)
    x = np.zeros((len(words), INPUTS), dtype=np.float32)
    for k in range(1 + len(STARTS)):
        x[:, k] = np.where(own[k] >= 0, odds[k][own[k]], 0)
    some = np.flatnonzero(count)
    if len(some):
        v = odds[-1][gram]
        x[some, -2] = np.maximum.reduceat(v, start[some])
        x[some, -1] = np.add.reduceat(v, start[some]) / count[some]
    return x


def log_odds(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, distinct: tuple) -> np.ndarray:
    """Shrunk log-odds of each bucket from the documents that hold it; ``docs``: codes of each."""
    own, gram, start, count = distinct
    a, b = np.zeros((2 + len(STARTS), 1 << BITS)), np.zeros((2 + len(STARTS), 1 << BITS))
    for codes, label in zip(docs, y, strict=True):
        u = np.unique(codes)
        into = a if label else b
        for k in range(1 + len(STARTS)):
            got = np.unique(own[k][u])
            into[k][got[got >= 0]] += 1
        c = count[u]
        into[-1][np.unique(gram[np.repeat(start[u] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())])] += 1
    na, nb = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    pa_, pb = na / (na + nb), nb / (na + nb)
    return (np.log((a + PRIOR * pa_) / na) - np.log((b + PRIOR * pb) / nb)).astype(np.float32)


def windows_of(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and document of every window; texts without words have none."""
    begin = np.concatenate([[0], ends[:-1]])
    n = ends - begin
    many = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    start = begin[doc] + k * STRIDE
    return start, np.minimum(WINDOW, ends[doc] - start), doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def new_network(rng: np.random.Generator) -> dict:
    h = HIDDEN
    net = {"b": np.zeros(1)}
    for d in "fr":
        net |= {f"W{d}": rng.normal(0, 0.3, (INPUTS, 3 * h)), f"c{d}": np.zeros(3 * h), f"U{d}": rng.normal(0, 0.3, (h, 2 * h)), f"V{d}": rng.normal(0, 0.3, (h, h)), f"e{d}": rng.normal(0, 0.3, h), f"o{d}": rng.normal(0, 0.3, h)}
    return {k: v.astype(np.float32) for k, v in net.items()}


def _places(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows sorted by falling length: position of step t in reverse, and how many windows are open at t."""
    t = np.arange(int(n[0]))
    return np.maximum(n[None, :] - 1 - t[:, None], 0), np.searchsorted(-n, -t, side="left")


def _run(net: dict, d: str, rows: np.ndarray, x: np.ndarray, open_at: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Attention and output contributions of one direction; rows: [step, window] into the projected words."""
    h2, (steps, m) = 2 * HIDDEN, rows.shape
    e, o = np.zeros((steps, m), np.float32), np.zeros((steps, m), np.float32)
    h = np.zeros((m, HIDDEN), np.float32)
    u, v = net[f"U{d}"], net[f"V{d}"]
    heads = np.stack([net[f"e{d}"], net[f"o{d}"]], axis=1)
    for t in range(steps):
        k = open_at[t]
        p, was = x[rows[t, :k]], h[:k]
        gates = _sigmoid(p[:, :h2] + was @ u)
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        c = 2 * _sigmoid(2 * (p[:, h2:] + (r * was) @ v)) - 1
        now = was + z * (c - was)
        if keep is not None:
            keep.append((was.copy(), z, r, c, now))
        h[:k] = now
        both = now @ heads
        e[t, :k], o[t, :k] = both[:, 0], both[:, 1]
    return e, o


def _pool(e: np.ndarray, o: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = np.where(np.arange(len(e))[:, None] < n[None, :], e, -np.inf)
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    return a, (a * o).sum(axis=0)


def window_logits(net: dict, x: np.ndarray, codes: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The logit of each window; ``x``: inputs of the distinct words."""
    out = np.empty(len(n), dtype=np.float32)
    px = {d: x @ net[f"W{d}"] + net[f"c{d}"] for d in "fr"}
    order = np.argsort(-n, kind="stable")
    for at in range(0, len(n), BLOCK_WINDOWS):
        w = order[at : at + BLOCK_WINDOWS]
        s, m = start[w], n[w]
        back, open_at = _places(m)
        t = np.arange(len(back))[:, None]
        ef, of = _run(net, "f", codes[np.minimum(s + t, len(codes) - 1)], px["f"], open_at)
        er, orr = _run(net, "r", codes[s + back], px["r"], open_at)
        out[w] = _pool(ef + np.take_along_axis(er, back, 0), of + np.take_along_axis(orr, back, 0), m)[1] + net["b"][0]
    return out


def _grads(net: dict, x: np.ndarray, codes: np.ndarray, start: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Gradients of the weighted logistic loss; windows sorted by falling length."""
    back, open_at = _places(n)
    t = np.arange(len(back))[:, None]
    rows = {"f": codes[np.minimum(start + t, len(codes) - 1)], "r": codes[start + back]}
    used, kept, seen = {}, {"f": [], "r": []}, {}
    for d in "fr":
        u, inv = np.unique(rows[d], return_inverse=True)
        used[d] = (x[u], inv.reshape(rows[d].shape))
        seen[d] = _run(net, d, used[d][1], used[d][0] @ net[f"W{d}"] + net[f"c{d}"], open_at, kept[d])
    e = seen["f"][0] + np.take_along_axis(seen["r"][0], back, 0)
    o = seen["f"][1] + np.take_along_axis(seen["r"][1], back, 0)
    a, pooled = _pool(e, o, n)
    dl = (1 / (1 + np.exp(-np.clip(pooled + net["b"][0], -30, 30))) - y) * weight
    g = {"b": np.array([dl.sum()], np.float32)}
    do = a * dl
    de = do * (o - pooled)
    for d in "fr":
        dod, ded = (do, de) if d == "f" else (np.take_along_axis(do, back, 0), np.take_along_axis(de, back, 0))
        u, v, eh, oh = net[f"U{d}"], net[f"V{d}"], net[f"e{d}"], net[f"o{d}"]
        gp = np.zeros((len(used[d][0]), 3 * HIDDEN), np.float32)
        gu, gv, ge, go, gx = np.zeros_like(u), np.zeros_like(v), np.zeros_like(eh), np.zeros_like(oh), np.zeros_like(net[f"W{d}"])
        dh = np.zeros((len(n), HIDDEN), np.float32)
        for s in range(len(back) - 1, -1, -1):
            k = open_at[s]
            was, z, r, c, now = kept[d][s]
            ge += ded[s, :k] @ now
            go += dod[s, :k] @ now
            dn = dh[:k] + ded[s, :k, None] * eh + dod[s, :k, None] * oh
            dc = dn * z * (1 - c * c)
            rh = dc @ v.T
            dgate = np.concatenate([dn * (c - was) * z * (1 - z), rh * was * r * (1 - r)], axis=1)
            gu += was.T @ dgate
            gv += (r * was).T @ dc
            dh[:k] = dn * (1 - z) + rh * r + dgate @ u.T
            dp = np.concatenate([dgate, dc], axis=1)
            xs = used[d][0][used[d][1][s, :k]]
            gx += xs.T @ dp
            gp[0] += dp.sum(axis=0)
        g |= {f"W{d}": gx, f"c{d}": gp[0], f"U{d}": gu, f"V{d}": gv, f"e{d}": ge, f"o{d}": go}
    return g


def _train(x: np.ndarray, codes: np.ndarray, start: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    rng = np.random.default_rng(SEED)
    net = new_network(rng)
    m, v, step = {k: 0.0 for k in net}, {k: 0.0 for k in net}, 0
    # Half of a batch has each label; the smaller side comes round more often until every window of the larger has come EPOCHS times.
    sides = [np.flatnonzero(y == k) for k in (0, 1)]
    half = BATCH // 2
    total = max(LEAST_STEPS, EPOCHS * -(-max(map(len, sides)) // half))  # small samples need more passes to converge
    drawn = [np.concatenate([rng.permutation(side) for _ in range(-(-total * half // len(side)))]) for side in sides]
    for at in range(0, total * half, half):
        w = np.concatenate([d[at : at + half] for d in drawn])
        w = w[np.argsort(-n[w], kind="stable")]
        g = _grads(net, x, codes, start[w], n[w], y[w], weight[w] / weight[w].sum())
        size = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
        step += 1
        rate = RATE * (1 - step / (total + 1))
        for k, q in g.items():
            q = q * min(1.0, 1.0 / max(size, 1e-9))
            m[k], v[k] = 0.9 * m[k] + 0.1 * q, 0.99 * v[k] + 0.01 * q * q
            net[k] = (net[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def _summary(logits: np.ndarray, doc: np.ndarray, docs: int, none: float) -> np.ndarray:
    """Of each document: 1, mean and greatest window logit, log of the number of windows."""
    many = np.bincount(doc, minlength=docs)
    s = np.full((docs, 4), none, dtype=np.float64)
    s[:, 0], s[:, 3] = 1, np.log1p(many)
    have = np.flatnonzero(many)
    if len(have):
        first = np.cumsum(many) - many
        s[have, 1] = np.add.reduceat(logits, first[have]) / many[have]
        s[have, 2] = np.maximum.reduceat(logits, first[have])
    return s


def fit(texts: pa.Array, y: np.ndarray) -> dict | None:
    """The model of ``texts`` and their labels, or None without rows of both labels."""
    if len(y) == 0 or y.min() == y.max():
        return None
    codes, ends, words = words_of(texts)
    begin = np.concatenate([[0], ends[:-1]])
    each = [codes[a:b] for a, b in zip(begin, ends, strict=True)]
    distinct = buckets(words)
    half = np.arange(len(y)) % 2
    odds = [log_odds([each[i] for i in np.flatnonzero(half != k)], y[half != k], distinct) for k in (0, 1)]
    # Rows of both halves' inputs: a word's row depends on the half that its document is in.
    x = np.concatenate([inputs(words, o) for o in odds])
    crossed = codes + np.repeat(half, ends - begin) * len(words)
    start, n, doc = windows_of(ends)
    many = np.bincount(doc, minlength=len(y))
    toxic = max(1, int(y.sum()))
    yw = y[doc].astype(np.float32)
    # A document counts the same whatever its windows, a label the same whatever its documents.
    weight = (1 / np.maximum(1, many)[doc] * np.where(yw == 1, 1 / toxic, 1 / max(1, len(y) - toxic))).astype(np.float32)
    net = _train(x, crossed, start, n, yw, weight)
    s = _summary(window_logits(net, x, crossed, start, n), doc, len(y), float(net["b"][0]))
    mean, std = s[:, 1:].mean(0), s[:, 1:].std(0) + 1e-6
    z = s.copy()
    z[:, 1:] = (s[:, 1:] - mean) / std
    w = np.zeros(4)
    for _ in range(25):  # Newton's method on the logistic loss
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.eye(4) * 0.5
        w -= np.linalg.solve(hess, z.T @ (p - y) + 0.5 * w)
    return {"net": net, "odds": log_odds(each, y, distinct), "w": w, "mean": mean, "std": std}


def scores(model: dict | None, texts: pa.Array) -> np.ndarray:
    """Probability of label 1 for each text, whole."""
    if model is None:
        return np.full(len(texts), 0.5)
    codes, ends, words = words_of(texts)
    start, n, doc = windows_of(ends)
    net = model["net"]
    logits = window_logits(net, inputs(words, model["odds"]), codes, start, n) if len(n) else np.zeros(0, np.float32)
    s = _summary(logits, doc, len(texts), float(net["b"][0]))
    s[:, 1:] = (s[:, 1:] - model["mean"]) / model["std"]
    return 1 / (1 + np.exp(-np.clip(s @ model["w"], -40, 40)))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = LEARN_ROWS) -> dict | None:
    """Fits in one task on an executor, as the sample is bounded; the driver only gets the model, of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        texts = pa.concat_arrays([b.column("text").cast(pa.large_string()) for b in got]) if got else pa.array([], pa.large_string())
        y = np.concatenate([b.column("y").to_numpy() for b in got]) if got else np.zeros(0, dtype=int)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, y))], pa.binary())], names=["model"])

    found = learning_rows(docs, labels, label, rows).repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else None


def with_scores(docs: DataFrame, model: dict | None, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name`` in place of the text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed number of buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).cast(pa.large_string())
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            cut = np.flatnonzero(np.diff(size // BLOCK_BYTES)) + 1 if len(size) else []
            parts = [scores(sent.value, texts.slice(i, j - i)) for i, j in zip([0, *cut], [*cut, len(texts)], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(parts))], names=[*b.schema.names[:-1], name])

    return map_last(docs, text, run, f"{name} double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = with_scores(docs.withColumn("held_out", held_out(F.col("doc_id"))), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
