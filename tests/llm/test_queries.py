"""The registered queries themselves, on a small folder of tables with nulls, repeated rows and empty texts; scores against plain loops."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import quality, toxicity
from graphloom.llm.queries import QUERIES

rng = random.Random(8)
FINE = ["river", "stone", "bread", "garden", "window", "letter", "morning", "paper", "music", "forest"]
VILE = ["vermin", "scum", "idiots", "filth"]


def said(i):
    words = [rng.choice(FINE) for _ in range(rng.randint(20, 200))]
    if i % 4 == 0:
        for _ in range(6):
            words.insert(rng.randrange(len(words)), rng.choice(VILE))
    return " ".join(words) + "."


DOCS = [(i, said(i) if i % 5 else "!!! BUY 100% $$$ " * 20, "en", "web") for i in range(120)] + [(200, None, "en", None), (201, "", None, "x"), (202, "mail a@b.org, call +1 (555) 123-4567", "en", "x"), (7, "another text of 7", "en", "x"), (None, "no id", "en", "x")]
LABELS = [(i, int(i % 5 > 0), int(i % 4 == 0 and i % 5 > 0)) for i in range(120)] + [(1, 0, 1), (None, 1, 0), (300, 1, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in DOCS], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def expected_fold():
    return sorted((str(i), i is None or zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in DOCS)


@pytest.mark.parametrize(("name", "cut"), [("op4_toxicity", 0.5), ("op8_quality", 0.3)])
def test_classifier_queries(spark, folder, name, cut):
    got = QUERIES[name](spark, folder).collect()
    assert set(got[0].asDict()) >= {"doc_id", "held_out", "score", "predicted"}
    assert sorted((str(r.doc_id), r.held_out) for r in got) == expected_fold()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in got)
    label = {i: (q, t)[name == "op4_toxicity"] for i, q, t in LABELS[:120] if i != 1}
    right = [r.predicted == label[r.doc_id] for r in got if r.doc_id in label and r.doc_id != 7]
    assert sum(right) / len(right) > 0.9


def test_text_queries(spark, folder):
    rows = {n: QUERIES[n](spark, folder).collect() for n in ("op1_sentencepiece", "op5_pii", "op6_best_fit_packing", "op7_simhash")}
    ids = sorted(str(r[0]) for r in DOCS)
    assert all(sorted(str(r.doc_id) for r in got) == ids for got in rows.values())
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows["op1_sentencepiece"])
    found = {r.doc_id: r for r in rows["op5_pii"]}
    assert (found[202].n_email, found[202].n_phone, found[202].n_ip, found[202].n_card) == (1, 1, 0, 0) and found[202].spans.startswith("email:5:12") and found[200].spans == ""
    assert {r.fingerprint for r in rows["op7_simhash"] if r.doc_id in (200, 201)} == {"0" * 16}


def test_toxicity_against_a_plain_loop():
    texts = [t or "" for _, t, *_ in DOCS[:60]] + ["one", "", " ".join(FINE * 60)]
    model = toxicity.fit(pa.array(texts[:60], pa.large_string()), np.array([int(i % 4 == 0 and i % 5 > 0) for i in range(60)]))
    net = model["net"]
    sig = lambda x: 1 / (1 + np.exp(-x))

    def direction(d, xs):
        h, out, k = np.zeros(toxicity.HIDDEN), [], 2 * toxicity.HIDDEN
        for x in xs:
            p = x @ net[f"W{d}"] + net[f"c{d}"]
            z, r = np.split(sig(p[:k] + h @ net[f"U{d}"]), 2)
            h = h + z * (np.tanh(p[k:] + (r * h) @ net[f"V{d}"]) - h)
            out.append((h @ net[f"e{d}"], h @ net[f"o{d}"]))
        return out

    def score(text):
        codes, ends, words = toxicity.words_of(pa.array([text], pa.large_string()))
        x = toxicity.inputs(words, model["odds"])[codes] if len(codes) else np.zeros((0, toxicity.INPUTS))
        logits = []
        at = 0
        while at < len(x):
            part = x[at : at + toxicity.WINDOW]
            f, b = direction("f", part), direction("r", part[::-1])[::-1]
            e = np.array([p[0] + q[0] for p, q in zip(f, b, strict=True)])
            a = np.exp(e - e.max())
            logits.append(float((a / a.sum()) @ np.array([p[1] + q[1] for p, q in zip(f, b, strict=True)])) + float(net["b"][0]))
            if at + toxicity.WINDOW >= len(x):
                break
            at += toxicity.STRIDE
        own = [np.mean(logits), max(logits), math.log1p(len(logits))] if logits else [float(net["b"][0])] * 2 + [0.0]
        z = np.concatenate([[1], (np.array(own) - model["mean"]) / model["std"]])
        return sig(z @ model["w"])

    assert toxicity.scores(model, pa.array(texts, pa.large_string())) == pytest.approx([score(t) for t in texts], abs=2e-4)


def test_quality_against_a_plain_loop():
    x = np.array([quality.features(t) for _, t, *_ in DOCS])
    y = np.array([int(i % 5 > 0) for i in range(len(DOCS))])
    model = quality.fit(x, y)

    def score(row):
        total, k = 0.0, 0
        for value, edges in zip(row, model["edges"], strict=True):
            for edge in edges:
                total += float(model["w"][k]) * (value > edge)
                k += 1
        return 1 / (1 + math.exp(-(total + model["shift"])))

    assert quality.probabilities(model, x) == pytest.approx([score(r) for r in x], abs=1e-4)
