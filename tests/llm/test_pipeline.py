import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm.common import shared_dir, staged, unused
from graphloom.llm.pii import KINDS, with_spans

from .test_line_dedup import brute as brute_lines
from .test_near_copies import brute as brute_copies
from .test_packing import check

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "simhash_near_dedup", "pii", "packing"]
    seen = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = staged(stage(spark, seen[-1], DATA), f"test-{name}")
        if k < 4:
            assert out.columns == docs.columns
        seen.append(out)
    first = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id: r.text for r in seen[1].collect()}
    assert 0.6 * len(first) < len(good) < len(first) and all(first[i] == t for i, t in good.items())
    lines = {r.doc_id: r for r in seen[2].collect()}
    assert {i: r.text for i, r in lines.items()} == brute_lines(sorted(good.items())) and all(r.n_chars == len(r.text) for r in lines.values())
    ids = sorted(lines)
    single = {r.doc_id: r.text for r in seen[3].collect()}
    assert set(single) == {ids[k] for k in brute_copies([lines[i].text for i in ids])}
    spans = {r.doc_id: r for r in with_spans(seen[3], "text", "base", "all").collect()}
    clean = {r.doc_id: r.text for r in seen[4].collect()}
    for i, r in spans.items():
        text, at = "", 0
        for s in r["all"]:
            if s["start"] >= at:
                text += r.text[at : s["start"]] + f"<{KINDS[s['kind']].upper()}>"
            at = max(at, s["end"])
        assert clean[i] == text + r.text[at:]
    packed = seen[5].collect()
    check(packed)
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {i: len([w for w in t.split() if w]) for i, t in clean.items()}
    assert corpus_pipeline.run(spark, DATA).agg(F.sum("length")).first()[0] == sum(total.values())


def test_common(spark):
    assert unused(["__a", "B"], "a", "b") == ["__a_", "__b"]
    df = staged(spark.range(3), "x")
    assert df.count() == 3 and shared_dir(spark)
