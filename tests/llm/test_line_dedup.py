from collections import defaultdict

import pytest

from graphloom.llm.line_dedup import line_dedup


def brute(docs):
    """doc_id, text of distinct documents."""
    seen, covered = {}, defaultdict(set)
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0])):
        lines = t.split("\n")
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if not "".join(w).strip():
                continue
            if w in seen:
                covered[d] |= {i, i + 1, i + 2}
            seen.setdefault(w, d)
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in covered[d]) for d, t in docs}


def test_windows(spark):
    docs = [
        (1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\nd\ny"), (3, "a\nb"), (4, "b\nc\nd"), (5, "r\nr\nr\nr\nr"), (6, "\n\n\n\n"), (7, "\n\n\n\n"),
        (8, ""), (9, "q\na\nb\nz"), (10, "a\nb\nc\nq\nb\nc\nd"), (None, "a\nb\nc\nnull id is first"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup(df).collect()}
    assert got == brute(docs)
    assert got[2] == "x\ny" and got[4] == "" and got[5] == "r" and got[6] == "\n\n\n\n"


def test_odd_input(spark):
    rows = [(1, "a\nb\nc", 7), (1, "a\nb\nc", 7), (2, None, 8), (3, "a\nb\nc\nx", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `pos` int").withColumnRenamed("pos", "starts")
    got = sorted((r.doc_id, r.text, r.starts, r.gone) for r in line_dedup(df, removed="gone").collect())
    # repeated rows are one document; null stays null; the extra column passes through
    assert got == [(1, "a\nb\nc", 7, 0), (1, "a\nb\nc", 7, 0), (2, None, 8, 0), (3, "x", 9, 3)]
    assert line_dedup(df.limit(0)).collect() == []


def test_long_and_hot(spark):
    body = "\n".join(f"line {i}" for i in range(20_000))
    docs = [(i, "hot 1\nhot 2\nhot 3\nown %d" % i) for i in range(300)] + [(1000, body), (1001, body)]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == docs[0][1] and got[299] == "own 299" and got[1000] == body and got[1001] == ""


@pytest.mark.parametrize("name", ["__d", "h", "lines"])
def test_clashing_names(spark, name):
    df = spark.createDataFrame([(1, "a\nb\nc", 5), (2, "a\nb\nc", 6)], f"doc_id long, text string, `{name}` int")
    assert sorted((r.doc_id, r.text, r[name]) for r in line_dedup(df).collect()) == [(1, "a\nb\nc", 5), (2, "", 6)]
