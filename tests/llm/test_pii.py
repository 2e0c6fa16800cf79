import random
import re

import pytest

from graphloom.llm import pii


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def base(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


TEXTS = [
    "a@b.c@d.e f@g.hh", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3.4.", "4111 1111 1111 1111 4111-1111-1111-1111x", "+1 (017) 555-7713 +44 20 7946 0958 0", "é 𝒳 a.b+c@x-y.co.uk..",
    "5.5.5.5@6.6.6.6", "0000000.0.0.255", "+1+1 222 333 4444", None, "", "a" * 50_000, "1 " * 30_000, "a@" + "b." * 20_000 + "c", "@" * 1000, "5555 5555 5555 4444", ".".join(["1"] * 5000), "x@y.z 4111111111111111",
]


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("0123456789.@ab-+ ()_%é") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("doc_id", "base")  # a clashing name
    rows = pii.with_spans(df, "text", "own", "spans").collect()
    return [(r.text, [tuple(s) for s in r.own], [tuple(s) for s in r.spans]) for r in rows]


def test_base_spans(found):
    for text, own, _ in found:
        assert own == [(a, k, b) for a, k, b in base(text)], text and text[:80]


def test_base_spans_stay(found):
    for _, own, spans in found:
        assert set(own) <= set(spans) and spans == sorted(spans)
        extra = sorted(set(spans) - set(own))
        assert all(a[2] <= b[0] for a, b in zip(extra, extra[1:], strict=False))


def test_judged_spans(spark):
    cases = [
        ("reach me: jo.doe (at) example (dot) com today", [("email", "jo.doe (at) example (dot) com")]),
        ("tel: 555-123-4567", [("phone", "555-123-4567")]),
        ('token = "cf1d64a9a4cd9723e1f4eafc27395915e6868ffa"', [("secret", "cf1d64a9a4cd9723e1f4eafc27395915e6868ffa")]),
        ("ssn: 123-45-6789.", [("id", "123-45-6789")]),
        ("they met at house and went on", []),
        ("commit cf1d64a9a4cd9723e1f4eafc27395915e6868ffa", []),
        ("plain prose without anything in it, incomprehensibilities of characterization", []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    for r in pii.with_spans(df, "text", "base", "spans").collect():
        assert [(pii.KINDS[s["kind"]], r.text[s["start"] : s["end"]]) for s in r.spans] == cases[r.doc_id][1], r.text


def test_trees_are_calibrated():
    trees, cut = pii.model()
    for kind in trees:
        rows = [e for e in pii._examples(9, 60) if e[0] == kind]
        import numpy as np

        m = pii._margin(trees[kind], np.array([pii._describe(b, s, a) for _, b, s, a, _ in rows])) > cut[kind]
        y = np.array([e[-1] for e in rows])
        assert y[m].mean() > 0.9 and m[y == 1].mean() > 0.7, kind


def test_redact(spark):
    rows = [(1, "𝒳 mail a@b.cc, ip 1.2.3.4!", "en"), (2, None, "de"), (3, "", "fr"), (4, "+4111111111111111 clean", "x")]
    got = {r.doc_id: (r.text, r.spans) for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    assert got[1] == ("𝒳 mail <EMAIL>, ip <IP>!", "en") and got[2] == (None, "de") and got[3] == ("", "fr")
    assert got[4][0] == "<CARD> clean" or got[4][0] == "+<CARD> clean"
    assert pii.redact(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_only_kept_spans_displace_others(spark, monkeypatch):
    # by length c > b > a; a meets b, b meets c, a and c are apart; a fourth holds a base span
    monkeypatch.setattr(pii, "GENERATORS", (("secret", "a+b+"), ("id", "b+c+"), ("phone", "c+d+"), ("secret", "k[0-9.]+k")))
    monkeypatch.setattr(pii, "_judged", lambda text, kind, pattern: pii._matches(text, pattern))
    text = "aaabbccccdddddd 1 k1.2.3.4k " + "x" * 20
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in pii.with_spans(df, "text", "base", "spans").first().spans}
    assert got == {("secret", 0, 5), ("phone", 5, 15), ("ip", 19, 26), ("secret", 18, 27)}
    assert pii.redact(df).first().text == "<SECRET><PHONE> 1 <SECRET> " + "x" * 20
