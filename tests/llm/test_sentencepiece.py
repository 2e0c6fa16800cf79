import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import sentencepiece_codec as c

sp = pytest.importorskip("sentencepiece")
TEXTS = [
    "Hello  world", " a\n\tb  ", "", "   ", "日本語𝒳é", "a\x00b", "▁x", "x" * 3000, " " * 700, "aaaa aaaaaaaaa", "     word", "word     ", "a   日  b", "日 日  日", "    日本",
    "representations IllegalArgument ........................ ====----", "a " * 3000, "\n\n\n", "tab\tseparated", "ﬁ ½ İ",
]


@pytest.fixture(scope="module")
def codec():
    return c.Codec.load()


@pytest.fixture(scope="module")
def library():
    return sp.SentencePieceProcessor(model_file=c.MODEL_PATH)


def texts():
    rng = np.random.default_rng(0)
    alpha = list("abcdefghijklmnopqrstuvwxyz     eeeaattt..,,\n012()_=éü日")
    return TEXTS + ["".join(rng.choice(alpha, rng.integers(1, 70))) for _ in range(1500)]


def test_equals_the_library(codec, library):
    t = texts()
    ids, ends = codec.encode(pa.array(t))
    got = [x.tolist() for x in np.split(ids, ends[:-1])]
    assert got == library.encode(t)
    assert codec.decode(ids, ends).to_pylist() == [library.decode(x) for x in got]
    assert codec.decode(ids, ends).to_pylist() == [x.replace("▁", " ") for x in t]


def test_batched_equals_merging(codec):
    words = ["▁" + w for w in {w for t in texts() for w in t.split()} if "▁" not in w]
    flat, at, _ = codec.encode_words(words)
    for i, w in enumerate(words):
        assert flat[at[i] : at[i + 1]].tolist() == codec._ids(codec.merge(w))


def test_nulls_and_slices(codec):
    a = pa.array(["zz", None, "a b", "", "c"]).slice(1, 3)
    ids, ends = codec.encode(a)
    assert ends.tolist() == [0, 2, 2]
    assert codec.encode(pa.array([], pa.string()))[1].tolist() == []


def test_broken_bytes(codec, library):
    for ids in ([243, 160], [1, 243, 264, 2], [28705, 243]):
        got = codec.decode(np.array(ids), np.array([len(ids)])).to_pylist()[0]
        assert "�" in got and got.replace("�", "") == library.decode(ids).replace("�", "").replace("⁇", "")


def test_unigram_viterbi():
    pieces = ["<unk>", "▁", "a", "b", "ab", "ba", "▁a", "aba", "bb"]
    scores = np.array([0, -2, -3, -3.1, -4, -4.2, -4.3, -6.05, -5])
    model = c.Codec(pieces, scores, np.array([2] + [1] * 8), 1).prepare()
    low = scores.min() - 10

    def best(word):
        top = None
        for cut in itertools.product((0, 1), repeat=len(word) - 1):
            parts, last = [], 0
            for i, k in enumerate([*cut, 1], 1):
                if k:
                    parts.append(word[last:i])
                    last = i
            s = [scores[pieces.index(p)] if p in pieces else low if len(p) == 1 else -np.inf for p in parts]
            if top is None or sum(s) > top[0]:
                top = (sum(s), parts)
        return top[1]

    words = ["▁" + "".join(w) for n in range(1, 8) for w in itertools.product("abz" if n < 5 else "ab", repeat=n)]
    flat, at, _ = model.encode_words(words)
    for i, w in enumerate(words):
        assert flat[at[i] : at[i + 1]].tolist() == model._ids(best(w)), w
        assert model.best_sum(w) == best(w)


def test_frames(spark, codec, library):
    rows = [(1, "Hello  world", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z"), (4, "日 " * 50_000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `odd.name` string")
    got = c.with_ids(df, codec, same="ok").collect()
    assert sorted((r.doc_id, len(r.ids), r.ok, r["odd.name"]) for r in got) == sorted((i, len(library.encode(t or "")), True, o) for i, t, o in rows)
    back = c.with_texts(c.with_ids(df, codec), codec).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((i, t or "") for i, t, _ in rows)
    assert c.with_ids(df.limit(0), codec).collect() == []


def test_long_words(codec, library):
    """Words of any length take the batched path: cut between pieces, then chunks that agree."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rng.choice(letters) for _ in range(10_000)), "a" * 3000, "the" * 900, "中文没有空格的文本" * 200, "x" * 49, "ab" * 97, "=" * 700, "é" * 400, "unbelievably" * 90]
    texts += ["".join(rng.choice("eatinors") for _ in range(rng.randint(40, 1200))) for _ in range(30)]
    ids, ends = codec.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == [library.encode(t) for t in texts]
    back = codec.decode(ids, ends).to_pylist()
    assert back == texts
