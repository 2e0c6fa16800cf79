"""Quality scores by Bradley-Terry pairwise ranking.

Each document is described by surface statistics (shares of kinds of bytes,
repetition of words and lines, lengths), cut into quantile steps. From pairs of
a preferred (label 1) and another (label 0) document, logistic loss on the
difference of their features gives the weights. The score's cut is the
quantile of the learning scores at the share of label 0; there the
probability returned is ``CUT``.

Defined results
* a null text counts as empty; empty texts get a score from their (zero) features;
* very long texts are described whole; repeated rows get the same score;
* without learning rows of both labels every score is 0.5;
* an empty table gives an empty table; extra columns are ignored or, in
  ``quality_filter``, passed on, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import documents, quoted, table
from graphloom.llm.labelled import held_out, learning_rows

#: Bound of the labelled sample that the model is fitted on.
LEARN_ROWS = 12_000
PAIRS, STEPS, ROUNDS, CUT, SEED = 40_000, 8, 200, 0.3, 7

_KINDS = np.zeros((256, 9), dtype=np.float64)  # by byte: upper, lower, digit, space, newline, . or ,, ! or ?, other ASCII marks, beyond ASCII
for _b in range(256):
    _c = chr(_b)
    _KINDS[_b, 0 if "A" <= _c <= "Z" else 1 if "a" <= _c <= "z" else 2 if _c.isdigit() and _b < 128 else 4 if _c == "\n" else 3 if _c.isspace() and _b < 128 else 8 if _b > 127 else 5 if _c in ".,;:'" else 6 if _c in "!?" else 7] = 1


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw.strip():
        return [0.0] * 21
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = len(raw)
    shares = counts @ _KINDS / n
    words, lines = raw.split(), raw.split(b"\n")
    often = Counter(words)
    k, (top, most) = len(words), often.most_common(1)[0]
    p = counts[counts > 0] / n
    again = sum(map(bytes.__eq__, words, words[1:]))
    whole = Counter(lines)
    return [
        *shares.tolist(), np.log1p(k), n / k, np.log(len(often)) / np.log(k + 1), most / k, len(top),
        float(-(p * np.log2(p)).sum()), again / k, 1 - len(whole) / len(lines), max(whole.values()) / len(lines),
        np.log1p(n / len(lines)), counts[124] / k, (counts[33] + counts[35] + counts[36] + counts[37] + counts[38] + counts[42]) / k,
    ]


def _steps(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Each feature as the edges that it exceeds, 0 or 1."""
    return (x[:, :, None] > edges[None]).reshape(len(x), -1).astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Weights, edges and shift; ``x``: features of documents, ``y``: labels."""
    if len(x) == 0 or y.min() == y.max():
        return {"edges": np.zeros((21, 1)), "w": np.zeros(21), "shift": None}
    edges = np.quantile(x, np.linspace(0.02, 0.98, STEPS), axis=0).T
    z = _steps(x, edges)
    rng = np.random.default_rng(SEED)
    diff = z[rng.choice(np.flatnonzero(y == 1), PAIRS)] - z[rng.choice(np.flatnonzero(y == 0), PAIRS)]
    w, m, v = np.zeros(z.shape[1], np.float32), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        g = -(diff.T @ (1 / (1 + np.exp(diff @ w)))) / PAIRS + 1e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = (w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    at = float(np.quantile(z @ w, (y == 0).mean()))
    return {"edges": edges, "w": w, "shift": np.log(CUT / (1 - CUT)) - at}


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    if model["shift"] is None or len(x) == 0:
        return np.full(len(x), 0.5)
    return 1 / (1 + np.exp(-np.clip((_steps(x, model["edges"]) @ model["w"]).astype(np.float64) + model["shift"], -40, 40)))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = LEARN_ROWS) -> dict:
    @F.pandas_udf("array<double>")
    def described(text: pd.Series) -> pd.Series:
        return text.map(features, na_action=None)

    got = learning_rows(docs, labels, label, rows).select(described("text").alias("x"), "y").toPandas()
    return fit(np.array(got["x"].tolist(), dtype=np.float64).reshape(-1, 21), got["y"].to_numpy())


def score(model: dict, text: Column) -> Column:
    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(probabilities(model, np.array([features(t) for t in text], dtype=np.float64).reshape(-1, 21)))

    return scored(text)


def quality_filter(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns as they are."""
    model = learn(docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text")), labels)
    return docs.where(score(model, quoted(text)) >= CUT)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
