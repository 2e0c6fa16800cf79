"""SimHash near-dedup with pigeonring filtering.

Two fingerprints that differ in at most 4 of 64 bits, cut into 8 bytes on a
ring, have a byte from which every run of l bytes differs in at most l * 4/8
bits (the pigeonring principle). Hence from some byte the runs of 1 to 5 bytes
differ in at most 0, 1, 1, 2, 2 bits: three of these five bytes are equal, in
one of five patterns, which gives 8 * 5 join keys of 24 bits. Runs of up to 7
bytes give four equal bytes in one of 14 patterns, 8 * 14 keys of 32 bits: more
rows, but 90 times fewer candidates, which pays beyond ``WIDE`` fingerprints.
Both find the same links. A candidate then has to keep the budget along the
whole chain; its last link is the full check.

Equal fingerprints are one row from the start. Fingerprints within one bit of
a common point are linked through it first (at most 65 to a point, no pairs);
the join then looks only for links between the groups so found, so that a
dense group of near copies does not yield all its pairs.

Defined results
* a null or blank text has fingerprint zero, linked like any other;
* fewer than four words: the whole sequence is the one shingle;
* repeated rows share a fingerprint and so a group; a null doc_id takes part, but
  the smallest non-null doc_id names the group (null only if all are null);
* an empty table gives an empty table; other columns are passed by, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import documents, quoted, staged, unused
from graphloom.llm.components import components

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Lengths of the chains that the keys are taken from, and the number of fingerprints beyond which the longer one costs less:
#: 40 n + 40 n^2 / 2^25 rows and candidates against 112 n + 112 n^2 / 2^33.
SHORT, LONG, WIDE = 5, 7, 60_000_000
_CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n, count = max(1, len(words) - SHINGLE + 1), np.zeros(64, dtype=np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        part = words[at : min(at + _CHUNK, n) + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
        h = np.array([hashed(s, SEED) for s in shingles], dtype="<u8")
        count += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes, repeats included."""
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        count += np.unpackbits(hashes[at : at + _CHUNK].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([fingerprint(t) for t in b.column(b.num_columns - 1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found)], names=[*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t (hash of the text), fp (the fingerprint's bits as a signed long), for each row."""
    kind = docs.select(quoted(doc_id)).schema[0].dataType.simpleString()
    rows = docs.select(quoted(doc_id).alias("doc_id"), F.xxhash64(quoted(text)).alias("t"), quoted(text).alias("text"))
    return rows.mapInArrow(_fingerprints, f"doc_id {kind}, t long, fp long")


def _turned(fp: Column, start: int) -> Column:
    """The ring of bytes with ``start`` as the lowest one."""
    return fp if not start else F.shiftrightunsigned(fp, 8 * start).bitwiseOR(F.shiftleft(fp, 64 - 8 * start))


def _byte(x: Column, k: int, to: int) -> Column:
    return F.shiftleft(F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255)), 8 * to)


def _patterns(length: int) -> list[tuple[int, ...]]:
    """The sets of equal bytes, as few as can be, of chains of ``length`` bytes that keep the budget at each of them."""
    budget = [n * MAX_BITS // 8 for n in range(length + 1)]
    differing = [d for d in combinations(range(1, length), budget[length]) if all(sum(k < n for k in d) <= budget[n] for n in range(1, length))]
    return [tuple(k for k in range(length) if k not in d) for d in differing]


def _chains(fps: DataFrame, length: int) -> DataFrame:
    """For each fingerprint a row for each start and pattern of equal bytes: key, x (turned)."""
    rows, patterns = [], _patterns(length)
    for start in range(8):
        x = _turned(F.col("fp"), start)
        for p, equal in enumerate(patterns):
            key = F.lit((start * len(patterns) + p) << 8 * len(equal)).cast("long")
            for to, k in enumerate(equal):
                key = key.bitwiseOR(_byte(x, k, to))
            rows.append(F.struct(key.alias("key"), x.alias("x")))
    return fps.select("g", "fp", F.inline(F.array(*rows)))


def _within(d: Column) -> Column:
    """The budget holds along the chain from the lowest byte; at 8 bytes it is the Hamming check."""
    ok = F.bit_count(d.bitwiseAND(F.lit(0xFFFF))) <= 1
    for n in range(3, 8):
        ok &= F.bit_count(d.bitwiseAND(F.lit((1 << 8 * n) - 1).cast("long"))) <= n * MAX_BITS // 8
    return ok & (F.bit_count(d) <= MAX_BITS)


def _dense_links(fps: DataFrame) -> DataFrame:
    """u, v: fingerprints within one bit of a common point, each with the least one around it."""
    ball = F.array(F.lit(0).cast("long"), *(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)))
    near = lambda c: F.explode(F.transform(ball, lambda m: c.bitwiseXOR(m)))
    points = fps.select("fp", near(F.col("fp")).alias("p")).groupBy("p").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least != most")
    around = staged(points.select("least", near(F.col("p")).alias("fp")).where("fp != least"), "simhash-around")
    return around.join(fps.select("fp"), "fp", "left_semi").select(F.col("least").alias("u"), F.col("fp").alias("v"))


def _grouped(one: DataFrame, links: DataFrame) -> DataFrame:
    """fp, g: the least fingerprint that each one reaches."""
    found = components(links).select(F.col("node").alias("fp"), F.col("component").alias("g"))
    return staged(one.select("fp").join(found, "fp", "left").select("fp", F.coalesce("g", "fp").alias("g")), "simhash-dense")


def _met(dense: DataFrame, length: int | None) -> DataFrame:
    """g, fp and h, fq: fingerprints of two groups that differ in few enough bits."""
    a = _chains(dense, length or (LONG if dense.count() > WIDE else SHORT))
    b = a.select(F.col("g").alias("h"), F.col("fp").alias("fq"), "key", F.col("x").alias("y"))
    # Spark sizes the chains as the table before ``inline``, so it would broadcast 40 or 112 times what it allows.
    return a.join(b.hint("merge"), "key").where(F.col("g") < F.col("h")).where(_within(F.col("x").bitwiseXOR(F.col("y"))))


def candidates(fps: DataFrame, length: int | None = None) -> DataFrame:
    """u, v: pairs of distinct fingerprints (``fps``: fp) that join all that four bits link; of two dense groups one pair.

    They are links of the pigeonring join, each within the cut, for an operator that checks its pairs itself.
    """
    inside = staged(_dense_links(fps), "simhash-inside")
    met = _met(_grouped(fps, inside), length)
    between = met.groupBy("g", "h").agg(F.min(F.struct("fp", "fq")).alias("p")).select(F.col("p.fp").alias("u"), F.col("p.fq").alias("v"))
    return inside.unionByName(between).distinct()


def groups(fps: DataFrame, length: int | None = None) -> DataFrame:
    """``fps`` (doc_id, t, fp) to fp, component_id (smallest doc_id), rep (smallest doc_id and t).

    ``length`` of the chains: ``SHORT``, ``LONG``, or by the number of fingerprints.
    """
    one = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("id"), F.min(F.struct("doc_id", "t")).alias("rep")), "simhash-distinct")
    dense = _grouped(one, _dense_links(one))
    links = _met(dense, length).select(F.col("g").alias("u"), F.col("h").alias("v"))
    joined = components(links).select(F.col("node").alias("g"), F.col("component").alias("c"))
    named = staged(one.join(dense, "fp").join(joined, "g", "left").select("fp", "id", "rep", F.coalesce("c", "g").alias("c")), "simhash-named")
    least = staged(named.groupBy("c").agg(F.min("id").alias("component_id"), F.min("rep").alias("first")), "simhash-least")
    return staged(named.join(least, "c").select("fp", "component_id", F.col("first").alias("rep")), "simhash-groups")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id, for each row."""
    fps = staged(fingerprints(docs, doc_id, text), "simhash-fps")
    return fps.join(groups(fps), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of the smallest doc_id (nulls first), then text hash, of each group, with all its columns."""
    fps = staged(fingerprints(docs, doc_id, text), "simhash-fps")
    k, t = unused(docs.columns, "k", "t")
    key = lambda c: F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))
    keep = groups(fps).select(key(F.col("rep.doc_id")).alias(k), F.col("rep.t").alias(t)).distinct()
    return docs.withColumns({k: key(quoted(doc_id)), t: F.xxhash64(quoted(text))}).join(keep, [k, t], "left_semi").dropDuplicates([k, t]).drop(k, t)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))
