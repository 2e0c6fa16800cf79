"""Near copies by the exact Jaccard similarity of five-word shingles, at 0.8 or more.

Candidates come from SimHash first: fingerprints of the five-word shingles, linked at
four bits or fewer by pigeonring filtering as in ``simhash``. Each link is checked on the
whole sets of shingle hashes; what passes is one group from then on. At a similarity of 0.8 two
fingerprints differ in about 10 bits, beyond any cut that filters. For those pairs texts are
candidates too where they agree on one of 40 keys, each made of the least values of
five hash functions over the shingles (MinHash), unless SimHash has joined them. A pair
at similarity s shares no key with a chance of (1 - s^5)^40: 1.3e-7 at 0.8, less above.
Every candidate is checked on its whole sets.

Equal sets are one row from the start. Texts that share a key and are still apart are first compared
with one of them, so that a dense group falls together without all its pairs. The
members of a key that are still apart are then dealt into blocks of bounded size, and
pairs of blocks are verified as matrices in their tasks; each yields a spanning forest,
not the pairs, so a large group of texts that lie just apart costs rows in proportion.
Of keys with the same members one is verified.

Defined results
* groups are the connected components of the pairs that pass; the row of the
  smallest doc_id (nulls first), then text hash, of each group stays;
* words are split at ASCII white space, ASCII letters in lower case, as for the fingerprints;
* a null or blank text equals any other such text;
* fewer than five words: the whole sequence is the one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import quoted, staged, unused
from graphloom.llm.components import components
from graphloom.llm.simhash import candidates, majority

SHINGLE, SEED = 5, 42
#: The least similarity, as a fraction of whole numbers.
NUM, DEN = 4, 5
ROWS, BANDS = 5, 40
#: Members of a block, and shingles of a block on average; a task holds two blocks at a time.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
_CHUNK, _COLUMNS = 1 << 16, 2048
_FUNCTIONS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, ROWS * BANDS), dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashes(text: str | None) -> np.ndarray:
    """Hashes of the text's shingles, repeats included; a blank text has the one hash 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(1, dtype=np.uint64)
    parts = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(s, SEED) for s in parts], dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    return np.unique(hashes(text))


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of keys for each set."""
    h, at = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, dtype=np.uint64)
        for j in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat((h ^ _FUNCTIONS[0, j]) * (_FUNCTIONS[1, j] | np.uint64(1)), at)
            key = (key ^ least) * _MIX
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        some, held, done, size, sig, fp = [], 0, [], [], [], []
        for text in b.column(2).to_pylist():
            every = hashes(text)
            fp.append(majority(every))
            s = np.unique(every)
            some.append(s)
            size.append(len(s))
            sig.append(xxhash.xxh3_64_intdigest(s.tobytes(), SEED))
            held += len(s)
            if held >= _CHUNK:
                done.append(_keys(some))
                some, held = [], 0
        if some:
            done.append(_keys(some))
        flat = np.concatenate(done).reshape(-1).view(np.int64) if done else np.empty(0, dtype=np.int64)
        keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * BANDS, pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(sig, dtype=np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), keys], names=["doc_id", "t", "sig", "n", "fp", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        some, held, first = [], 0, 0
        for k, text in enumerate(b.column(1).to_pylist()):
            some.append(shingles(text).view(np.int64))
            held += len(some[-1])
            if held >= 8 * _CHUNK or k == b.num_rows - 1:  # few long texts at a time
                at = pa.array(np.cumsum([0, *map(len, some)]), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(some)), pa.ListArray.from_arrays(at, pa.array(np.concatenate(some)))], names=["sig", "s"])
                some, held, first = [], 0, k + 1


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that reach the similarity; whole sets meet in joins, which spill, not in Arrow batches."""
    x = pairs.join(sets.select(F.col("sig").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("sig").alias("v"), F.col("s").alias("b")), "v")
    both = F.size(F.array_intersect("a", "b"))
    return staged(x.where(both * DEN >= (F.size("a") + F.size("b") - both) * NUM).select("u", "v"), "near-links")


def shared_shingles(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many shingles each two sets share; ``flat``: the sets in a row."""
    m, owner = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[column] > 1)
    some = some[np.argsort(column[some], kind="stable")]
    owner, column = owner[some], np.cumsum(np.diff(column[some], prepend=-1) > 0) - 1
    out = np.zeros((m, m), dtype=np.float32)  # exact: counts stay below 2^24
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        lo, hi = np.searchsorted(column, (first, first + _COLUMNS))
        held = np.zeros((m, _COLUMNS), dtype=np.float32)
        held[owner[lo:hi], column[lo:hi] - first] = 1
        out += held @ held.T
    return out


def _forest(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id that each row of a symmetric matrix reaches."""
    root = ids.copy()
    while True:
        least = np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (least == root).all():
            return root
        root = least


def _block(sig: np.ndarray, c: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of one pair of blocks that are not yet in their own component's least member, with it."""
    if (c == c[0]).all():
        return sig[:0], sig[:0]
    both, n = shared_shingles(flat, sizes).astype(np.int64), sizes.astype(np.int64)
    near = both * DEN >= (n[:, None] + n[None, :] - both) * NUM
    root = _forest(near, sig)
    moved = root != sig
    return sig[moved], root[moved]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and pair of blocks, of which one may go on over batches."""
    rest: pa.Table | None = None

    def run(t: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
        t = t.combine_chunks()
        key = np.stack([t.column(x).to_numpy() for x in ("key", "bi", "bj")])
        starts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [t.num_rows]])
        if not last:
            starts = starts[:-1]
        sig, c = t.column("sig").to_numpy(), t.column("c").to_numpy()
        sets = t.column("s").combine_chunks()
        sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
        at, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        found = [_block(sig[a:b], c[a:b], flat[at[a] : at[b]], np.diff(at[a : b + 1])) for a, b in zip(starts, starts[1:], strict=False)]
        u, v = (np.concatenate([x[i] for x in found]) if found else np.empty(0, dtype=np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64())], names=["u", "v"]), t.slice(int(starts[-1]))

    for b in batches:
        if b.num_rows:
            now = pa.Table.from_batches([b])
            found, rest = run(pa.concat_tables([rest, now]) if rest is not None and rest.num_rows else now, False)
            yield found
    if rest is not None and rest.num_rows:
        yield run(rest, True)[0]


def _in_blocks(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between the members of each key of ``apart`` (key, sig, n, c), as forests of pairs of blocks."""
    word = lambda salt: F.sum(F.xxhash64("sig", F.lit(salt)).cast("decimal(38,0)"))
    keys = apart.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("held"), word(1).alias("w1"), word(2).alias("w2"))
    first = staged(keys.groupBy("m", "w1", "w2").agg(F.min(F.struct("key", "held")).alias("x")).select("x.key", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("x.held") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "near-first")
    met = (
        apart.join(first.hint("merge"), "key").withColumn("own", F.pmod(F.xxhash64("sig", "key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "sig", "c")
    )
    order = ["key", "bi", "bj"]
    return staged(staged(met, "near-met").join(sets.hint("merge"), "sig").select(*order, "sig", "c", "s").repartition(*order).sortWithinPartitions(*order).mapInArrow(_verified, "u long, v long").distinct(), "near-links")


def _alike(one: DataFrame) -> DataFrame:
    """u, v (sig) and their sizes n, m: one text of each two linked fingerprints, and texts of equal fingerprints with one of them."""
    texts = one.select("sig", "n", F.col("rep.fp").alias("fp"))
    fps = staged(texts.groupBy("fp").agg(F.min(F.struct("sig", "n")).alias("x")).select("fp", "x.*"), "near-fps")
    to = lambda fp, sig, n: fps.select(F.col("fp").alias(fp), F.col("sig").alias(sig), F.col("n").alias(n))
    equal = texts.select("fp", F.col("sig").alias("u"), "n").join(to("fp", "v", "m"), "fp").where("u != v").select("u", "v", "n", "m")
    near = candidates(fps.select("fp")).toDF("fp", "fq").join(to("fp", "u", "n"), "fp").join(to("fq", "v", "m"), "fq").select("u", "v", "n", "m")
    return equal.unionByName(near)


def _key(c):  # noqa: ANN001, ANN202
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))


def near_copy_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and t (hash of the text) of the row that stays of each group, and the group's component."""
    kind = docs.select(quoted(doc_id)).schema[0].dataType.simpleString()
    rows = docs.select(quoted(doc_id).alias("doc_id"), F.xxhash64(quoted(text)).alias("t"), quoted(text).alias("text"))
    sketched = staged(rows.mapInArrow(_sketches, f"doc_id {kind}, t long, sig long, n int, fp long, keys array<long>"), "near-sketches")
    one = staged(sketched.groupBy("sig").agg(F.min(F.struct("doc_id", "t", "fp")).alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")), "near-distinct")
    like = lambda a, b: F.least(a, b) * DEN >= F.greatest(a, b) * NUM
    alike = staged(_alike(one).where(like(F.col("n"), F.col("m"))).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near-alike")
    # Joins on keys are hinted: Spark sizes exploded rows as the table before, and written ones as their coded files.
    every = one.select("sig", "n", F.explode("keys").alias("key"))
    common = staged(every.groupBy("key").agg(F.min("sig").alias("least"), F.max("sig").alias("most")).where("least != most").select("key"), "near-keys")
    shared = staged(every.join(common.hint("merge"), "key"), "near-shared")
    wanted = shared.select("sig").unionByName(alike.select(F.col("u").alias("sig"))).unionByName(alike.select(F.col("v").alias("sig")))
    held = one.join(wanted.distinct(), "sig", "left_semi").select("sig", _key(F.col("rep.doc_id")).alias("k"), F.col("rep.t").alias("t"))
    texts = rows.select(_key(F.col("doc_id")).alias("k"), "t", "text").join(held, ["k", "t"]).dropDuplicates(["sig"])
    sets = staged(texts.select("sig", "text").mapInArrow(_sets, "sig long, s array<long>"), "near-sets")

    def named(links: DataFrame) -> DataFrame:
        joined = staged(components(links), "near-joined")
        return staged(shared.join(joined.select(F.col("node").alias("sig"), "component"), "sig", "left").select("key", "sig", "n", F.coalesce("component", "sig").alias("c")), "near-named")

    links = _linked(alike, sets)
    members = named(links)
    pivot = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("sig").alias("o"), F.col("sig").alias("p"), F.col("n").alias("m"), F.col("c").alias("d"))).alias("x")).select("key", "x.*")
    found = members.join(pivot.hint("merge"), "key").where((F.col("c") != F.col("d")) & like(F.col("n"), F.col("m")))
    links = links.unionByName(_linked(staged(found.select(F.least("sig", "p").alias("u"), F.greatest("sig", "p").alias("v")).distinct(), "near-pairs"), sets))
    members = named(links)
    more = members.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select("key")
    links = links.unionByName(_in_blocks(staged(members.join(more.hint("merge"), "key", "left_semi"), "near-apart"), sets))
    joined = components(links)
    last = one.join(joined.select(F.col("node").alias("sig"), "component"), "sig", "left").select("rep", F.coalesce("component", "sig").alias("c"))
    return staged(last.groupBy(F.col("c").alias("component")).agg(F.min("rep").alias("rep")).select("component", "rep.doc_id", "rep.t"), "near-groups")


def near_copy_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row that stays of each group, with all its columns."""
    k, t = unused(docs.columns, "k", "t")
    keep = near_copy_groups(docs, doc_id, text).select(_key(F.col("doc_id")).alias(k), F.col("t").alias(t))
    return docs.withColumns({k: _key(quoted(doc_id)), t: F.xxhash64(quoted(text))}).join(keep, [k, t], "left_semi").dropDuplicates([k, t]).drop(k, t)
