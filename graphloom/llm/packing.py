"""Best-fit packing into bins of several permitted sizes.

Lengths are dealt into shards of a bounded number of pieces. In each, a bin is opened
for the longest piece left: every permitted size that holds it is filled by best fit from
the pieces left, and the size that costs least for what it then holds is opened. Beside that,
best-fit decreasing runs once for every permitted size as the one that all bins open with;
every bin is then downsized to the least permitted size that holds its contents, and the
cheapest outcome stays. A bin costs its capacity plus ``overhead``. A document beyond the
largest size is cut into full bins and a rest that is packed like any other piece.
``packed_sequences`` writes each bin out: its words in order, and where each piece ends.

Defined results
* the length of a document is its number of white-space separated words, or the
  value of ``length``; null, empty and negative lengths take no bin: one row
  with a null bin_id and capacity 0;
* repeated rows are packed each on its own; a null doc_id is packed too;
* an empty table gives an empty table; extra columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import documents, quoted, staged

CAPACITIES = (256, 512, 1024, 2048, 4096)
OVERHEAD = 8
SHARD_ROWS = 16384


def _best_fit(sizes: list[int], opens: list[int]) -> tuple[list[int], list[int]]:
    """Bin of each piece, contents of each bin; ``opens``: the size that a piece opens."""
    by_rest: dict[int, list[int]] = {}
    mask, filled, room, place = 0, [], [], []
    for n, cap in zip(sizes, opens, strict=True):
        m = mask >> n
        if m:  # the tightest open bin
            rest = n + (m & -m).bit_length() - 1
            stack = by_rest[rest]
            b = stack.pop()
            if not stack:
                mask ^= 1 << rest
        else:
            b = len(filled)
            filled.append(0)
            room.append(cap)
        filled[b] += n
        rest = room[b] - filled[b]
        room_left = by_rest.setdefault(rest, [])
        if not room_left:
            mask |= 1 << rest
        room_left.append(b)
        place.append(b)
    return place, filled


def _fill(kinds: list[int], left: dict[int, int], room: int) -> list[int]:
    """Sizes that best fit takes for a bin with ``room``: the largest that fits, again and again; ``kinds``: sizes left, rising."""
    taken: list[int] = []
    used: dict[int, int] = {}
    at = bisect_right(kinds, room) - 1
    while at >= 0:
        n = kinds[at]
        many = min(left[n] - used.get(n, 0), room // n)
        if many > 0:
            taken += [n] * many
            used[n] = used.get(n, 0) + many
            room -= many * n
        at = min(at - 1, bisect_right(kinds, room) - 1)
    return taken


def _priced(ordered: list[int], caps: list[int], overhead: int) -> tuple[list[int], list[int]]:
    """Bin of each piece (falling sizes), contents of each bin; each bin opens with the size of least cost for its contents."""
    left: dict[int, int] = {}
    for n in ordered:
        left[n] = left.get(n, 0) + 1
    kinds, bins = sorted(left), []
    while kinds:
        first = kinds[-1]
        left[first] -= 1
        if not left[first]:
            kinds.pop()
        best = None
        for cap in caps[bisect_left(caps, first) :]:
            more = _fill(kinds, left, cap - first)
            held = first + sum(more)
            cost = (caps[bisect_left(caps, held)] + overhead) / held
            if best is None or cost < best[0]:
                best = (cost, more)
        for n in best[1]:
            left[n] -= 1
            if not left[n]:
                kinds.pop(bisect_left(kinds, n))
        bins.append([first, *best[1]])
    waiting: dict[int, list[int]] = {}
    for b, sizes in enumerate(bins):
        for n in sizes:
            waiting.setdefault(n, []).append(b)
    return [waiting[n].pop() for n in ordered], [sum(sizes) for sizes in bins]


def pack_sizes(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int]]:
    """Bin of each piece and capacity of each bin; no piece exceeds the largest capacity."""
    caps = np.array(sorted(set(capacities)))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    ordered = [sizes[i] for i in order]
    fits = caps[np.searchsorted(caps, ordered)] if ordered else np.array([], dtype=int)
    best = None
    for least in (None, *caps):
        place, filled = _priced(ordered, caps.tolist(), overhead) if least is None else _best_fit(ordered, np.maximum(fits, least).tolist())
        ends = caps[np.searchsorted(caps, filled)] if filled else caps[:0]
        cost = int(ends.sum()) + overhead * len(filled)
        if best is None or cost < best[0]:
            best = (cost, place, ends.tolist())
    back = [0] * len(sizes)
    for i, b in zip(order, best[1], strict=True):
        back[i] = b
    return back, best[2]


def best_fit_pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = None, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, bin_id, capacity, offset in the bin."""
    top = max(capacities)
    words = quoted(length).cast("long") if length else F.size(F.filter(F.split(quoted(text), r"\s+"), lambda w: w != "")).cast("long")
    # Written once: the row number that deals the shards must not change between uses.
    sized = staged(docs.select(quoted(doc_id).alias("doc_id"), F.greatest(F.coalesce(words, F.lit(0)), F.lit(0)).cast("long").alias("n")).withColumn("row", F.monotonically_increasing_id()), "pack-sizes")
    full = (
        sized.where(F.col("n") >= top).select("doc_id", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {top}") - 1)).alias("piece"))
        .select("doc_id", "piece", (F.col("piece") * top).alias("start"), F.lit(top).cast("long").alias("length"), F.concat_ws("-", F.lit("full"), "row", "piece").alias("bin_id"), F.lit(top).cast("long").alias("capacity"), F.lit(0).cast("long").alias("offset"))
    )
    none = sized.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), "n", F.lit(None).cast("string").alias("bin_id"), F.lit(0).cast("long").alias("capacity"), F.lit(0).cast("long").alias("offset"))
    rest = sized.where(F.expr(f"n % {top} > 0"))
    shards = max(1, -(-rest.count() // shard_rows))
    caps = tuple(capacities)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", ignore_index=True)
        sizes = (group["n"] % top).tolist()
        place, ends = pack_sizes(sizes, caps, overhead)
        at, offset = [0] * len(ends), []
        for b, n in zip(place, sizes, strict=True):
            offset.append(at[b])
            at[b] += n
        shard = group["shard"].iloc[0]
        piece = group["n"] // top
        return pd.DataFrame({"doc_id": group["doc_id"], "piece": piece, "start": piece * top, "length": sizes, "bin_id": [f"{shard}-{b}" for b in place], "capacity": [ends[b] for b in place], "offset": offset})

    kind = sized.schema["doc_id"].dataType.simpleString()
    packed = rest.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).groupBy("shard").applyInPandas(pack, f"doc_id {kind}, piece long, start long, length long, bin_id string, capacity long, offset long")
    return packed.unionByName(full).union(none)


def packed_sequences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Each bin written out: bin_id, capacity, words (of all its pieces in order), ends (of the pieces in it), doc_ids.

    Rows of one doc_id have to hold one text.
    """
    words = F.filter(F.split(quoted(text), r"\s+"), lambda w: w != "")
    said = docs.select(_key(quoted(doc_id)).alias("k"), words.alias("words")).dropDuplicates(["k"])
    pieces = best_fit_pack(docs, doc_id, text, None, capacities, overhead, shard_rows).where("bin_id is not null").withColumn("k", _key(F.col("doc_id")))
    cut = pieces.join(said, "k").select("bin_id", "capacity", F.struct("offset", F.slice("words", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("w"), "doc_id").alias("p"))
    rows = cut.groupBy("bin_id").agg(F.first("capacity").alias("capacity"), F.sort_array(F.collect_list("p")).alias("p"))  # at most a bin's words
    return rows.select("bin_id", "capacity", F.flatten(F.transform("p", lambda p: p["w"])).alias("words"), F.transform("p", lambda p: p["offset"] + F.size(p["w"])).alias("ends"), F.transform("p", lambda p: p["doc_id"]).alias("doc_ids"))


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(documents(spark, sf_dir))
