import itertools
import random

from graphloom.llm.packing import CAPACITIES, best_fit_pack, pack_sizes, packed_sequences


def check(rows, capacities=CAPACITIES):
    bins = {}
    for r in rows:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for own in bins.values():
        cap = {r.capacity for r in own}
        used = sorted((r.offset, r.offset + r.length) for r in own)
        assert len(cap) == 1 and cap <= set(capacities)
        assert all(a[1] == b[0] for a, b in itertools.pairwise(used)) and used[0][0] == 0 and used[-1][1] <= min(cap)
        assert all(c < used[-1][1] for c in capacities if c < min(cap))  # downsized to its contents
    return bins


def test_sizes():
    place, ends = pack_sizes([5, 5, 3, 7, 10, 1], (4, 8, 16), 1)
    assert len(place) == 6 and sum(ends) >= 31
    assert pack_sizes([], (4, 8)) == ([], [])
    place, ends = pack_sizes([8] * 5, (4, 8, 16), 0)
    assert sum(ends) == 40  # no waste
    joint = pack_sizes([3, 5] * 50, (4, 8, 16), 1)[1]
    assert sum(joint) == 400  # the size that leaves no waste


def test_pieces(spark):
    rows = [(1, "a b c"), (2, " ".join(["w"] * 9000)), (3, None), (4, ""), (5, " \t "), (None, "x y"), (1, "a b c"), (6, " ".join(["w"] * 4096))]
    got = best_fit_pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    check(got)
    assert sorted((r.start, r.length) for r in got if r.doc_id == 2) == [(0, 4096), (4096, 4096), (8192, 808)]
    assert sum(r.doc_id == 1 for r in got) == 2 and sum(r.bin_id is None for r in got) == 3
    assert [(r.length, r.capacity) for r in got if r.doc_id == 6] == [(4096, 4096)]
    assert best_fit_pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shards_and_lengths(spark):
    df = spark.range(2000).selectExpr("id as doc_id", "'' as text", "cast(id * 37 % 900 as int) as n", "1 as bin_id")
    got = best_fit_pack(df, length="n", shard_rows=300).collect()
    bins = check(got)
    assert sum(r.length for r in got) == sum(i * 37 % 900 for i in range(2000)) and len(got) == 2000
    used, room = sum(r.length for r in got), sum(own[0].capacity for own in bins.values())
    assert used / room > 0.97


def cheapest(sizes, capacities, overhead):
    """Least cost of any partition into bins, by trying all."""
    best = {0: 0}
    n = len(sizes)
    total = [sum(s for i, s in enumerate(sizes) if mask >> i & 1) for mask in range(1 << n)]
    cost = [next((c + overhead for c in sorted(capacities) if c >= t), None) for t in total]
    for mask in range(1, 1 << n):
        low, part = mask & -mask, mask
        options = []
        while part:
            if part & low and cost[part] is not None:
                options.append(cost[part] + best[mask ^ part])
            part = (part - 1) & mask
        best[mask] = min(options)
    return best[(1 << n) - 1]


def test_against_the_cheapest():
    rng = random.Random(4)
    ratio = []
    for _ in range(60):
        sizes = [rng.randint(1, 16) for _ in range(rng.randint(1, 8))]
        place, ends = pack_sizes(sizes, (4, 8, 16), 1)
        room = [0] * len(ends)
        for b, n in zip(place, sizes, strict=True):
            room[b] += n
        assert all(0 < r <= e for r, e in zip(room, ends, strict=True))
        ratio.append((sum(ends) + len(ends)) / cheapest(sizes, (4, 8, 16), 1))
    assert min(ratio) >= 1 and sum(ratio) / len(ratio) < 1.01 and max(ratio) < 1.2


def test_sequences(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice((1, 5, 40, 300)))) for _ in range(60)] + [None, " "]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, words int")
    got = packed_sequences(df, capacities=(32, 64, 128)).collect()
    back = {}
    for r in got:
        assert len(r.words) <= r.capacity and r.ends[-1] == len(r.words)
        for a, b, i in zip([0, *r.ends], r.ends, r.doc_ids, strict=False):
            back.setdefault(i, []).append(r.words[a:b])
    assert {i: sorted(sum(parts, [])) for i, parts in back.items()} == {i: sorted(t.split()) for i, t in enumerate(texts) if t and t.strip()}


def test_negative_lengths(spark):
    got = best_fit_pack(spark.createDataFrame([(1, "", -5), (2, "", 3)], "doc_id long, text string, n int"), length="n").collect()
    assert sorted((r.doc_id, r.capacity, r.length) for r in got) == [(1, 0, 0), (2, 256, 3)]
