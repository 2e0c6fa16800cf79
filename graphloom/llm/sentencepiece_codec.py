"""SentencePiece encoding and decoding by batched numpy Viterbi.

Distinct words of a batch are encoded once. Words of equal length advance
together: hashes of all their substrings probe the sorted hashes of the pieces,
and for each end position the best piece that ends there is stored as a
backpointer. In a unigram model the best is the greatest sum of scores. In a
BPE model (merges by score, as in the model file given) a segmentation is
the model's own if and only if every two neighbouring pieces are what merging their
joint text gives; so a step is allowed only between such pieces, exactly one
predecessor is left at each position, and the result equals merging.

Spaces are marks in front of words, as the models make them; runs of spaces
merge only after everything else, hence apart from the words.

Defined results
* a null or empty text has no ids; characters without a piece become bytes, or
  the unknown id in a model without byte pieces;
* very long words are cut where no piece spans the border, and what is still long into
  overlapping chunks that advance together; where a chunk agrees with the one before it
  over the length of a piece, it goes on as the whole word would;
* repeated rows get the same ids; an empty table gives an empty table; extra
  columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import documents, map_last, quoted

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONG, STEP, BLOCK_BYTES, FILTER_BITS, MEMORY_BITS = 48, 192, 1 << 22, 21, 20
_BASE = 0x9E3779B97F4A7C15 | 1
_UNKNOWN = -1


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    shift = out = 0
    while True:
        b = raw[at]
        out |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return out, at


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffers message."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            n, at = _varint(raw, at)
            value, at = raw[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = np.frombuffer(raw[at : at + n], dtype="<f4" if n == 4 else "<f8")[0], at + n
        yield tag >> 3, value


def _mix(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Codec:
    """Tables of a model; ``kind``: 1 unigram, 2 BPE (the file format's values)."""

    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
    kind: int
    prefix: bool = True
    trim: bool = False
    tables: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str = MODEL_PATH) -> Codec:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, raw: bytes) -> Codec:
        pieces, scores, types, kind, prefix, trim = [], [], [], 1, True, True
        for n, value in _fields(raw):
            if n == 1:
                p = dict(_fields(value))
                pieces.append(p[1].decode())
                scores.append(float(p.get(2, 0.0)))
                types.append(int(p.get(3, 1)))
            elif n == 2:
                kind = int(dict(_fields(value)).get(3, 1))
            elif n == 3:
                spec = dict(_fields(value))
                prefix, trim = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if spec.get(2):
                    raise ValueError("models with a character map are not supported")
        return cls(pieces, np.array(scores), np.array(types), kind, prefix, trim).prepare()

    def prepare(self) -> Codec:
        if self.kind not in (1, 2) or self.trim or not self.prefix:
            raise ValueError("only unigram and BPE models with a leading space and untrimmed spaces are supported")
        if (self.types == 4).any():
            raise ValueError("models with user-defined pieces, which match before any other, are not supported")
        use = np.flatnonzero(self.types == 1)
        ids = {self.pieces[i]: int(i) for i in use}
        byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == 6}
        unknown = int(np.flatnonzero(self.types == 2)[0]) if (self.types == 2).any() else 0
        t = self.tables = {"ids": ids, "byte": byte, "unknown": unknown, "spaces": {}}
        rank, left, right = np.full(len(self.pieces), -1, np.int64), np.zeros(len(self.pieces), np.int64), np.zeros(len(self.pieces), np.int64)
        out = use
        if self.kind == 2:
            order = sorted((i for i in use if len(self.pieces[i]) > 1), key=lambda i: -self.scores[i])
            rank[order] = np.arange(len(order))
            good = [i for i in use if len(self.pieces[i]) == 1]
            for i in order:
                p, last = self.pieces[i], []
                if len(self.merge(p, last)) == 1 and last[0] in ids and last[1] in ids:
                    left[i], right[i] = ids[last[0]], ids[last[1]]
                    good.append(i)
            out = np.array([i for i in good if set(self.pieces[i]) != {SPACE} or self.pieces[i] == SPACE])
        t |= {"rank": rank, "left": left, "right": right}
        words = [self.pieces[i] for i in out]
        h = np.array([self._hash(w) for w in words], dtype=np.uint64)
        by = np.argsort(h)
        t |= {"keys": h[by], "key_ids": out[by].astype(np.int64), "longest": max(map(len, words)), "hash": np.zeros(len(self.pieces), np.uint64), "length": np.array([len(p) for p in self.pieces])}
        if len(h) and (np.diff(t["keys"]) == 0).any():
            raise ValueError("pieces collide")
        t["hash"][out] = h
        t["filter"] = np.zeros(1 << FILTER_BITS, dtype=bool)
        t["filter"][_mix(h) >> np.uint64(64 - FILTER_BITS)] = True
        power = np.full(max(map(len, self.pieces)) + 64, _BASE, dtype=np.uint64)
        power[0] = 1
        t["power"] = np.cumprod(power)
        t["pairs"], t["allowed"] = np.full(1 << MEMORY_BITS, -1, dtype=np.int64), np.zeros(1 << MEMORY_BITS, dtype=bool)
        # Two characters that are neighbours in a piece; between any others a word may be cut.
        inside = {ord(a) << 32 | ord(b) for i in use for a, b in zip(self.pieces[i], self.pieces[i][1:], strict=False)}
        t["inside"] = np.array(sorted(inside), dtype=np.int64)
        # Decoding: the bytes of each id.
        raw = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else " ⁇ ".encode() if k == 2 else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.types, strict=True)]
        t["raw"], t["raw_at"] = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        return self

    @staticmethod
    def _hash(word: str) -> int:
        h = 0
        for c in word:
            h = (h * _BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    # One word at a time: for the tables and for runs of spaces.

    def merge(self, word: str, last: list | None = None) -> list[str]:
        """BPE by merging: best score first, then leftmost."""
        ids, scores = self.tables["ids"], self.scores
        symbols, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list[tuple] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(word):
                both = symbols[i] + symbols[j]
                if (k := ids.get(both)) is not None:
                    heapq.heappush(heap, (-scores[k], i, j, both))

        for i in range(len(word) - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if symbols[i] is None or after[i] != j or symbols[j] is None or symbols[i] + symbols[j] != both:
                continue
            if last is not None:
                last[:] = [symbols[i], symbols[j]]
            symbols[i], symbols[j] = both, None
            after[i] = after[j]
            if after[j] < len(word):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s in symbols if s is not None]

    def best_sum(self, word: str) -> list[str]:
        """Unigram Viterbi of one word."""
        ids, most = self.tables["ids"], self.tables["longest"]
        low = float(self.scores.min()) - 10
        best, back = [0.0] + [-np.inf] * len(word), [0] * (len(word) + 1)
        for j in range(1, len(word) + 1):
            for n in range(1, min(j, most) + 1):
                k = ids.get(word[j - n : j])
                s = self.scores[k] if k is not None else low if n == 1 else None
                if s is not None and best[j - n] + s > best[j]:
                    best[j], back[j] = best[j - n] + s, n
        out, j = [], len(word)
        while j:
            out.append(word[j - back[j] : j])
            j -= back[j]
        return out[::-1]

    def _ids(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            k = self.tables["ids"].get(s)
            if k is not None:
                out.append(k)
            elif self.tables["byte"]:
                out += [self.tables["byte"][b] for b in s.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.tables["unknown"])
        return out

    def spaces(self, n: int) -> list[int]:
        """The ids of ``n`` space marks that no word takes."""
        if n not in self.tables["spaces"]:
            found = self._ids((self.merge if self.kind == 2 else self.best_sum)(SPACE * n))
            if n > 256:
                return found
            self.tables["spaces"][n] = found
        return self.tables["spaces"][n]

    # Batches.

    def _probe(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, or -1."""
        t = self.tables
        out = np.full(h.shape, _UNKNOWN, dtype=np.int64)
        maybe = t["filter"][_mix(h) >> np.uint64(64 - FILTER_BITS)]
        some = h[maybe]
        at = np.minimum(np.searchsorted(t["keys"], some), len(t["keys"]) - 1)
        out[maybe] = np.where(t["keys"][at] == some, t["key_ids"][at], _UNKNOWN)
        return out

    def _stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the joint text of pieces a and b gives a and b again.

        Takes the last merges of both back in turn; a piece across the border that
        would have come earlier than the merges still undone shows that they do not stay.
        """
        t = self.tables
        rank, ok, live = t["rank"], np.ones(len(a), dtype=bool), np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            m = self._probe(t["hash"][a] * t["power"][t["length"][b]] + t["hash"][b])
            crossed = (m >= 0) & (np.where(m >= 0, rank[m], 0) < limit)
            ok[live[crossed]] = False
            ra, rb = rank[a], rank[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb  # on a tie the left one came first, so the right one goes
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, t["right"][a], a), np.where(first, b, t["left"][b])
        return ok

    def _allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_stable`` with a memory of fixed size; unknown characters never merge."""
        t = self.tables
        out = np.ones(len(a), dtype=bool)
        both = np.flatnonzero((a >= 0) & (b >= 0))
        if not len(both):
            return out
        pair = a[both] * len(self.pieces) + b[both]
        at = _mix(pair.astype(np.uint64)) >> np.uint64(64 - MEMORY_BITS)
        got, miss = t["allowed"][at], t["pairs"][at] != pair
        if miss.any():
            new, back = np.unique(pair[miss], return_inverse=True)
            found = self._stable(new // len(self.pieces), new % len(self.pieces))
            got[miss] = found[back]
            to = _mix(new.astype(np.uint64)) >> np.uint64(64 - MEMORY_BITS)
            t["pairs"][to], t["allowed"][to] = new, found
        out[both] = got
        return out

    def _equal_length(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of one length, [word, character]: length and piece of the segment that ends at each position (0: none)."""
        t = self.tables
        w, n = chars.shape
        prefix = np.zeros((n + 1, w), dtype=np.uint64)
        for j in range(n):
            prefix[j + 1] = prefix[j] * np.uint64(_BASE) + chars[:, j].astype(np.uint64) + np.uint64(1)
        most = min(n, t["longest"])
        found = [None, *(self._probe(prefix[k:] - prefix[: n + 1 - k] * t["power"][k]) for k in range(1, most + 1))]
        size, last = np.zeros((n + 1, w), dtype=np.int16), np.full((n + 1, w), _UNKNOWN, dtype=np.int64)
        if self.kind == 2:
            for j in range(1, n + 1):
                left = np.arange(w)
                for k in range(min(j, most), 0, -1):
                    piece = found[k][j - k][left]
                    can = np.flatnonzero(piece >= 0) if k > 1 else np.arange(len(left))
                    if not len(can):
                        continue
                    at = left[can]
                    if j > k:
                        ok = self._allowed(last[j - k][at], piece[can])
                        can, at = can[ok], at[ok]
                    size[j, at], last[j, at] = k, piece[can]
                    left = np.delete(left, can)
                    if not len(left):
                        break
        else:
            low = float(self.scores.min()) - 10
            best = np.full((n + 1, w), -np.inf)
            best[0] = 0
            for j in range(1, n + 1):
                for k in range(1, min(j, most) + 1):
                    piece = found[k][j - k]
                    s = best[j - k] + np.where(piece >= 0, self.scores[piece], low if k == 1 else -np.inf)
                    up = s > best[j]
                    best[j, up], size[j, up], last[j, up] = s[up], k, piece[up]
        return size, last

    def _cut(self, chars: np.ndarray) -> list[int]:
        """Places of a word before which no piece, and hence no merge, can span the border."""
        pair = chars[:-1].astype(np.int64) << 32 | chars[1:].astype(np.int64)
        known = self.tables["inside"]
        at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
        return (np.flatnonzero(known[at] != pair) + 1).tolist() if len(known) else list(range(1, len(chars)))

    def _long(self, words: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each long word size and last of the segment that ends at each position, by chunks of equal length.

        The segments at a position depend on those of as many positions before it as the longest piece has
        characters, so a chunk that agrees with what is known over that length is right from there on.
        """
        most = self.tables["longest"]
        width = STEP + 4 * most
        chunks, place = [], []
        for i, w in enumerate(words):
            for at in range(0, max(1, len(w) - width + STEP), STEP):
                # The last one is moved back, so that all of a word that is long enough have one length.
                begin = max(0, min(at, len(w) - width))
                chunks.append(w[begin : begin + width])
                place.append((i, begin))
        size = [np.zeros(len(w) + 1, dtype=np.int16) for w in words]
        last = [np.full(len(w) + 1, _UNKNOWN, dtype=np.int64) for w in words]
        done, stuck = [0] * len(words), set()
        length = np.array([len(c) for c in chunks])
        got: list = [None] * len(chunks)
        for n in np.unique(length):
            group = np.flatnonzero(length == n)
            s, p = self._equal_length(np.stack([chunks[k] for k in group]))
            for row, k in enumerate(group):
                got[k] = (s[:, row], p[:, row])
        for (i, begin), (s, p) in zip(place, got, strict=True):
            if i in stuck:
                continue
            known = done[i] - begin  # positions of the chunk that the ones before it settled
            if begin:
                same = (s[1 : known + 1] == size[i][begin + 1 : done[i] + 1]) & (p[1 : known + 1] == last[i][begin + 1 : done[i] + 1])
                run = np.flatnonzero(~same)
                if known - (run[-1] + 1 if len(run) else 0) < most or self.kind != 2:
                    stuck.add(i)
                    continue
            size[i][begin + known + 1 : begin + len(s)], last[i][begin + known + 1 : begin + len(s)] = s[known + 1 :], p[known + 1 :]
            done[i] = begin + len(s) - 1
        for i in stuck:  # no agreement, or sums, which have none: the word as one chunk
            s, p = self._equal_length(words[i][None, :])
            size[i], last[i] = s[:, 0], p[:, 0]
        return list(zip(size, last, strict=True))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in a row, their bounds, and whether a word's first id is a bare space mark.

        Every word begins with the space mark and has no other.
        """
        parts, first = list(words), {}
        for i in [i for i, w in enumerate(words) if len(w) > LONG]:
            cuts = self._cut(np.frombuffer(words[i].encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
            pieces = [words[i][a:b] for a, b in zip([0, *cuts], [*cuts, len(words[i])], strict=True)]
            first[i] = (len(parts), len(pieces))
            parts += pieces
        found = self._encode_parts([("" if i in first else w) for i, w in enumerate(parts)])
        out = [np.concatenate(found[first[i][0] : sum(first[i])]) if i in first else found[i] for i in range(len(words))]
        sizes = np.array([len(x) for x in out], dtype=np.int64)
        flat = np.concatenate(out) if out else np.zeros(0, np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        return flat, at, flat[at[:-1]] == self.tables["ids"].get(SPACE, -2) if len(flat) else np.zeros(0, bool)

    def _encode_parts(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word."""
        n = np.array([len(w) for w in words], dtype=np.int64)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        long = np.flatnonzero(n > LONG)
        wide = [np.frombuffer(words[i].encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for i in long]
        for i, (size, last) in zip(long, self._long(wide), strict=True):
            end, ids = int(n[i]), []
            while end:
                piece = int(last[end])
                ids.append([piece] if piece >= 0 else self._ids([words[i][end - 1]]))
                end -= int(size[end])
            out[i] = np.array([x for part in reversed(ids) for x in part], dtype=np.int64)
        for length in np.unique(n[(n > 0) & (n <= LONG)]):
            group = np.flatnonzero(n == length)
            chars = np.frombuffer("".join([words[i] for i in group]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(group), length)
            size, last = self._equal_length(chars)
            rows, at, steps = np.arange(len(group)), np.full(len(group), length), []
            while len(rows):  # follow the backpointers of all words at once
                steps.append((rows, at, last[at, rows]))
                at = at - size[at, rows]
                rows, at = rows[at > 0], at[at > 0]
            row, end, piece = (np.concatenate(x) for x in zip(*steps, strict=True))
            order = np.lexsort((end, row))
            row, end, piece = row[order], end[order], piece[order]
            cut = np.searchsorted(row, np.arange(1, len(group)))
            ragged = np.split(piece, cut)
            odd = set(row[piece < 0].tolist())
            for k, i in enumerate(group):
                out[i] = ragged[k]
                if k in odd:
                    ends = end[np.searchsorted(row, k) : np.searchsorted(row, k + 1)]
                    out[i] = np.array([x for p, e in zip(ragged[k], ends, strict=True) for x in ([int(p)] if p >= 0 else self._ids([words[i][e - 1]]))], dtype=np.int64)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the end of each text in them."""
        clean = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE, " ")
        lists = pc.split_pattern(clean, " ")
        off = lists.offsets.to_numpy().astype(np.int64)
        off = off - off[0]
        coded = pc.dictionary_encode(lists.flatten())
        codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        empty = np.array([not w for w in distinct], dtype=bool)[codes] if len(codes) else np.zeros(0, bool)
        text = np.repeat(np.arange(len(off) - 1), np.diff(off))
        blank = np.zeros(len(off) - 1, dtype=bool)
        blank[pc.equal(clean, "").to_numpy(zero_copy_only=False)] = True
        # Units: a word with the empty segments before it, or those at a text's end.
        place = np.arange(len(codes))
        full = np.flatnonzero(~empty)
        before = np.maximum.accumulate(np.concatenate([[-1], np.where(empty, -1, place)]))[:-1] if len(codes) else place
        gap = place - np.maximum(before, off[:-1][text] - 1) - 1  # empty segments in front, of the same text
        tail = (place == off[1:][text] - 1) & empty & ~blank[text]
        unit = np.flatnonzero(~empty | tail)
        word = np.where(empty[unit], -1, codes[unit])
        extra = gap[unit] + empty[unit]
        keys, back = np.unique(word * (1 << 32) + extra, return_inverse=True)
        need, lead = keys >> 32, keys & ((1 << 32) - 1)
        plain = np.unique(need[need >= 0])
        flat, at, bare = self.encode_words([SPACE + distinct[c] for c in plain])
        slot = np.searchsorted(plain, need)
        rows: list[np.ndarray] = []
        simple = np.flatnonzero((lead == 0) & (need >= 0))
        size = np.zeros(len(keys), dtype=np.int64)
        size[simple] = at[slot[simple] + 1] - at[slot[simple]]
        start = np.zeros(len(keys), dtype=np.int64)
        start[simple] = at[slot[simple]]
        grown = len(flat)
        for k in np.flatnonzero((lead > 0) | (need < 0)):
            own = flat[at[slot[k]] : at[slot[k] + 1]] if need[k] >= 0 else np.zeros(0, np.int64)
            marks = int(lead[k])
            if len(own) and bare[slot[k]]:
                own, marks = own[1:], marks + 1
            made = np.concatenate([np.array(self.spaces(marks), dtype=np.int64), own])
            rows.append(made)
            start[k], size[k] = grown, len(made)
            grown += len(made)
        flat = np.concatenate([flat, *rows])
        many = size[back]
        total = int(many.sum())
        ids = flat[np.repeat(start[back] - (np.cumsum(many) - many), many) + np.arange(total)] if total else np.zeros(0, np.int64)
        ends = np.cumsum(np.bincount(text[unit], weights=many, minlength=len(off) - 1)).astype(np.int64)
        return ids, ends

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of ids in a row; bytes that are no UTF-8 become U+FFFD."""
        raw, at = self.tables["raw"], self.tables["raw_at"]
        n = np.diff(at)[ids]
        total = int(n.sum())
        data = raw[np.repeat(at[ids] - (np.cumsum(n) - n), n) + np.arange(total)] if total else np.zeros(0, np.uint8)
        bounds = np.concatenate([[0], np.cumsum(n)])
        stop = bounds[ends]
        begin = np.concatenate([[0], stop[:-1]])
        drop = (stop > begin) & (np.append(data, 0)[np.minimum(begin, len(data))] == 32)
        drop &= np.append(self.types[ids], 0)[np.minimum(np.concatenate([[0], ends[:-1]]), len(ids))] != 6
        begin = begin + drop
        whole = data.tobytes()
        try:
            whole.decode()
            keep = np.ones(len(data), dtype=bool)
            keep[(begin - 1)[drop]] = False
            off = np.concatenate([[0], np.cumsum(stop - begin)])
            return pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data[keep])])
        except UnicodeDecodeError:
            return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(begin, stop, strict=True)], pa.large_string())


def with_ids(docs: DataFrame, codec: Codec, text: str = "text", ids: str = "ids", same: str | None = None) -> DataFrame:
    """``docs`` with the column ``ids`` in place of the text; ``same``: whether decoding gives the very text back (not where it holds the space mark itself)."""
    sent = docs.sparkSession.sparkContext.broadcast(codec)  # a vocabulary, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).cast(pa.large_string())
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            cut = np.flatnonzero(np.diff(size // BLOCK_BYTES)) + 1 if len(size) else []
            for i, j in zip([0, *cut], [*cut, len(texts)], strict=True):
                part = texts.slice(i, j - i)
                found, ends = sent.value.encode(part)
                off = np.concatenate([[0], ends]).astype(np.int32)
                columns = [*(c.slice(i, j - i) for c in b.columns[:-1]), pa.ListArray.from_arrays(off, pa.array(found.astype(np.int32)))]
                if same:
                    columns.append(pc.equal(sent.value.decode(found, ends), pc.fill_null(part, "")))
                yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], ids, *([same] if same else [])])

    return map_last(docs, text, run, f"{ids} array<int>" + (f", {same} boolean" if same else ""))


def with_texts(rows: DataFrame, codec: Codec, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the decoded ``text`` in place of the ids; null ids give an empty text."""
    sent = rows.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.num_columns - 1)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
            texts = sent.value.decode(pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64), ends)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts.cast(pa.string())], names=[*b.schema.names[:-1], text])

    return map_last(rows.withColumn(ids, quoted(ids).cast("array<int>")), ids, run, f"{text} string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL_PATH) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip (decoding the ids gives the text) of every whole text."""
    out = with_ids(documents(spark, sf_dir).select("doc_id", "text"), Codec.load(model), same="round_trip")
    return out.select("doc_id", "ids", F.size("ids").alias("n_tokens"), "round_trip")
