"""Personal data: fixed patterns, and candidates that boosted trees judge, in DataFrame functions only.

Base spans come from four patterns (email, ip, card, phone), leftmost and
non-overlapping for each kind, then checked (digits, ranges, Luhn); a match
that fails is dropped and not tried anew. High-recall generators propose more
spans, overlapping ones too: obfuscated addresses, local phone numbers, IPv6,
credentials, national and bank numbers. Gradient-boosted trees, trained in numpy on
examples drawn from the formats' rules, see format and context and keep what
passes a threshold calibrated for precision; scoring is one SQL expression.

The patterns are written without repeated groups over unbounded text (which
recurse in the JVM's engine) and without starts inside a run (which rescan it):
a single separator between digits, or dot between domain characters, first becomes one
private-use character, so that each run is a plain character class.

Defined results
* a null text counts as empty: no spans; ``redact`` leaves null as it is;
* positions are code points, end exclusive; very long texts are searched whole;
* repeated rows get the same spans; an empty table gives an empty table; extra
  columns are ignored or, in ``redact``, passed on, whatever their names.
"""

from __future__ import annotations

import re
from functools import cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import documents, quoted, unused

BASE_KINDS = ("email", "ip", "card", "phone")
_JOIN, _OTHER = "\ue000", "\ue001"
_LOCAL = r"A-Za-z0-9._%+-"
_EMAIL = rf"(?:\G|(?<![\uE000{_LOCAL}]))[\uE000{_LOCAL}]++@[A-Za-z0-9-]++\uE000[\uE000A-Za-z0-9-]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9\uE000])(?:[0-9]\uE000?){12,19}(?![0-9\uE000])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IP_OK = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"

#: Generators of candidates: kind and pattern.
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[({] ?(?:at|AT|@) ?[\])}] ?| at )[A-Za-z0-9-]++(?:(?: ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| dot |\.)[A-Za-z0-9-]++)++"),
    ("phone", r"(?<![0-9A-Za-z.+-])(?:00[1-9][0-9]{0,2}[ .-])?(?:\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-][0-9]{4}|\([0-9]{2,5}\) ?[0-9]{3}[ .-]?[0-9]{3,5}|0[0-9]{2,4}[ ./-][0-9]{3,4}[ ./-]?[0-9]{3,5})(?![0-9A-Za-z-])"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("secret", r"(?<![A-Za-z0-9+/_.-])(?:eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)?+|AKIA[A-Z0-9]{12,}+|[A-Za-z0-9+/_-]{20,}+={0,2}+)(?![A-Za-z0-9+/_=-])"),
    ("id", r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])"),
)
CONTEXT = 32
#: Features of a candidate: a pattern whose matches are counted, and where (the span, the text before, the character after).
FEATURES = (
    ("span", r"[0-9]"), ("span", r"[A-Za-z]"), ("span", r"[ .()-]"), ("span", r"[a-f0-9]"), ("span", r"."), ("span", r"[A-Z]"),
    ("span", r"(?i)[\[({] ?(?:at|@) ?[\])}]| at "), ("span", r"(?i)[\[({] ?(?:dot|\.) ?[\])}]| dot "), ("span", r":"),
    ("before", r"(?i)\b(?:tel|telefon[oe]?|t[eé]l[eé]phone|m[oó]vil|handy|phone|call|fax|mobile|cell|whatsapp|sms)\b"), ("before", r"(?i)\b(?:e-?mail|write|reach|contact)\b"),
    ("before", r"(?i)(?:token|secret|key|passw(?:or)?d|pwd|auth|bearer|credential|clave|contrase[nñ]a|passwort|kennwort|schl[uü]ssel|mot de passe|cl[eé]|jeton)s?\W{0,8}$"),
    ("before", r"(?i)\b(?:ssn|social security|passport|iban|account|tax id|id number)\b"),
    ("before", r"(?i)\b(?:version|page|isbn|issn|order|invoice|figure|table|section|build|part|serial|rev|commit|sha|md5|hash|checksum|time)\b"),
    ("span", r"^(?:eyJ[^.]{8,}\.|AKIA[A-Z0-9]{16}$)"), ("span", r"^0|^\("), ("before", r"[A-Za-z0-9]$"), ("before", r"[\"'=:]\W?$"), ("after", r"[A-Za-z0-9]"), ("after", r"[\"']"),
)


# Boosted trees.


def _examples(seed: int, n: int) -> list[tuple[str, str, str, str, int]]:
    """Drawn candidates: kind, before, span, after, whether personal or secret."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    some = lambda alphabet, k: "".join(rng.choice(list(alphabet), k))
    low, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    word = lambda a=2, b=9: some(low, rng.integers(a, b))
    plain = lambda: " ".join(word() for _ in range(4)) + " "
    sep = lambda: pick(": ", " ", " = ", ' = "', "=", " is ")
    out = []
    for _ in range(n):
        at, dot = pick(" at ", " (at) ", "[at]", " [AT] "), pick(" dot ", " (dot) ", "[dot]", ".")
        out.append(("email", pick(plain(), pick("email", "contact", "reach me", "write to") + sep()), word() + at + word() + (dot if " at " != at else pick(" dot ", "[dot]")) + pick("com", "org", "net", "de"), pick(" ", "", "."), 1))
        out.append(("email", plain(), word() + " at " + word() + "." + word(), pick(" ", ""), 0))
        number = lambda s: some(dig, 3) + s + some(dig, 3) + s + some(dig, 4)
        local = pick("0" + some(dig, 2) + pick("-", " ", "/") + some(dig, 3) + pick("-", " ", "") + some(dig, 4), "(0" + some(dig, 2) + ")" + some(dig, 3) + "-" + some(dig, 4), "0" + some(dig, 3) + " " + some(dig, 3) + " " + some(dig, 4))
        out.append(("phone", pick("tel", "call me", "phone", "telefon", "teléfono", "téléphone", "móvil", "handy", "fax") + sep(), local, pick(" ", ".", ""), 1))
        out.append(("phone", pick(pick("order", "isbn", "part", "serial", "invoice", "page") + sep(), plain() + some(dig, 4) + " "), "0" + some(dig, 3) + " " + some(dig, 3) + " " + some(dig, 4), pick(" ", ""), 0))
        out.append(("phone", pick("tel", "call me", "phone", "mobile", "fax", "cell") + sep(), pick(number("-"), number(" "), number("."), "(" + some(dig, 3) + ") " + some(dig, 3) + "-" + some(dig, 4)), pick(" ", ".", ""), 1))
        out.append(("phone", pick(pick("order", "isbn", "part", "serial", "version", "invoice", "page") + sep(), plain() + some(dig, 4) + " "), pick(number("-"), number(" "), number(".")), pick(" ", "", "-"), 0))
        out.append(("phone", plain(), "(" + some(dig, 3) + ") " + some(dig, 3) + "-" + some(dig, 4), pick(" ", ".", ""), 1))
        out.append(("ip", plain(), ":".join(some(hexa, pick(3, 4)) for _ in range(rng.integers(5, 9))), pick(" ", "."), 1))
        out.append(("ip", pick("time ", plain()), ":".join(some(dig, 2) for _ in range(4)), pick(" ", "."), 0))
        secret = pick(some(hexa, 40), some(hexa, 32), some(low + dig + low.upper(), rng.integers(24, 48)), some(low + dig + low.upper() + "+/", 43) + "=")
        part = lambda: some(low + dig + low.upper() + "_-", rng.integers(20, 60))
        out.append(("secret", pick(plain(), "bearer "), pick("eyJ" + part() + "." + part() + "." + part(), "AKIA" + some(low.upper() + dig, 16)), pick(" ", ".", '"', ""), 1))
        out.append(("secret", pick("token", "api key", "secret", "password", "auth_token", "key", "clave", "passwort", "mot de passe", "contraseña", "schlüssel") + pick(' = "', "=", ": ", " = ", '": "'), secret, pick('"', " ", "", "'"), 1))
        out.append(("secret", pick(pick("commit", "sha", "md5", "checksum", "hash", "build") + sep(), plain()), pick(secret, some(low, rng.integers(20, 40)), some(low, 12) + "-" + some(low, 12), some(dig, 24)), pick(" ", "", "."), 0))
        out.append(("id", pick("ssn", "social security number", "passport", "tax id") + sep(), some(dig, 3) + "-" + some(dig, 2) + "-" + some(dig, 4), pick(" ", "."), 1))
        out.append(("id", pick(pick("part", "order", "serial", "isbn", "table") + sep(), plain()), some(dig, 3) + "-" + some(dig, 2) + "-" + some(dig, 4), pick(" ", "."), int(rng.random() < 0.1)))
        iban = some(low.upper(), 2) + some(dig, 2) + "".join(pick(" ", "") + some(dig, 4) for _ in range(rng.integers(3, 6)))
        out.append(("id", pick("iban", "account", "bank account") + sep(), iban, pick(" ", "."), 1))
        out.append(("id", pick(pick("part", "serial", "order") + sep(), plain()), some(low.upper(), 2) + some(dig, 2) + " " + some(low.upper(), 4) + some(dig, 4) + some(low.upper(), 4), " ", 0))
    return out


def _describe(before: str, span: str, after: str) -> list[int]:
    parts = {"span": span, "before": before[-CONTEXT:], "after": after[:1]}
    return [len(re.findall(p, parts[where], re.ASCII)) for where, p in FEATURES]


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 20, rate: float = 0.4) -> list[tuple]:
    """Trees of depth two on the logistic loss: (feature, cut, then (feature, cut, low, high) below and above)."""
    f, trees = np.zeros(len(y)), []
    cuts = [(j, c + 0.5) for j in range(x.shape[1]) for c in np.unique(x[:, j])[:-1]]
    above = np.array([x[:, j] > c for j, c in cuts])

    def best(g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[float, int]:
        up = above[:, rows]
        ga, ha, gt, ht = up @ g[rows], up @ h[rows], g[rows].sum(), h[rows].sum()
        gain = ga**2 / (ha + 1) + (gt - ga) ** 2 / (ht - ha + 1)
        return float(gain.max()), int(gain.argmax())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        every = np.arange(len(y))
        scored = []
        # Of the most telling first cuts, the one whose own best cuts gain most.
        up = above
        ga, ha = up @ g, up @ h
        gain = ga**2 / (ha + 1) + (g.sum() - ga) ** 2 / (h.sum() - ha + 1)
        for k in np.argsort(-gain)[:6]:
            sides = [every[~above[k]], every[above[k]]]
            below = [best(g, h, s) for s in sides]
            scored.append((sum(b[0] for b in below), int(k), [b[1] for b in below], sides))
        _, k, inner, sides = max(scored, key=lambda s: s[0])
        ends = []
        for i, side in zip(inner, sides, strict=True):
            values = []
            for take in (side[~above[i, side]], side[above[i, side]]):
                v = rate * g[take].sum() / (h[take].sum() + 1)
                f[take] += v
                values.append(float(v))
            ends.append((*cuts[i], *values))
        trees.append((*cuts[k], *ends))
    return trees


def _margin(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for j, c, low, high in trees:
        a, b = (np.where(x[:, k] > d, v, u) for k, d, u, v in (low, high))
        out += np.where(x[:, j] > c, b, a)
    return out


@cache
def model(precision: float = 0.98) -> tuple[dict, dict]:
    """Trees and margin threshold of each generator; the threshold reaches ``precision`` on examples kept apart."""
    trees, cut = {}, {}
    for kind in dict.fromkeys(k for k, _ in GENERATORS):
        sets = []
        for seed, n in ((1, 120), (2, 120)):
            rows = [e for e in _examples(seed, n) if e[0] == kind]
            sets.append((np.array([_describe(b, s, a) for _, b, s, a, _ in rows]), np.array([e[-1] for e in rows], dtype=float)))
        trees[kind] = boost(*sets[0])
        m, y = _margin(trees[kind], sets[1][0]), sets[1][1]
        order = np.argsort(-m)
        right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(right >= precision)
        cut[kind] = max(0.0, float(m[order][good[-1]]) - 1e-9) if len(good) else float("inf")
    return trees, cut


# Spans in SQL.

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _matches(text: Column, pattern: str) -> Column:
    """Non-overlapping matches with their places: array of start, end, s, before, after."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    k = F.size(found)
    rows = F.arrays_zip(F.slice(gaps, F.lit(1), k).alias("g"), found.alias("m"), F.slice(gaps, F.lit(2), k).alias("n"))
    kind = "array<struct<start:int,end:int,s:string,before:string,after:string>>"
    walked = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
        lambda a, r: F.struct(
            (a["at"] + F.length(r["g"]) + F.length(r["m"])).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + F.length(r["g"])).alias("start"), (a["at"] + F.length(r["g"]) + F.length(r["m"])).alias("end"), r["m"].alias("s"), F.right(r["g"], F.lit(CONTEXT)).alias("before"), F.left(r["n"], F.lit(1)).alias("after")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(F.size(found) > 0, walked).otherwise(F.array().cast(kind))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    d = F.reverse(_digits(s))

    def term(i: Column) -> Column:
        v = d.substr(i, F.lit(1)).cast("int")
        twice = v * 2
        return F.when(i % 2 == 1, v).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def base_spans(text: Column) -> dict[str, Column]:
    """Matches of each base kind that pass its check."""
    none = _empty("array<struct<start:int,end:int,s:string,before:string,after:string>>")
    clean = F.translate(text, _JOIN, _OTHER)
    digit = text.rlike("[0-9]")
    email = _matches(F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _JOIN), _EMAIL)
    card = _matches(F.regexp_replace(clean, r"(?<=[0-9])[ -](?=[0-9])", _JOIN), _CARD)
    n = lambda m: F.length(_digits(m["s"]))
    return {
        "email": F.when(F.contains(text, F.lit("@")), email).otherwise(none),
        "ip": F.when(digit, F.filter(_matches(text, _IP), lambda m: m["s"].rlike(_IP_OK))).otherwise(none),
        "card": F.when(digit, F.filter(card, lambda m: _luhn(m["s"]))).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(_matches(text, _PHONE), lambda m: (n(m) >= 9) & (n(m) <= 15))).otherwise(none),
    }


def _judged(text: Column, kind: str, pattern: str) -> Column:
    """Candidates of a generator that the trees keep."""
    trees, cut = model()

    def margin(m: Column) -> Column:
        part = {"span": m["s"], "before": m["before"], "after": m["after"]}
        x = [F.regexp_count(part[where], F.lit(p)) for where, p in FEATURES]
        leaf = lambda t: F.when(x[t[0]] > t[1], t[3]).otherwise(t[2])
        return reduce(lambda a, b: a + b, (F.when(x[j] > c, leaf(high)).otherwise(leaf(low)) for j, c, low, high in trees[kind]))

    return F.filter(_matches(text, pattern), lambda m: margin(m) > cut[kind])


def _places(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


KINDS = (*BASE_KINDS, "secret", "id")


def with_spans(docs: DataFrame, text: str, base: str, spans: str) -> DataFrame:
    """``docs`` with two arrays of (start, kind, end), sorted: the base spans, and all spans.

    ``kind`` is a place in ``KINDS``. A judged candidate that overlaps a kept longer,
    or as long and earlier, candidate is left out; one that overlaps a base span stays beside it.
    """
    (own, more) = unused(docs.columns, "own", "more")
    body = F.coalesce(quoted(text), F.lit(""))
    found = base_spans(body)
    own_spans = F.array_sort(F.concat(*(_places(found[k], i) for i, k in enumerate(BASE_KINDS))))
    none = _empty(_SPAN)
    asks = {"email": body.rlike(r"(?i)[\[( {]at[\]) }]|[\[({] ?@"), "secret": body.rlike(r"[A-Za-z0-9+/_-]{20}|AKIA|eyJ"), "ip": F.contains(body, F.lit(":"))}
    digit = body.rlike("[0-9]")
    judged = F.concat(*(F.when(asks.get(k, digit), _places(_judged(body, k, p), KINDS.index(k))).otherwise(none) for k, p in GENERATORS))
    out = docs.withColumn(own, own_spans).withColumn(more, F.array_sort(judged))
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    better = lambda a, b: ((a["end"] - a["start"]) > (b["end"] - b["start"])) | (((a["end"] - a["start"]) == (b["end"] - b["start"])) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["kind"] < b["kind"]))))
    best = F.array_sort(F.col(more), lambda a, b: F.when(better(a, b), -1).when(better(b, a), 1).otherwise(0))
    alone = F.aggregate(best, none, lambda kept, c: F.when(F.exists(kept, lambda b: meets(c, b)), kept).otherwise(F.concat(kept, F.array(c))))
    out = out.withColumn(more, F.when(F.size(more) == 0, none).otherwise(alone))
    return out.withColumn(base, F.col(own)).withColumn(spans, F.array_sort(F.concat(F.col(own), F.col(more)))).drop(own, more)


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets; overlapping spans become one."""
    base, spans = unused(docs.columns, "base", "spans")
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    body = quoted(text)
    walked = F.aggregate(
        F.col(spans),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when((s["start"] < a["at"]), a["out"]).otherwise(F.concat(a["out"], body.substr(a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"]))).alias("out"),
        ),
        lambda a: F.concat(a["out"], body.substr(a["at"] + 1, F.length(body))),
    )
    out = with_spans(docs, text, base, spans)
    new = F.when(F.size(spans) > 0, walked).otherwise(body)
    return out.select(*(new.alias(c) if c == text else quoted(c) for c in docs.columns))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(documents(spark, sf_dir).select("doc_id", "text"), "text", "base", "all")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == BASE_KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))
