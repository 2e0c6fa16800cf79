"""Line dedup over windows of three consecutive lines, in DataFrame functions only.

A window that occurs more than once in the whole table keeps its first
occurrence, by (doc_id, text hash, line number), nulls first; the lines of every later
occurrence go. Overlapping later occurrences cover a merged stretch of lines.

Defined results
* lines end at ``\\n``; windows of nothing but white space do not count;
* documents of fewer than three lines have no window and stay as they are;
* rows with the same doc_id and the same text are one document: they lose the
  same lines, and do not count as repetitions of each other;
* a null text stays null; a null doc_id is an id of its own; a text that loses
  all its lines becomes empty; an empty table gives an empty table;
* other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import documents, quoted, same, staged, unused

WIDTH = 3


def _windows(lines: Column) -> Column:
    """A 128-bit key for each run of three lines; null for a blank run."""

    def key(i: Column) -> Column:
        a, b, c = (F.get(lines, i + k) for k in range(WIDTH))
        blank = F.trim(F.translate(F.concat(a, b, c), "\t\r\f\x0b", "    ")) == ""
        return F.when(~blank, F.struct(F.xxhash64(a, b, c).alias("h"), F.xxhash64(c, F.lit(WIDTH), b, a).alias("g")))

    return F.when(F.size(lines) >= WIDTH, F.transform(F.sequence(F.lit(0), F.size(lines) - WIDTH), key))


def window_hits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Later occurrences: d, t (the document's id and text hash), starts (array of line numbers)."""
    wins = (
        docs.where(quoted(text).isNotNull())
        .select(quoted(doc_id).alias("d"), F.xxhash64(quoted(text)).alias("t"), F.split(quoted(text), "\n", -1).alias("lines"))
        .select("d", "t", F.posexplode(_windows(F.col("lines"))).alias("pos", "key"))
        .where("key is not null")
        .select(F.col("key.h").alias("h"), F.col("key.g").alias("g"), "d", "t", "pos")
    )
    at = F.struct("d", "t", "pos")
    # Written, so that the join below deals it anew: then a hot window can be split.
    repeated = staged(wins.groupBy("h", "g").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first != last").select("h", "g", "first"), "line-repeated")
    later = wins.join(repeated, ["h", "g"]).where(at != F.col("first"))
    return later.groupBy("d", "t").agg(F.collect_set("pos").alias("starts"))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """``docs`` without the lines of later occurrences; ``removed`` names a column for their number."""
    d, t, starts, gone = unused(docs.columns, "d", "t", "starts", "gone")
    hits = window_hits(docs, doc_id, text).select(F.col("d").alias(d), F.col("t").alias(t), F.col("starts").alias(starts))
    both = docs.join(hits.hint("shuffle_hash"), same(quoted(doc_id), F.col(d)) & (F.xxhash64(quoted(text)) == F.col(t)), "left")
    lines = F.split(quoted(text), "\n", -1)
    covered = F.flatten(F.transform(F.col(starts), lambda p: F.array(*(p + k for k in range(WIDTH)))))
    # array_except hashes: linear even in a document of very many lines.
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    out = both.withColumn(gone, F.when(F.col(starts).isNotNull(), F.size(F.array_distinct(covered))).otherwise(0).cast("long"))
    new = F.when(F.col(starts).isNull(), quoted(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    columns = [new.alias(c) if c == text else quoted(c) for c in docs.columns]
    return out.select(*columns, *([F.col(gone).alias(removed)] if removed else []))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that is left, and how many lines went."""
    return line_dedup(documents(spark, sf_dir).select("doc_id", "text"), removed="n_removed")


OP2_SQL = """
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), wins AS (
  SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS win
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS rn
    FROM wins WHERE win IS NOT NULL AND NOT regexp_full_match(win, '\\s*'))
  WHERE rn > 1
), covered AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) AS o(k)
), left_over AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL) AS text,
         count(c.pos) AS n_removed
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text,
       coalesce(o.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN left_over o USING (doc_id)
"""
