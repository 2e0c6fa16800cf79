"""Every graph query by name, with the parameters that the checks use, and the SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import dates, scalars
from graphloom.graph import PropertyGraph, edge_info
from graphloom.operators import algorithms, expand, filters, text, traverse
from graphloom.operators.topk import top
from graphloom.plans import intelligence, interactive
from graphloom.sources.fixture import SQL as GRAPH_SQL
from graphloom.sources.fixture import read, social_graph
from graphloom.sources.fixture_csv import csv_social_graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
LEVELS = 14  # beyond the greatest distance of the fixture at any scale


def graph_query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a function of the graph; ``sql`` may use the graph's tables."""

    def put(f: Callable[[PropertyGraph], DataFrame]) -> Callable:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(social_graph(spark, sf_dir))
        if sql:
            SQL[key] = f"WITH RECURSIVE {GRAPH_SQL} {sql}"
        return f

    return put


def table_query(sql: str | None = None) -> Callable:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def levels_sql(start: str, edges: str = "knows", depth: int = LEVELS, name: str = "lv") -> str:
    """Tables name0 to name``depth``: (id, d) of all vertices within as many hops."""
    out = [f", {name}0 AS MATERIALIZED (SELECT id, 0 AS d FROM ({start}))"]
    for k in range(1, depth + 1):
        out.append(f", {name}{k} AS MATERIALIZED (SELECT * FROM {name}{k - 1} UNION ALL SELECT DISTINCT e.dst, {k} FROM {name}{k - 1} f JOIN {edges} e ON e.src = f.id WHERE f.d = {k - 1} AND e.dst NOT IN (SELECT id FROM {name}{k - 1}))")
    return "".join(out)


START, MAX_DATE = 0, "1998-01-01"
ONE = f"SELECT CAST({START} AS BIGINT) AS id"

# Access.


@graph_query("SELECT id, firstName, lastName, cityId FROM person WHERE id = 7")
def vertex_by_id(g: PropertyGraph) -> DataFrame:
    return g.vertex("person", 7).select("id", "firstName", "lastName", "cityId")


@graph_query("SELECT id, name FROM tag WHERE id = -5")
def vertex_by_unknown_id(g: PropertyGraph) -> DataFrame:
    return g.vertex("tag", -5).select("id", "name")


@graph_query("SELECT min(id) AS id, 'BUILDING' AS firstName FROM person WHERE firstName = 'BUILDING'")
def vertex_by_prop(g: PropertyGraph) -> DataFrame:
    return g.by_property("person", "firstName", "BUILDING").select("id", "firstName")


@graph_query("SELECT id, name, tagclass FROM tag")
def label_scan(g: PropertyGraph) -> DataFrame:
    return g.vertices["tag"].select("id", "name", "tagclass")


_LABELS = ("person", "city", "country", "tag", "tagclass", "message", "forum", "organisation")


@graph_query(" UNION ALL ".join(f"SELECT '{n}' AS label, count(*) AS vertices FROM {n}" for n in _LABELS))
def label_counts(g: PropertyGraph) -> DataFrame:
    return g.label_counts()


_KINDS = (
    ("person", "knows", "person", "knows"), ("person", "isLocatedIn", "city", "person"), ("city", "isPartOf", "country", "city"), ("message", "hasCreator", "person", "message"),
    ("message", "replyOf", "message", "replyOf"), ("message", "hasTag", "tag", "hasTag"), ("tag", "hasType", "tagclass", "tag"), ("forum", "containerOf", "message", "containerOf"),
    ("forum", "hasMember", "person", "hasMember"), ("forum", "hasModerator", "person", "hasModerator"), ("person", "hasInterest", "tag", "hasInterest"),
    ("person", "studyAt", "organisation", "studyAt"), ("person", "workAt", "organisation", "workAt"),
)


@graph_query(" UNION ALL ".join(f"SELECT '{a}' AS src, '{t}' AS type, '{b}' AS dst, count(*) AS edges FROM {rel}" for a, t, b, rel in _KINDS))
def edge_kind_counts(g: PropertyGraph) -> DataFrame:
    return g.edge_kind_counts()


@graph_query("SELECT id, count(src) AS degree FROM person LEFT JOIN knows ON src = id GROUP BY id")
def degree_out(g: PropertyGraph) -> DataFrame:
    return expand.degrees(g.vertices["person"], g.edge("knows"))


@graph_query("SELECT t.id, count(src) AS degree FROM tag t LEFT JOIN hasTag ON dst = t.id GROUP BY t.id")
def degree_in(g: PropertyGraph) -> DataFrame:
    return expand.degrees(g.vertices["tag"], g.edge("hasTag", "message"), "dst")


@graph_query(
    "SELECT (SELECT count(*) FROM person) AS vertices, (SELECT count(*) FROM knows) AS edges, (SELECT max(n) FROM (SELECT count(*) AS n FROM knows GROUP BY src)) AS max_out,"
    " (SELECT max(n) FROM (SELECT count(*) AS n FROM knows GROUP BY dst)) AS max_in, round((SELECT count(*) FROM knows) / (SELECT count(*) FROM person), 9) AS avg_out"
)
def degree_stats(g: PropertyGraph) -> DataFrame:
    return expand.degree_statistics(g.vertices["person"], g.edge("knows")).withColumn("avg_out", F.round("avg_out", 9))


@graph_query("SELECT src, dst, 'hasMember|' || strftime(joinDate, '%Y-%m-%d') AS info FROM hasMember")
def edge_full_info(g: PropertyGraph) -> DataFrame:
    e = g.edge("hasMember")
    return e.select("src", "dst", edge_info("hasMember", e).alias("info"))


@graph_query("SELECT src, dst, 'workAt' AS type, CAST(workFrom AS VARCHAR) AS rest FROM workAt")
def edge_info_parts(g: PropertyGraph) -> DataFrame:
    e = g.edge("workAt")
    info = edge_info("workAt", e)
    return e.select("src", "dst", scalars.edge_type_of(info).alias("type"), scalars.edge_rest_of(info).alias("rest"))


# Expansion.


@graph_query("SELECT m.creator AS vid, t.dst AS nbr FROM message m JOIN hasTag t ON t.src = m.id")
def expand_out_typed(g: PropertyGraph) -> DataFrame:
    mine = g.vertices["message"].select(F.col("id").alias("m"), "creator")
    return expand.out_neighbours(mine, g.edge("hasTag", "message"), "m").select(F.col("creator").alias("vid"), "nbr")


@graph_query("SELECT p.id AS vid, m.id AS nbr FROM person p JOIN message m ON m.creator = p.id")
def expand_in_typed(g: PropertyGraph) -> DataFrame:
    return expand.in_neighbours(g.vertices["person"].select(F.col("id").alias("vid")), g.edge("hasCreator"))


@graph_query("SELECT src AS vid, dst AS nbr FROM knows UNION SELECT dst, src FROM knows")
def union_neighbors(g: PropertyGraph) -> DataFrame:
    return expand.both_neighbours(g.vertices["person"].select(F.col("id").alias("vid")), g.edge("knows"))


@graph_query("SELECT src AS vid, dst AS nbr, 'studyAt' AS type FROM studyAt UNION ALL SELECT src, dst, 'workAt' FROM workAt")
def edge_type_filter(g: PropertyGraph) -> DataFrame:
    persons = g.vertices["person"].select(F.col("id").alias("vid"))
    return expand.out_neighbours(persons, g.edge("studyAt")).withColumn("type", F.lit("studyAt")).unionAll(expand.out_neighbours(persons, g.edge("workAt")).withColumn("type", F.lit("workAt")))


@graph_query("SELECT src AS vid, dst AS nbr FROM hasMember WHERE joinDate >= DATE '1998-01-01'")
def edge_prop_filter(g: PropertyGraph) -> DataFrame:
    return expand.out_neighbours(g.vertices["forum"].select(F.col("id").alias("vid")), g.edge("hasMember"), where=F.col("joinDate") >= F.to_date(F.lit("1998-01-01")))


@graph_query("SELECT h.src AS vid, h.dst AS nbr FROM hasMember h JOIN person p ON p.id = h.dst WHERE joinDate >= DATE '1998-01-01' AND p.firstName = 'BUILDING'")
def conditional_fetch(g: PropertyGraph) -> DataFrame:
    f = g.vertices["forum"].select(F.col("id").alias("vid"))
    return expand.conditional_fetch(f, g.edge("hasMember"), g.vertices["person"], F.col("joinDate") >= F.to_date(F.lit("1998-01-01")), F.col("firstName") == "BUILDING").select("vid", "nbr")


@graph_query("SELECT k.src, k.dst FROM knows k WHERE (k.src, k.dst) IN (SELECT dst, src FROM knows)")
def edges_between(g: PropertyGraph) -> DataFrame:
    back = g.edge("knows").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return expand.edges_between(g.edge("knows"), back).select("src", "dst")


@graph_query("SELECT DISTINCT m.id FROM message m JOIN hasTag t ON t.src = m.id JOIN hasInterest i ON i.dst = t.dst AND i.src = 1")
def semi_join_exists(g: PropertyGraph) -> DataFrame:
    liked = g.edge("hasTag", "message").join(g.edge("hasInterest").where("src = 1").select("dst"), "dst", "left_semi")
    return g.vertices["message"].select("id").join(liked.select(F.col("src").alias("id")), "id", "left_semi")


@graph_query(f"{levels_sql(ONE, depth=2)} SELECT id AS vid FROM person WHERE id NOT IN (SELECT id FROM lv2)")
def not_friends_antijoin(g: PropertyGraph) -> DataFrame:
    near = traverse.friends(g.edge("knows"), START, 0, 2)
    return g.vertices["person"].select(F.col("id").alias("vid")).join(near, "vid", "left_anti")


@graph_query("SELECT DISTINCT dst AS nbr FROM hasTag WHERE src = 3 ORDER BY dst LIMIT 3")
def first_neighbours(g: PropertyGraph) -> DataFrame:
    return expand.first_neighbours(g.edge("hasTag", "message"), 3, 3)


@graph_query("SELECT id AS vid, creator AS nbr FROM message")
def single_neighbour(g: PropertyGraph) -> DataFrame:
    return expand.single_neighbour(g.vertices["message"].select(F.col("id").alias("vid")), g.edge("hasCreator"))


@graph_query("SELECT src, dst, 1.0::DOUBLE / length AS weight FROM (SELECT id AS src, creator AS dst, length FROM message UNION ALL SELECT creator, id, length FROM message)")
def project_both(g: PropertyGraph) -> DataFrame:
    m = g.vertices["message"].select(F.col("id").alias("src"), F.col("creator").alias("dst"), "length")
    return algorithms.project(m, 1 / F.col("length"), "both")


@graph_query("SELECT least(a.creator, b.creator) AS low, greatest(a.creator, b.creator) AS high, count(*) AS n FROM replyOf r JOIN message a ON a.id = r.src JOIN message b ON b.id = r.dst GROUP BY ALL")
def pairwise_interactions(g: PropertyGraph) -> DataFrame:
    r = intelligence.replies_between(g)
    return r.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.count("*").alias("n"))


@graph_query("SELECT a.id AS person1, b.id AS person2 FROM person a JOIN person b ON a.cityId = 1 AND b.cityId = 2")
def city_pairs(g: PropertyGraph) -> DataFrame:
    p = g.vertices["person"]
    return p.where("cityId = 1").select(F.col("id").alias("person1")).crossJoin(p.where("cityId = 2").select(F.col("id").alias("person2")))


# Filters and scalars.

for _name, _op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):

    def _compare(g: PropertyGraph, op: str = _op) -> DataFrame:
        m = g.vertices["message"].where(filters.typed_compare("day", op, MAX_DATE, "date") | filters.typed_compare("length", op, 100000, "long"))
        return m.select("id")

    graph_query(f"SELECT id FROM message WHERE day {_op} DATE '{MAX_DATE}' OR length {_op} 100000", f"typed_compare_{_name}")(_compare)


@graph_query("SELECT id FROM person WHERE (month(birthday) = 12 AND day(birthday) >= 21) OR (month(birthday) = 1 AND day(birthday) < 22)")
def month_band(g: PropertyGraph) -> DataFrame:
    return g.vertices["person"].where(filters.month_band(F.col("birthday"), 12)).select("id")


@graph_query("SELECT id FROM message WHERE length > 0 AND length < 100000")
def length_band(g: PropertyGraph) -> DataFrame:
    return g.vertices["message"].where(filters.within(F.col("length"), 0, 100000)).select("id")


@graph_query("SELECT id FROM message WHERE language IN ('1-URGENT', '5-LOW')")
def set_membership(g: PropertyGraph) -> DataFrame:
    return g.vertices["message"].where(F.col("language").isin("1-URGENT", "5-LOW")).select("id")


@graph_query("SELECT id, coalesce(nullif(content, ''), imageFile) AS content FROM message")
def content_or_image(g: PropertyGraph) -> DataFrame:
    return g.vertices["message"].select("id", filters.content_or(F.col("content"), F.col("imageFile")).alias("content"))


@graph_query("SELECT id, epoch_ms(CAST(day AS TIMESTAMP)) AS ms, strftime(day, '%Y-%m-%d') || 'T00:00:00.000+0000' AS iso, CAST(month(day) AS INTEGER) AS m, CAST(day(day) AS INTEGER) AS d FROM message")
def date_functions(g: PropertyGraph) -> DataFrame:
    ms = dates.epoch_ms(F.col("day"))
    return g.vertices["message"].select("id", ms.alias("ms"), dates.iso_ms(ms).alias("iso"), F.month("day").alias("m"), F.dayofmonth("day").alias("d"))


@graph_query("SELECT id, lower(firstName) AS low, substr(lastName, 1, 8) AS head, split_part(lastName, '#', 2) AS tail, length(bin(id)) AS bits, greatest(round(40 - sqrt(id)), 1.0) AS weight FROM person")
def scalar_functions(g: PropertyGraph) -> DataFrame:
    c = F.col("lastName")
    return g.vertices["person"].select("id", F.lower("firstName").alias("low"), F.substring(c, 1, 8).alias("head"), F.split_part(c, F.lit("#"), F.lit(2)).alias("tail"), scalars.bit_length(F.col("id")).cast("long").alias("bits"), scalars.interaction_weight(F.col("id")).alias("weight"))


@graph_query("SELECT src AS id, string_agg(name, ';' ORDER BY name) AS names FROM hasInterest JOIN tag ON tag.id = dst GROUP BY src")
def multi_value_concat(g: PropertyGraph) -> DataFrame:
    named = g.edge("hasInterest").join(g.vertices["tag"].select(F.col("id").alias("dst"), "name"), "dst")
    return named.groupBy(F.col("src").alias("id")).agg(scalars.concatenated(F.col("name")).alias("names"))


# Aggregates and top-k.


@graph_query("SELECT n, count(*) AS persons FROM (SELECT count(*) AS n FROM message GROUP BY creator) GROUP BY n")
def histogram_of_counts(g: PropertyGraph) -> DataFrame:
    return g.vertices["message"].groupBy("creator").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("persons"))


@graph_query("SELECT creator, count(*) FILTER (day >= DATE '1998-01-01' AND day < DATE '1998-01-01' + 100) AS a, count(*) FILTER (day >= DATE '1998-01-01' + 100 AND day < DATE '1998-01-01' + 200) AS b FROM message GROUP BY creator")
def window_counts(g: PropertyGraph) -> DataFrame:
    d = F.col("day")
    return g.vertices["message"].groupBy("creator").agg(F.count_if(filters.day_window(d, MAX_DATE, 100)).alias("a"), F.count_if(filters.day_window(d, MAX_DATE, 100, 100)).alias("b"))


@graph_query("SELECT creator, sum(CASE WHEN length < 100000 THEN 1 ELSE -1 END)::BIGINT AS score FROM message GROUP BY creator")
def signed_score(g: PropertyGraph) -> DataFrame:
    return g.vertices["message"].groupBy("creator").agg(F.sum(F.when(F.col("length") < 100000, 1).otherwise(-1)).alias("score"))


@graph_query("SELECT creator, count(*) AS n FROM message GROUP BY creator HAVING count(*) > 10")
def having_counts(g: PropertyGraph) -> DataFrame:
    return g.vertices["message"].groupBy("creator").agg(F.count("*").alias("n")).where("n > 10")


@graph_query("SELECT id, length FROM message ORDER BY length DESC, id LIMIT 20")
def topk(g: PropertyGraph) -> DataFrame:
    return top(g.vertices["message"].select("id", "length"), 20, F.col("length").desc(), "id")


@graph_query("SELECT DISTINCT src AS forum FROM hasMember WHERE dst IN (SELECT dst FROM knows WHERE src = 0)")
def distinct_forums(g: PropertyGraph) -> DataFrame:
    return expand.in_neighbours(traverse.friends(g.edge("knows"), START), g.edge("hasMember"), to="forum").select("forum").distinct()


# Traversal and algorithms.


@graph_query(f"{levels_sql(ONE)} SELECT p.id, coalesce(d, -1) AS depth FROM person p LEFT JOIN lv{LEVELS} l ON l.id = p.id")
def bfs(g: PropertyGraph) -> DataFrame:
    return traverse.bfs(g.vertices["person"], g.edge("knows"), START).select("id", F.coalesce("depth", F.lit(-1)).alias("depth"))


SQL["serial_bfs"] = SQL["bfs"]
QUERIES["serial_bfs"] = QUERIES["bfs"]  # one engine: the reference's two variants give the same rows

_ALL = " UNION ALL ".join(f"SELECT '{a}:' || {'id' if rel in ('person', 'city', 'message', 'tag') and t in ('isLocatedIn', 'isPartOf', 'hasCreator', 'hasType') else 'src'} AS src, '{b}:' || { {'isLocatedIn': 'cityId', 'isPartOf': 'countryId', 'hasCreator': 'creator', 'hasType': '(SELECT c.id FROM tagclass c WHERE c.name = tagclass)'}.get(t, 'dst') } AS dst FROM {rel}" for a, t, b, rel in _KINDS)


_EVERYTHING = f", everything AS MATERIALIZED ({_ALL})"
_FROM_PERSON = "SELECT 'person:0' AS id"
_VERTICES = " UNION ALL ".join(f"SELECT '{n}' AS label, id FROM {n}" for n in _LABELS)


@graph_query(f"{_EVERYTHING}{levels_sql(_FROM_PERSON, 'everything')} SELECT v.label, v.id, coalesce(d, -1) AS depth FROM ({_VERTICES}) v LEFT JOIN lv{LEVELS} l ON l.id = v.label || ':' || v.id")
def bfs_whole_graph(g: PropertyGraph) -> DataFrame:
    """Depth of every vertex of every label from a person, -1 where unreached."""
    return algorithms.bfs_all_labels(g, "person", START)


@graph_query(f"{_EVERYTHING}{levels_sql(_FROM_PERSON, 'everything', 4)} SELECT count(*) AS vertices FROM lv4 WHERE d > 0")
def khop_any_label(g: PropertyGraph) -> DataFrame:
    return algorithms.khop_any_label(g, "person", START, 4)


@graph_query(f"{_EVERYTHING} SELECT (SELECT count(*) FROM ({_VERTICES})) AS vertices, (SELECT count(*) FROM everything) AS edges")
def graph_size(g: PropertyGraph) -> DataFrame:
    return g.size()


@graph_query(f"{_EVERYTHING} SELECT dst AS vid, src AS nbr FROM everything")
def expand_in_all_labels(g: PropertyGraph) -> DataFrame:
    """In-neighbours over the edges of every kind, from every vertex."""
    name = lambda v: F.concat_ws(":", f"{v}.label", f"{v}.id")
    every = g.all_vertices().select(F.struct("label", F.col("id").cast("long").alias("id")).alias("vid"))
    return expand.in_neighbours(every, algorithms.keyed_edges(g)).select(name("vid").alias("vid"), name("nbr").alias("nbr"))


@graph_query(f"{_EVERYTHING} SELECT src AS vid, dst AS nbr FROM everything")
def expand_out_all_labels(g: PropertyGraph) -> DataFrame:
    """Out-neighbours over the edges of every kind, from every vertex."""
    name = lambda v: F.concat_ws(":", f"{v}.label", f"{v}.id")
    every = g.all_vertices().select(F.struct("label", F.col("id").cast("long").alias("id")).alias("vid"))
    return expand.out_neighbours(every, algorithms.keyed_edges(g)).select(name("vid").alias("vid"), name("nbr").alias("nbr"))


@graph_query(f"{levels_sql(ONE, depth=2)} SELECT id AS vid, d AS depth FROM lv2 WHERE d BETWEEN 1 AND 2")
def friends_1_2(g: PropertyGraph) -> DataFrame:
    return traverse.friends(g.edge("knows"), START, 1, 2)


@graph_query(f"{levels_sql(ONE, depth=3)} SELECT count(*) AS vertices FROM lv3 WHERE d > 0")
def khops(g: PropertyGraph) -> DataFrame:
    return interactive.khops(g, START)


@graph_query(f"{levels_sql(ONE, depth=5)} SELECT count(*) AS vertices FROM lv5 WHERE d > 0")
def khop_count(g: PropertyGraph) -> DataFrame:
    return traverse.khop_count(g.edge("knows"), START, 5)


@graph_query(f"{levels_sql(ONE)} SELECT coalesce(min(d), -1) AS hops FROM lv{LEVELS} WHERE id = (SELECT max(id) FROM person)")
def ic13(g: PropertyGraph) -> DataFrame:
    return interactive.ic13(g, START, g.vertices["person"].agg(F.max("id")).first()[0])


@graph_query(
    "{} SELECT l.id AS vid, l.d AS depth, path FROM lv2 l JOIN paths p ON p.id = l.id AND p.d = l.d".format(
        levels_sql(ONE, depth=2)
        + ", p0 AS (SELECT CAST(0 AS BIGINT) AS id, 0 AS d, [CAST(0 AS BIGINT)] AS ids, '0' AS path)"
        + ", p1 AS (SELECT k.dst AS id, 1 AS d, min(list_append(ids, k.dst)) AS ids FROM p0 JOIN knows k ON k.src = p0.id GROUP BY k.dst)"
        + ", p2 AS (SELECT k.dst AS id, 2 AS d, min(list_append(ids, k.dst)) AS ids FROM p1 JOIN knows k ON k.src = p1.id GROUP BY k.dst)"
        + ", paths AS (SELECT id, d, path FROM p0 UNION ALL SELECT id, d, array_to_string(ids, '->[knows]') FROM p1 UNION ALL SELECT id, d, array_to_string(ids, '->[knows]') FROM p2)"
    )
)
def path_parents(g: PropertyGraph) -> DataFrame:
    e = g.edge("knows").withColumn("info", F.lit("knows"))
    return traverse.search_paths(traverse.one(e, START), e, 2).select("vid", "depth", traverse.format_path(F.col("path")).alias("path"))


@graph_query("SELECT 0::BIGINT AS parent, to_json(list_sort(list(dst)))::VARCHAR AS children FROM knows WHERE src = 0")
def path_children(g: PropertyGraph) -> DataFrame:
    e = g.edge("knows").withColumn("info", F.lit("knows"))
    return traverse.children(traverse.search_paths(traverse.one(e, START), e, 1)).select("parent", F.to_json("children").alias("children"))


@graph_query("SELECT DISTINCT id AS vid, CASE WHEN id = 1 THEN 0 ELSE 1 END AS depth, dir AS direction FROM (SELECT 1::BIGINT AS id, 'in' AS dir UNION ALL SELECT 1, 'out' UNION ALL SELECT src, 'in' FROM replyOf WHERE dst = 1 UNION ALL SELECT dst, 'out' FROM replyOf WHERE src = 1)")
def in_out_paths(g: PropertyGraph) -> DataFrame:
    e = g.edge("replyOf").withColumn("info", F.lit("replyOf"))
    return traverse.in_out_paths(traverse.one(e, 1), e, 1).select("vid", "depth", "direction")


@graph_query("SELECT id, id - id % 3 AS root, id % 3 AS depth FROM message")
def reply_roots(g: PropertyGraph) -> DataFrame:
    return traverse.roots(g.edge("replyOf"), g.vertices["message"])


@graph_query("SELECT id - id % 3 AS root, count(*) AS messages FROM message GROUP BY 1")
def thread_messages(g: PropertyGraph) -> DataFrame:
    return traverse.roots(g.edge("replyOf"), g.vertices["message"]).groupBy("root").agg(F.count("*").alias("messages"))


@table_query("SELECT conv_id, turn, conv_id * 100000 AS root, turn AS depth FROM conversations")
def conversation_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply chains of conversations: each turn replies to the one before."""
    c = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "conv_id", "turn")
    e = c.where("turn > 0").select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    return traverse.roots(e, c).join(c, "id").select("conv_id", "turn", "root", "depth")


def _rank_sql(rounds: int, edges: str = "knows", vertices: str = "person") -> str:
    out = [f", deg AS MATERIALIZED (SELECT src, count(*) AS n FROM {edges} GROUP BY src), nv AS (SELECT count(*) AS n FROM {vertices})", f", r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT n FROM nv) AS r FROM {vertices})"]
    for k in range(1, rounds + 1):
        p = f"r{k - 1}"
        out.append(
            f", s{k} AS MATERIALIZED (SELECT coalesce(sum(r), 0) AS s FROM {p} WHERE id NOT IN (SELECT src FROM deg)), g{k} AS MATERIALIZED (SELECT k.dst AS id, sum(r / n) AS got FROM {p} JOIN deg ON deg.src = {p}.id JOIN {edges} k ON k.src = {p}.id GROUP BY k.dst)"
            f", r{k} AS MATERIALIZED (SELECT p.id, (0.15::DOUBLE + 0.85::DOUBLE * (SELECT s FROM s{k})) / (SELECT n FROM nv) + 0.85::DOUBLE * coalesce(got, 0) AS r FROM {vertices} p LEFT JOIN g{k} ON g{k}.id = p.id)"
        )
    return "".join(out) + f" SELECT id, round(r, 9) AS rank FROM r{rounds}"


@graph_query(_rank_sql(5))
def page_rank(g: PropertyGraph) -> DataFrame:
    return algorithms.page_rank(g.vertices["person"], g.edge("knows"), 5).select("id", F.round("rank", 9).alias("rank"))


SQL["serial_page_rank"] = SQL["page_rank"]
QUERIES["serial_page_rank"] = QUERIES["page_rank"]


@graph_query(f"{_EVERYTHING}, every AS MATERIALIZED (SELECT label || ':' || id AS id FROM ({_VERTICES})){_rank_sql(5, 'everything', 'every')}".replace("SELECT id, round(r, 9) AS rank FROM r5", "SELECT split_part(id, ':', 1) AS label, CAST(split_part(id, ':', 2) AS BIGINT) AS id, round(r, 9) AS rank FROM r5"))
def page_rank_all_labels(g: PropertyGraph) -> DataFrame:
    """Ranks of every vertex of every label over all edges."""
    return algorithms.page_rank_all_labels(g, 5).select("label", "id", F.round("rank", 9).alias("rank"))



_WEIGHTS = (
    ", rep AS MATERIALIZED (SELECT least(a.creator, b.creator) AS low, greatest(a.creator, b.creator) AS high, count(*) AS n FROM replyOf r JOIN message a ON a.id = r.src JOIN message b ON b.id = r.dst WHERE a.creator <> b.creator GROUP BY ALL)"
    ", weights AS MATERIALIZED (SELECT src, dst, greatest(round(40 - sqrt(coalesce(n, 0))), 1.0)::DOUBLE AS weight FROM knows LEFT JOIN rep ON low = least(src, dst) AND high = greatest(src, dst))"
)


@graph_query(_WEIGHTS + " SELECT src, dst, weight FROM weights")
def project_weights(g: PropertyGraph) -> DataFrame:
    return intelligence.weighted_knows(g)


def _cost_sql(sources: str, rounds: int = 16) -> str:
    out = [f", c0 AS MATERIALIZED (SELECT id AS source, id AS vid, 0.0::DOUBLE AS cost FROM ({sources}))"]
    for k in range(1, rounds + 1):
        out.append(f", c{k} AS MATERIALIZED (SELECT source, vid, min(cost) AS cost FROM (SELECT * FROM c{k - 1} UNION ALL SELECT source, dst, cost + weight FROM c{k - 1} JOIN weights ON src = vid) GROUP BY source, vid)")
    return "".join(out)


@graph_query(_WEIGHTS + _cost_sql("SELECT id FROM person WHERE id < 3") + " SELECT source, vid, cost FROM c16")
def weighted_paths(g: PropertyGraph) -> DataFrame:
    return algorithms.shortest_costs(intelligence.weighted_knows(g), g.vertices["person"].where("id < 3").select(F.col("id").alias("vid")))


@graph_query(_WEIGHTS + _cost_sql("SELECT id FROM person WHERE cityId = 1") + " SELECT source AS person1, vid AS person2, cost AS weight FROM c16 WHERE vid IN (SELECT id FROM person WHERE cityId = 2)")
def bi19(g: PropertyGraph) -> DataFrame:
    return intelligence.bi19(g, 1, 2)


# Named queries.

_JOBS = "(SELECT e.src AS id, string_agg(o.name || ',' || e.{y} || ',' || c.name, ';' ORDER BY o.name || ',' || e.{y} || ',' || c.name) AS names FROM {e} e JOIN organisation o ON o.id = e.dst JOIN city c ON c.id = o.placeId GROUP BY e.src)"


@graph_query(
    f"{levels_sql(ONE, depth=3)} SELECT p.id, p.lastName, d AS distance, strftime(birthday, '%Y-%m-%d') AS birthday, gender, c.name AS cityName, coalesce(u.names, '') AS universities, coalesce(w.names, '') AS companies"
    f" FROM person p JOIN lv3 l ON l.id = p.id JOIN city c ON c.id = p.cityId LEFT JOIN {_JOBS.format(e='studyAt', y='classYear')} u ON u.id = p.id LEFT JOIN {_JOBS.format(e='workAt', y='workFrom')} w ON w.id = p.id"
    " WHERE d BETWEEN 1 AND 3 AND firstName = 'BUILDING' ORDER BY d, p.lastName, p.id LIMIT 20"
)
def ic1(g: PropertyGraph) -> DataFrame:
    return interactive.ic1(g, START, "BUILDING")


def _recent_sql(depth: int) -> str:
    return (
        f"{levels_sql(ONE, depth=depth)} SELECT p.id AS personId, firstName, lastName, m.id AS messageId, coalesce(nullif(content, ''), imageFile) AS content, epoch_ms(CAST(m.day AS TIMESTAMP)) AS creationDate"
        f" FROM message m JOIN person p ON p.id = m.creator WHERE m.creator IN (SELECT id FROM lv{depth} WHERE d > 0) AND m.day <= DATE '{MAX_DATE}' ORDER BY m.day DESC, m.id LIMIT 20"
    )


@graph_query(_recent_sql(1))
def ic2(g: PropertyGraph) -> DataFrame:
    return interactive.ic2(g, START, MAX_DATE)


@graph_query(_recent_sql(2))
def ic9(g: PropertyGraph) -> DataFrame:
    return interactive.ic9(g, START, MAX_DATE)


@graph_query(
    f"{levels_sql(ONE, depth=2)}, mem AS (SELECT src AS forum, dst AS creator FROM hasMember WHERE joinDate > DATE '1997-01-01' AND dst IN (SELECT id FROM lv2 WHERE d > 0))"
    " SELECT f.title, count(x.post) AS postCount, f.id AS forumId FROM mem JOIN forum f ON f.id = mem.forum LEFT JOIN (SELECT c.src AS forum, m.creator, m.id AS post FROM containerOf c JOIN message m ON m.id = c.dst) x"
    " ON x.forum = mem.forum AND x.creator = mem.creator GROUP BY f.title, f.id ORDER BY postCount DESC, forumId LIMIT 20"
)
def ic5(g: PropertyGraph) -> DataFrame:
    return interactive.ic5(g, START, "1997-01-01")


@graph_query(
    f"{levels_sql(ONE, depth=2)}, likes AS (SELECT DISTINCT src FROM hasTag WHERE dst IN (SELECT dst FROM hasInterest WHERE src = 0))"
    " SELECT p.id, firstName, lastName, coalesce((SELECT sum(CASE WHEN m.id IN (SELECT src FROM likes) THEN 1 ELSE -1 END) FROM message m WHERE m.kind = 'post' AND m.creator = p.id), 0)::BIGINT AS score, gender, c.name AS cityName"
    " FROM person p JOIN lv2 l ON l.id = p.id AND l.d = 2 JOIN city c ON c.id = p.cityId WHERE (month(birthday) = 7 AND day(birthday) >= 21) OR (month(birthday) = 8 AND day(birthday) < 22) ORDER BY score DESC, p.id LIMIT 10"
)
def ic10(g: PropertyGraph) -> DataFrame:
    return interactive.ic10(g, START, 7)


@graph_query(
    "SELECT abs(a - b) AS diff, name AS tagName, a AS countWindow1, b AS countWindow2 FROM (SELECT t.name, count(m.id) FILTER (m.day >= DATE '1998-01-01' AND m.day < DATE '1998-01-01' + 100) AS a,"
    " count(m.id) FILTER (m.day >= DATE '1998-01-01' + 100 AND m.day < DATE '1998-01-01' + 200) AS b FROM tag t LEFT JOIN hasTag h ON h.dst = t.id LEFT JOIN message m ON m.id = h.src WHERE t.tagclass = 'ECONOMY' GROUP BY t.name) ORDER BY diff DESC, tagName LIMIT 100"
)
def bi2(g: PropertyGraph) -> DataFrame:
    return intelligence.bi2(g, MAX_DATE, "ECONOMY")


_ASIA = "SELECT p.id FROM person p JOIN city c ON c.id = p.cityId JOIN country n ON n.id = c.countryId WHERE n.name = 'ASIA'"


@graph_query(
    "SELECT f.id AS forumId, f.title, mo.dst AS personId, count(DISTINCT m.id) AS messageCount FROM forum f JOIN hasModerator mo ON mo.src = f.id JOIN containerOf c ON c.src = f.id JOIN message m ON m.id - m.id % 3 = c.dst"
    f" WHERE mo.dst IN ({_ASIA}) AND m.id IN (SELECT h.src FROM hasTag h JOIN tag t ON t.id = h.dst WHERE t.tagclass = 'ECONOMY') GROUP BY ALL ORDER BY messageCount DESC, forumId LIMIT 20"
)
def bi3(g: PropertyGraph) -> DataFrame:
    return intelligence.bi3(g, "ECONOMY", "ASIA")


@graph_query(
    f"{levels_sql(ONE, depth=4)} SELECT m.creator AS personId, t.name AS tagName, count(*) AS messageCount FROM message m JOIN hasTag h ON h.src = m.id JOIN tag t ON t.id = h.dst"
    f" WHERE m.creator IN (SELECT id FROM lv4 WHERE d >= 3) AND m.creator IN ({_ASIA}) AND m.id IN (SELECT h2.src FROM hasTag h2 JOIN tag t2 ON t2.id = h2.dst WHERE t2.tagclass = 'ECONOMY') GROUP BY ALL ORDER BY messageCount DESC, tagName, personId LIMIT 100"
)
def bi10(g: PropertyGraph) -> DataFrame:
    return intelligence.bi10(g, START, "ASIA", "ECONOMY")


@graph_query(
    "SELECT messageCount, count(*) AS personCount FROM (SELECT m.creator, count(*) AS messageCount FROM message m JOIN message r ON r.id = m.id - m.id % 3 WHERE m.day > DATE '1999-01-01' AND m.length > 0 AND m.length < 200000"
    " AND r.language IN ('1-URGENT', '5-LOW') GROUP BY m.creator) GROUP BY messageCount ORDER BY personCount DESC, messageCount DESC"
)
def bi12(g: PropertyGraph) -> DataFrame:
    return intelligence.bi12(g, "1999-01-01", 200000, ["1-URGENT", "5-LOW"])


def _two_messages(g: PropertyGraph) -> list[tuple[int, str]]:
    """Least tag and day of the first and the last message of person 5: parameters that give rows at any scale."""
    m = g.vertices["message"].where("creator = 5")
    out = []
    for pick in (F.min("id"), F.max("id")):
        first = m.agg(pick.alias("src"))
        row = first.join(g.edge("hasTag", "message"), "src").groupBy("src").agg(F.min("dst").alias("tag")).join(m.select(F.col("id").alias("src"), F.date_format("day", "yyyy-MM-dd").alias("day")), "src").first()
        out.append((row["tag"], row["day"]) if row else (-1, "1970-01-01"))
    return out


def _posters_sql(pick: str, name: str) -> str:
    m = f"(SELECT {pick}(id) FROM message WHERE creator = 5)"
    return (
        f", {name} AS MATERIALIZED (SELECT m.creator AS id, count(DISTINCT m.id) AS n FROM message m JOIN hasTag h ON h.src = m.id WHERE h.dst = (SELECT min(dst) FROM hasTag WHERE src = {m}) AND m.day = (SELECT day FROM message WHERE id = {m}) GROUP BY m.creator)"
        f", {name}k AS MATERIALIZED (SELECT * FROM {name} x WHERE (SELECT count(*) FROM knows WHERE src = x.id AND dst IN (SELECT id FROM {name})) <= 6)"
    )


@graph_query(_posters_sql("min", "pa") + _posters_sql("max", "pb") + " SELECT a.id AS personId, a.n AS countA, b.n AS countB FROM pak a JOIN pbk b ON b.id = a.id ORDER BY a.n + b.n DESC, a.id LIMIT 20")
def bi16(g: PropertyGraph) -> DataFrame:
    (tag_a, day_a), (tag_b, day_b) = _two_messages(g)
    return intelligence.bi16(g, tag_a, day_a, tag_b, day_b)


# The same queries after a way through CSV files and the ingest.


def _through_csv(run: Callable[[PropertyGraph], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(csv_social_graph(spark, sf_dir))


for _f in (khops, ic1, ic2, ic5, ic9, ic10, ic13, bi2, bi3, bi10, bi12, bi16, bi19):
    QUERIES[f"csv_{_f.__name__}"] = _through_csv(_f)
    SQL[f"csv_{_f.__name__}"] = SQL[_f.__name__]


# Text.


@table_query("SELECT coalesce(sum((length(text) - length(replace(text, 'the', ''))) // 3), 0)::BIGINT AS occurrences FROM documents")
def text_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.count(read(spark, sf_dir, "documents"), "text", "the")


@table_query("SELECT count(*)::BIGINT AS occurrences FROM (SELECT text, unnest(generate_series(1, length(text) - 1)) AS i FROM documents) WHERE substr(text, i, 2) = '!!'")
def text_count_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.count(read(spark, sf_dir, "documents"), "text", "!!")


@table_query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS \"offset\" FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 3)) AS i FROM documents WHERE contains(text, 'tion')) WHERE substr(text, i, 4) = 'tion'")
def text_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.locate(read(spark, sf_dir, "documents"), "doc_id", "text", "tion")


@table_query("SELECT doc_id, CASE WHEN 15 <= length(text) THEN substr(text, 6, 10) END AS piece FROM documents")
def text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.extract(read(spark, sf_dir, "documents"), "doc_id", "text", 5, 10)


@table_query("SELECT doc_id FROM documents WHERE doc_id BETWEEN 100 AND 700 AND contains(text, 'Licensed')")
def rows_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.rows_containing(read(spark, sf_dir, "documents"), "doc_id", "text", "Licensed", 100, 700)


@table_query("SELECT count(*) AS rows, sum(length(text))::BIGINT AS characters, sum(strlen(text))::BIGINT AS bytes, (SELECT count(DISTINCT c) FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents)) AS alphabet FROM documents")
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.statistics(read(spark, sf_dir, "documents"), "text")
