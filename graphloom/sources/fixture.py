"""The social graph that the star-schema tables project to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import EdgeKind, PropertyGraph, symmetrized


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def social_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Persons, places, tags, messages, forums and organisations with their edges."""
    t = {n: read(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    c = F.col("c_custkey")
    person = t["customer"].select(
        c.alias("id"), F.col("c_mktsegment").alias("firstName"), F.col("c_name").alias("lastName"),
        F.date_add(F.lit("1980-01-01").cast("date"), (c * 37 % 365).cast("int")).alias("birthday"),
        F.when(c % 2 == 0, "female").otherwise("male").alias("gender"),
        F.col("c_nationkey").cast("long").alias("cityId"),
    )
    city = t["nation"].select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("countryId"))
    country = t["region"].select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    label = F.concat_ws("/", "p_brand", "p_type")
    tag = t["part"].groupBy(label.alias("name"), F.col("p_type").alias("tagclass")).agg(F.min("p_partkey").alias("id")).select("id", "name", "tagclass")
    tagclass = t["part"].groupBy(F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("id")).select("id", "name")
    o = F.col("o_orderkey")
    message = t["orders"].select(
        o.alias("id"), F.col("o_custkey").alias("creator"), F.to_date("o_orderdate").alias("day"), F.floor("o_totalprice").cast("long").alias("length"),
        F.col("o_orderpriority").alias("language"), F.when(o % 3 == 0, "post").otherwise("comment").alias("kind"),
        F.when(o % 3 == 0, "").otherwise(F.concat(F.lit("about "), F.col("o_orderpriority"))).alias("content"), F.concat(F.lit("photo"), o.cast("string"), F.lit(".jpg")).alias("imageFile"),
    )
    forum = t["supplier"].select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    s = F.col("s_suppkey")
    organisation = t["supplier"].select(s.alias("id"), F.when(s % 2 == 0, "university").otherwise("company").alias("type"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("placeId"))

    tagged = t["part"].select("p_partkey", label.alias("name")).join(tag.select("name", F.col("id").alias("tagId")), "name").select("p_partkey", "tagId")
    lines = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    has_tag = lines.join(tagged, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("src"), F.col("tagId").alias("dst")).distinct()
    orders = t["orders"].select("o_orderkey", "o_custkey")
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    member = bought.groupBy(F.col("l_suppkey").alias("src"), F.col("o_custkey").alias("dst")).agg(F.min(F.to_date("l_shipdate")).alias("joinDate"))
    interest = bought.where("l_quantity >= 40").join(tagged, F.col("l_partkey") == F.col("p_partkey")).select(F.col("o_custkey").alias("src"), F.col("tagId").alias("dst")).distinct()
    posts = message.where("kind = 'post'")
    contains = lines.where("l_orderkey % 3 = 0").groupBy(F.col("l_orderkey").alias("dst")).agg(F.min("l_suppkey").alias("src")).join(posts.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    persons = t["customer"].agg(F.count("*").alias("n"))
    moderator = t["supplier"].join(F.broadcast(persons)).select(s.alias("src"), (s * 37 % F.col("n")).alias("dst"))  # one row with the count
    then = orders.select((o - 1).alias("k"), F.col("o_custkey").alias("b"))
    pair = orders.where(o % 5 == 0).join(then, o == F.col("k")).where("o_custkey != b")
    knows = symmetrized(pair.select(F.least("o_custkey", "b").alias("src"), F.greatest("o_custkey", "b").alias("dst")).distinct())
    organisations = t["supplier"].agg(F.count("*").alias("n"))
    studies = t["customer"].where(c % 3 == 0).join(F.broadcast(organisations)).select(c.alias("src"), (c * 2 % F.col("n")).alias("dst"), (1990 + c % 20).cast("int").alias("classYear"))
    works = t["customer"].where(c % 2 == 1).join(F.broadcast(organisations)).select(c.alias("src"), ((c * 2 + 1) % F.col("n")).alias("dst"), (2000 + c % 15).cast("int").alias("workFrom"))
    comments = message.where("kind = 'comment'")
    edge = lambda df, a, b: df.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    return PropertyGraph(
        {"person": person, "city": city, "country": country, "tag": tag, "tagclass": tagclass, "message": message, "forum": forum, "organisation": organisation},
        {
            EdgeKind("person", "knows", "person"): knows,
            EdgeKind("person", "isLocatedIn", "city"): edge(person, "id", "cityId"),
            EdgeKind("city", "isPartOf", "country"): edge(city, "id", "countryId"),
            EdgeKind("message", "hasCreator", "person"): edge(message, "id", "creator"),
            EdgeKind("message", "replyOf", "message"): comments.select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst")),
            EdgeKind("message", "hasTag", "tag"): has_tag,
            EdgeKind("tag", "hasType", "tagclass"): tag.select(F.col("id").alias("src"), "tagclass").join(tagclass.select(F.col("name").alias("tagclass"), F.col("id").alias("dst")), "tagclass").select("src", "dst"),
            EdgeKind("forum", "containerOf", "message"): contains,
            EdgeKind("forum", "hasMember", "person"): member,
            EdgeKind("forum", "hasModerator", "person"): moderator,
            EdgeKind("person", "hasInterest", "tag"): interest,
            EdgeKind("person", "studyAt", "organisation"): studies,
            EdgeKind("person", "workAt", "organisation"): works,
        },
    )


#: The same projection as common table expressions, for the SQL that checks the queries.
SQL = """
person AS (SELECT c_custkey AS id, c_mktsegment AS firstName, c_name AS lastName,
  CAST(DATE '1980-01-01' + CAST(c_custkey * 37 % 365 AS INTEGER) AS DATE) AS birthday,
  CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender, CAST(c_nationkey AS BIGINT) AS cityId FROM customer),
city AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS countryId FROM nation),
country AS (SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region),
tag AS (SELECT min(p_partkey) AS id, p_brand || '/' || p_type AS name, p_type AS tagclass FROM part GROUP BY p_brand, p_type),
tagclass AS (SELECT min(p_partkey) AS id, p_type AS name FROM part GROUP BY p_type),
message AS (SELECT o_orderkey AS id, o_custkey AS creator, CAST(o_orderdate AS DATE) AS day, CAST(floor(o_totalprice) AS BIGINT) AS length,
  o_orderpriority AS language, CASE WHEN o_orderkey % 3 = 0 THEN 'post' ELSE 'comment' END AS kind,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'about ' || o_orderpriority END AS content, 'photo' || o_orderkey || '.jpg' AS imageFile FROM orders),
forum AS (SELECT s_suppkey AS id, s_name AS title FROM supplier),
organisation AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'university' ELSE 'company' END AS type, s_name AS name, CAST(s_nationkey AS BIGINT) AS placeId FROM supplier),
hasTag AS (SELECT DISTINCT l_orderkey AS src, t.id AS dst FROM lineitem JOIN part ON l_partkey = p_partkey JOIN tag t ON t.name = p_brand || '/' || p_type),
hasMember AS (SELECT l_suppkey AS src, o_custkey AS dst, min(CAST(l_shipdate AS DATE)) AS joinDate FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
hasInterest AS (SELECT DISTINCT o_custkey AS src, t.id AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN tag t ON t.name = p_brand || '/' || p_type WHERE l_quantity >= 40),
containerOf AS (SELECT min(l_suppkey) AS src, l_orderkey AS dst FROM lineitem WHERE l_orderkey % 3 = 0 AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey),
hasModerator AS (SELECT s_suppkey AS src, s_suppkey * 37 % (SELECT count(*) FROM customer) AS dst FROM supplier),
pair AS (SELECT DISTINCT least(a.o_custkey, b.o_custkey) AS src, greatest(a.o_custkey, b.o_custkey) AS dst FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1
  WHERE a.o_orderkey % 5 = 0 AND a.o_custkey <> b.o_custkey),
knows AS MATERIALIZED (SELECT src, dst FROM pair UNION ALL SELECT dst, src FROM pair),
studyAt AS (SELECT c_custkey AS src, c_custkey * 2 % (SELECT count(*) FROM supplier) AS dst, CAST(1990 + c_custkey % 20 AS INTEGER) AS classYear FROM customer WHERE c_custkey % 3 = 0),
workAt AS (SELECT c_custkey AS src, (c_custkey * 2 + 1) % (SELECT count(*) FROM supplier) AS dst, CAST(2000 + c_custkey % 15 AS INTEGER) AS workFrom FROM customer WHERE c_custkey % 2 = 1),
replyOf AS (SELECT id AS src, id - 1 AS dst FROM message WHERE kind = 'comment')
"""
