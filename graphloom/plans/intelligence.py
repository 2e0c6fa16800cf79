"""Queries over the whole graph: aggregations, joins and top-k in one pass each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators.algorithms import interaction_weights, shortest_costs
from graphloom.operators.filters import day_window, within
from graphloom.operators.topk import top
from graphloom.operators.traverse import friends, roots


def _class_tags(g: PropertyGraph, tagclass: str) -> DataFrame:
    """Tags of a class: id, name."""
    of = g.edge("hasType").join(g.vertices["tagclass"].where(F.col("name") == tagclass).select(F.col("id").alias("dst")), "dst", "left_semi")
    return g.vertices["tag"].join(of.select(F.col("src").alias("id")), "id", "left_semi").select("id", "name")


def _country_persons(g: PropertyGraph, country: str) -> DataFrame:
    """Persons in a country's cities: id."""
    cities = g.edge("isPartOf").join(g.vertices["country"].where(F.col("name") == country).select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("dst"))
    return g.edge("isLocatedIn", "person").join(cities, "dst", "left_semi").select(F.col("src").alias("id"))


def bi2(g: PropertyGraph, date: str, tagclass: str, days: int = 100) -> DataFrame:
    """Tags of a class by how their messages in two adjacent windows differ; tags without messages count 0."""
    day = F.col("day")
    first, second = day_window(day, date, days), day_window(day, date, days, days)
    tags = _class_tags(g, tagclass)
    said = g.edge("hasTag", "message").select(F.col("dst").alias("id"), F.col("src").alias("m")).join(g.vertices["message"].where(first | second).select(F.col("id").alias("m"), "day"), "m")
    n = said.groupBy("id").agg(F.count_if(first).alias("a"), F.count_if(second).alias("b"))
    both = tags.join(n, "id", "left").select(F.col("name").alias("tagName"), F.coalesce("a", F.lit(0)).alias("countWindow1"), F.coalesce("b", F.lit(0)).alias("countWindow2"))
    return top(both.withColumn("diff", F.abs(F.col("countWindow1") - F.col("countWindow2"))), 100, F.col("diff").desc(), "tagName")


def bi3(g: PropertyGraph, tagclass: str, country: str) -> DataFrame:
    """Forums with a moderator in a country, by the messages of their post trees on a class of tags."""
    tagged = g.edge("hasTag", "message").join(_class_tags(g, tagclass).select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    root = roots(g.edge("replyOf"), g.vertices["message"])
    forums = g.edge("hasModerator").join(_country_persons(g, country).select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("forumId"), F.col("dst").alias("personId"))
    threads = g.edge("containerOf").select(F.col("src").alias("forumId"), F.col("dst").alias("root")).join(forums, "forumId")
    n = root.join(tagged, "id", "left_semi").join(threads, "root").groupBy("forumId", "personId").agg(F.countDistinct("id").alias("messageCount"))
    order = [F.col("messageCount").desc(), F.col("forumId")]
    return top(n, 20, *order).join(g.vertices["forum"].select(F.col("id").alias("forumId"), "title"), "forumId").orderBy(*order).select("forumId", "title", "personId", "messageCount")


def bi10(g: PropertyGraph, person: int, country: str, tagclass: str, least: int = 3, most: int = 4) -> DataFrame:
    """Experts in a country at distance 3 to 4, by every tag of their messages that touch a class of tags."""
    experts = friends(g.edge("knows"), person, least, most).select(F.col("vid").alias("id")).join(_country_persons(g, country), "id", "left_semi")
    touching = g.edge("hasTag", "message").join(_class_tags(g, tagclass).select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("m")).distinct()
    said = g.vertices["message"].select(F.col("id").alias("m"), F.col("creator").alias("id")).join(experts, "id", "left_semi").join(touching, "m", "left_semi")
    n = said.join(g.edge("hasTag", "message").select(F.col("src").alias("m"), F.col("dst").alias("tag")), "m").groupBy(F.col("id").alias("personId"), "tag").agg(F.count("*").alias("messageCount"))
    named = n.join(g.vertices["tag"].select(F.col("id").alias("tag"), F.col("name").alias("tagName")), "tag")
    return top(named.select("personId", "tagName", "messageCount"), 100, F.col("messageCount").desc(), "tagName", "personId")


def bi12(g: PropertyGraph, date: str, threshold: int, languages: list[str]) -> DataFrame:
    """How many persons have each number of matching messages; the language is that of the thread's post."""
    root = roots(g.edge("replyOf"), g.vertices["message"]).select("id", "root")
    spoken = g.vertices["message"].where((F.col("kind") == "post") & F.col("language").isin(languages)).select(F.col("id").alias("root"))
    said = g.vertices["message"].where((F.col("day") > F.to_date(F.lit(date))) & within(F.col("length"), 0, threshold)).select("id", "creator")
    per = said.join(root, "id").join(spoken, "root", "left_semi").groupBy("creator").agg(F.count("*").alias("messageCount"))
    return per.groupBy("messageCount").agg(F.count("*").alias("personCount")).orderBy(F.col("personCount").desc(), F.col("messageCount").desc())


def bi16(g: PropertyGraph, tag_a: int, day_a: str, tag_b: int, day_b: str, max_knows: int = 6) -> DataFrame:
    """Persons with messages on tag A on day A and on tag B on day B; those with many friends in either set go."""

    def posters(tag: int, day: str, name: str) -> DataFrame:
        m = g.vertices["message"].where(F.col("day") == F.to_date(F.lit(day))).select(F.col("id").alias("src"), "creator")
        n = g.edge("hasTag", "message").where(F.col("dst") == tag).join(m, "src").groupBy(F.col("creator").alias("id")).agg(F.countDistinct("src").alias(name))
        friends_in = g.edge("knows").join(n.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"))
        return n.join(friends_in, "id", "left").where(F.coalesce("k", F.lit(0)) <= max_knows).select("id", name)

    both = posters(tag_a, day_a, "countA").join(posters(tag_b, day_b, "countB"), "id")
    return top(both.select(F.col("id").alias("personId"), "countA", "countB"), 20, (F.col("countA") + F.col("countB")).desc(), "personId")


def replies_between(g: PropertyGraph) -> DataFrame:
    """(a, b) for each reply of person a to a message of person b."""
    who = g.vertices["message"].select("id", "creator")
    return g.edge("replyOf").join(who.select(F.col("id").alias("src"), F.col("creator").alias("a")), "src").join(who.select(F.col("id").alias("dst"), F.col("creator").alias("b")), "dst").select("a", "b")


def weighted_knows(g: PropertyGraph) -> DataFrame:
    """The projected graph: every knows edge with the weight of its interactions."""
    return interaction_weights(g.edge("knows"), replies_between(g))


def saved_weights(g: PropertyGraph, path: str) -> DataFrame:
    """The projected graph from ``path``, projected and written there the first time."""
    spark = g.edge("knows").sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        weighted_knows(g).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def bi19(g: PropertyGraph, city1: int, city2: int, weights: DataFrame | None = None) -> DataFrame:
    """Cheapest path weights between the persons of two cities; pairs without a path are left out.

    ``weights``: the projected graph, if it is at hand (``saved_weights``).
    """
    at = g.edge("isLocatedIn", "person")
    one, two = (at.where(F.col("dst") == c).select(F.col("src").alias("vid")) for c in (city1, city2))
    swap = one.count() > two.count()  # fewer sources, fewer rows in the loop; knows goes both ways
    found = shortest_costs(weighted_knows(g) if weights is None else weights, *((two, one) if swap else (one, two)))
    a, b = ("vid", "source") if swap else ("source", "vid")
    return found.select(F.col(a).alias("person1"), F.col(b).alias("person2"), F.col("cost").alias("weight")).orderBy("weight", "person1", "person2")
