"""Person-centred queries. Each ends in a top-k on narrow rows; properties join only the rows that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.dates import epoch_ms
from graphloom.functions.scalars import concatenated
from graphloom.graph import PropertyGraph
from graphloom.operators.filters import content_or, month_band
from graphloom.operators.topk import top, top_with
from graphloom.operators.traverse import friends, khop_count, shortest_path_length


def ic1(g: PropertyGraph, person: int, first_name: str) -> DataFrame:
    """Persons of a first name at distance 1 to 3, with their universities and companies."""
    near = friends(g.edge("knows"), person, 1, 3).select(F.col("vid").alias("id"), F.col("depth").alias("distance"))
    order = [F.col("distance"), F.col("lastName"), F.col("id")]
    best = top(g.vertices["person"].where(F.col("firstName") == first_name).join(near, "id"), 20, *order)
    place = g.vertices["city"].select(F.col("id").alias("cityId"), F.col("name").alias("cityName"))

    def jobs(kind: str, extra: str, name: str) -> DataFrame:
        org = g.vertices["organisation"].join(place, F.col("placeId") == F.col("cityId")).select(F.col("id").alias("dst"), "name", "cityName")
        rows = g.edge(kind).join(best.select(F.col("id").alias("src")), "src", "left_semi").join(org, "dst")
        return rows.groupBy(F.col("src").alias("id")).agg(concatenated(F.concat_ws(",", "name", F.col(extra).cast("string"), "cityName")).alias(name))

    out = best.join(place, "cityId").join(jobs("studyAt", "classYear", "universities"), "id", "left").join(jobs("workAt", "workFrom", "companies"), "id", "left")
    return out.orderBy(*order).select("id", "lastName", "distance", F.date_format("birthday", "yyyy-MM-dd").alias("birthday"), "gender", "cityName", F.coalesce("universities", F.lit("")).alias("universities"), F.coalesce("companies", F.lit("")).alias("companies"))


def _recent(g: PropertyGraph, near: DataFrame, max_date: str) -> DataFrame:
    """The 20 latest messages of persons ``near`` (vid), up to a day."""
    by = g.vertices["message"].where(F.col("day") <= F.to_date(F.lit(max_date))).select("id", "creator", "day").join(near.select(F.col("vid").alias("creator")), "creator", "left_semi")
    order = [F.col("day").desc(), F.col("messageId")]
    best = top(by.select(F.col("id").alias("messageId"), "creator", "day"), 20, *order)
    # Names and contents of 20 rows only: the other sides are scanned with a broadcast of those rows.
    said = g.vertices["message"].select(F.col("id").alias("messageId"), content_or(F.col("content"), F.col("imageFile")).alias("content"))
    who = g.vertices["person"].select(F.col("id").alias("creator"), "firstName", "lastName")
    return best.join(said, "messageId").join(who, "creator").orderBy(*order).select(F.col("creator").alias("personId"), "firstName", "lastName", "messageId", "content", epoch_ms(F.col("day")).alias("creationDate"))


def ic2(g: PropertyGraph, person: int, max_date: str) -> DataFrame:
    """Latest messages of friends."""
    return _recent(g, friends(g.edge("knows"), person, 1, 1), max_date)


def ic9(g: PropertyGraph, person: int, max_date: str) -> DataFrame:
    """Latest messages of friends and their friends."""
    return _recent(g, friends(g.edge("knows"), person, 1, 2), max_date)


def ic5(g: PropertyGraph, person: int, min_date: str) -> DataFrame:
    """Forums that friends within two hops joined after a day, by the posts of those members in them."""
    near = friends(g.edge("knows"), person, 1, 2).select(F.col("vid").alias("dst"))
    members = g.edge("hasMember").where(F.col("joinDate") > F.to_date(F.lit(min_date))).join(near, "dst", "left_semi").select(F.col("src").alias("forum"), F.col("dst").alias("creator"))
    posts = g.edge("containerOf").join(g.vertices["message"].where("kind = 'post'").select(F.col("id").alias("dst"), "creator"), "dst").select(F.col("src").alias("forum"), "creator", F.col("dst").alias("post"))
    n = members.join(posts, ["forum", "creator"], "left").groupBy("forum").agg(F.count("post").alias("postCount"))
    order = [F.col("postCount").desc(), F.col("forumId")]
    return top_with(n.withColumnRenamed("forum", "forumId"), 20, order, g.vertices["forum"].select(F.col("id").alias("forumId"), "title"), "forumId").select("title", "postCount", "forumId")


def ic10(g: PropertyGraph, person: int, month: int) -> DataFrame:
    """Friends of friends with a birthday in a month's band, by posts on the person's interests less other posts."""
    far = friends(g.edge("knows"), person, 2, 2).select(F.col("vid").alias("id"))
    who = g.vertices["person"].where(month_band(F.col("birthday"), month)).join(far, "id", "left_semi")
    tags = g.edge("hasInterest").where(F.col("src") == person).select("dst")
    liked = g.edge("hasTag", "message").join(tags, "dst", "left_semi").select(F.col("src").alias("post")).distinct().withColumn("liked", F.lit(1))
    posts = g.vertices["message"].where("kind = 'post'").select(F.col("id").alias("post"), F.col("creator").alias("id"))
    score = who.select("id").join(posts, "id").join(liked, "post", "left").groupBy("id").agg(F.sum(F.when(F.col("liked") == 1, 1).otherwise(-1)).alias("n"))
    order = [F.col("score").desc(), F.col("id")]
    best = top(who.join(score, "id", "left").withColumn("score", F.coalesce("n", F.lit(0))), 10, *order)
    return best.join(g.vertices["city"].select(F.col("id").alias("cityId"), F.col("name").alias("cityName")), "cityId").orderBy(*order).select("id", "firstName", "lastName", "score", "gender", "cityName")


def ic13(g: PropertyGraph, a: int, b: int) -> DataFrame:
    """Hops between two persons."""
    return shortest_path_length(g.edge("knows"), a, b)


def khops(g: PropertyGraph, person: int, k: int = 3) -> DataFrame:
    """Number of persons within ``k`` hops."""
    return khop_count(g.edge("knows"), person, k)
