"""From a social network as it was ingested (posts, comments, places) to the graph that the named queries ask for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import EdgeKind, PropertyGraph


def utc_day(at: Column) -> Column:
    """The day of an instant in UTC, whatever the session's zone."""
    return F.to_date(F.to_utc_timestamp(at, F.current_timezone()))


def _put(df: DataFrame, *columns: tuple[str, str, str]) -> list[Column]:
    """Columns (of the file, of the query, type); null where the file has none."""
    return [(F.col(old) if old in df.columns else F.lit(None)).cast(kind).alias(new) for old, new, kind in columns]


def as_queried(g: PropertyGraph) -> PropertyGraph:
    """Messages are posts and comments in one table, cities and countries are places by type.

    Posts and comments draw their ids from one range, as the public generator does it: in the
    message table an id is one message. A vertex without a creator, place or
    country stays, with null there; edges and labels beyond those the queries use are passed on.
    """
    e, v = dict(g.edges), dict(g.vertices)

    def take(type: str, *ends: tuple[str, str]) -> DataFrame | None:  # noqa: A002
        """The union of the edges of a type between these labels; they leave ``e``."""
        found = [e.pop(k) for a, b in ends for k in g.kinds(a, type, b)]
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), found) if found else None

    def one(edges: DataFrame | None, name: str, df: DataFrame) -> DataFrame:
        """``df`` with the single out-neighbour of each vertex as a column."""
        if edges is None:
            return df.withColumn(name, F.lit(None).cast("long"))
        return df.join(edges.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias(name)), "id", "left")

    out_v: dict[str, DataFrame] = {}
    out_e: dict[EdgeKind, DataFrame] = {}

    def put(kind: tuple[str, str, str], edges: DataFrame | None) -> None:
        if edges is not None:
            out_e[EdgeKind(*kind)] = edges

    places = v.pop("place")
    part_of = take("isPartOf", ("place", "place"))
    of = lambda kind: places.where(F.lower("type") == kind).select("id", "name")
    out_v["city"], out_v["country"] = one(part_of, "countryId", of("city")), of("country")
    if part_of is not None:
        put(("city", "isPartOf", "country"), part_of.join(out_v["city"].select(F.col("id").alias("src")), "src", "left_semi").join(out_v["country"].select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))

    home = take("isLocatedIn", ("person", "place"))
    person = v.pop("person")
    names = _put(person, ("id", "id", "long"), ("firstname", "firstName", "string"), ("lastname", "lastName", "string"), ("birthday", "birthday", "date"), ("gender", "gender", "string"))
    out_v["person"] = one(home, "cityId", person.select(*names))
    put(("person", "isLocatedIn", "city"), home)

    created = take("hasCreator", ("post", "person"), ("comment", "person"))
    said = []
    for kind in ("post", "comment"):
        if kind in v:
            m = v.pop(kind)
            more = _put(m, ("id", "id", "long"), ("length", "length", "long"), ("language", "language", "string"), ("content", "content", "string"), ("imagefile", "imageFile", "string"))
            said.append(m.select(*more, utc_day(F.col("creationdate")).alias("day"), F.lit(kind).alias("kind")))
    out_v["message"] = one(created, "creator", reduce(DataFrame.unionByName, said))
    put(("message", "hasCreator", "person"), created)
    put(("message", "replyOf", "message"), take("replyOf", ("comment", "post"), ("comment", "comment")))
    put(("message", "hasTag", "tag"), take("hasTag", ("post", "tag"), ("comment", "tag")))
    put(("message", "isLocatedIn", "country"), take("isLocatedIn", ("post", "place"), ("comment", "place")))
    put(("person", "likes", "message"), take("likes", ("person", "post"), ("person", "comment")))
    put(("forum", "containerOf", "message"), take("containerOf", ("forum", "post")))

    seat = take("isLocatedIn", ("organisation", "place"))
    if "organisation" in v:
        out_v["organisation"] = one(seat, "placeId", v.pop("organisation"))
    put(("organisation", "isLocatedIn", "place"), seat)
    members = take("hasMember", ("forum", "person"))
    if members is not None:
        put(("forum", "hasMember", "person"), members.withColumn("joinDate", utc_day(F.col("joindate"))).select("src", "dst", "joinDate") if "joindate" in members.columns else members)
    for type_, a, b, old, new in (("studyAt", "person", "organisation", "classyear", "classYear"), ("workAt", "person", "organisation", "workfrom", "workFrom")):
        found = take(type_, (a, b))
        put((a, type_, b), None if found is None else found.withColumnRenamed(old, new))
    for kind in (("person", "knows", "person"), ("forum", "hasModerator", "person"), ("forum", "hasTag", "tag"), ("person", "hasInterest", "tag"), ("tag", "hasType", "tagclass"), ("tagclass", "isSubclassOf", "tagclass")):
        put(kind, take(kind[1], (kind[0], kind[2])))
    return PropertyGraph(v | out_v | {"place": places}, e | out_e)
