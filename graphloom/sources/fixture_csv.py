"""The star-schema tables' social graph as a directory of CSV files in the public network layout, read back by the ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.sources.csv_graph import social_csv
from graphloom.sources.fixture import social_graph
from graphloom.sources.social import as_queried
from graphloom.storage import delete_on_exit, shared_dir

#: Countries and cities share the place table: a country's id is its own plus this.
COUNTRY = 1_000_000
_READ: dict[tuple[str, str], PropertyGraph] = {}


def write_social_csv(g: PropertyGraph, directory: str) -> None:
    """Files with a header, ``|`` between columns and no quotation, as the public generator writes them, compressed."""
    stamp = lambda day: F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00.000+0000"))
    nowhere, nothing = [F.lit("1.2.3.4").alias("locationIP"), F.lit("Firefox").alias("browserUsed")], F.lit("").alias("url")

    def put(name: str, df: DataFrame, header: str, *columns: Column | str) -> None:
        # Two columns may have one name: the line is one column, and its name the header.
        cells = df.select(F.concat_ws("|", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns)).alias(header))
        cells.write.options(header=True, sep="\x01", quote="", emptyValue="", compression="gzip").csv(f"{directory}/{name}_0_0.csv")

    v, e = g.vertices, g.edge
    put("person", v["person"], "id|firstName|lastName|gender|birthday|creationDate|locationIP|browserUsed", "id", "firstName", "lastName", "gender", "birthday", stamp(F.lit("2010-01-01").cast("date")), *nowhere)
    put("place", v["city"], "id|name|url|type", "id", "name", nothing, F.lit("city"))
    put("place_more", v["country"], "id|name|url|type", F.col("id") + COUNTRY, "name", nothing, F.lit("country"))
    put("organisation", v["organisation"], "id|type|name|url", "id", "type", "name", nothing)
    put("tag", v["tag"], "id|name|url", "id", "name", nothing)
    put("tagclass", v["tagclass"], "id|name|url", "id", "name", nothing)
    put("forum", v["forum"], "id|title|creationDate", "id", "title", stamp(F.lit("2010-01-01").cast("date")))
    m = v["message"]
    put("post", m.where("kind = 'post'"), "id|imageFile|creationDate|locationIP|browserUsed|language|content|length", "id", "imageFile", stamp(F.col("day")), *nowhere, "language", "content", "length")
    put("comment", m.where("kind = 'comment'"), "id|creationDate|locationIP|browserUsed|content|length", "id", stamp(F.col("day")), *nowhere, "content", "length")

    two = lambda a, b: f"{a}.id|{b}.id"
    is_post = lambda c: F.col(c) % 3 == 0
    put("person_knows_person", e("knows").where("src < dst"), two("Person", "Person") + "|creationDate", "src", "dst", stamp(F.lit("2011-01-01").cast("date")))
    put("person_isLocatedIn_place", e("isLocatedIn", "person"), two("Person", "Place"), "src", "dst")
    put("place_isPartOf_place", e("isPartOf"), two("Place", "Place"), "src", F.col("dst") + COUNTRY)
    put("organisation_isLocatedIn_place", v["organisation"], two("Organisation", "Place"), "id", "placeId")
    put("tag_hasType_tagclass", e("hasType"), two("Tag", "TagClass"), "src", "dst")
    for kind, keep in (("Post", is_post("src")), ("Comment", ~is_post("src"))):
        put(f"{kind.lower()}_hasCreator_person", e("hasCreator").where(keep), two(kind, "Person"), "src", "dst")
        put(f"{kind.lower()}_hasTag_tag", e("hasTag", "message").where(keep), two(kind, "Tag"), "src", "dst")
    put("comment_replyOf_post", e("replyOf").where(is_post("dst")), two("Comment", "Post"), "src", "dst")
    put("comment_replyOf_comment", e("replyOf").where(~is_post("dst")), two("Comment", "Comment"), "src", "dst")
    put("forum_containerOf_post", e("containerOf"), two("Forum", "Post"), "src", "dst")
    put("forum_hasMember_person", e("hasMember"), two("Forum", "Person") + "|joinDate", "src", "dst", stamp(F.col("joinDate")))
    put("forum_hasModerator_person", e("hasModerator"), two("Forum", "Person"), "src", "dst")
    put("person_hasInterest_tag", e("hasInterest"), two("Person", "Tag"), "src", "dst")
    put("person_studyAt_organisation", e("studyAt"), two("Person", "Organisation") + "|classYear", "src", "dst", "classYear")
    put("person_workAt_organisation", e("workAt"), two("Person", "Organisation") + "|workFrom", "src", "dst", "workFrom")


def csv_social_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph of the star tables after a way through CSV files, which are written once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _READ:
        directory = f"{shared_dir(spark)}/graphloom/social-csv-{uuid.uuid4().hex}"
        write_social_csv(social_graph(spark, sf_dir), directory)
        delete_on_exit(spark, directory)
        _READ[key] = as_queried(social_csv(spark, directory))
    return _READ[key]
