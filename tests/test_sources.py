import datetime

import pytest
from pyspark.sql import functions as F

from graphloom.functions import dates, scalars
from graphloom.plans import runner
from graphloom.sources import csv_graph, graph_store, params
from graphloom.sources.social import as_queried

FILES = {
    "person_0_0.csv": "id|firstName|lastName|gender|birthday|creationDate|locationIP|browserUsed\n1|A|B|male|1980-01-02|2010-01-01T10:00:00.000+0000|1.2.3.4|F\n2||C|female|1981-02-03|2011-01-01T10:00:00.000+0000|1.2.3.5|G\n",
    "person_email_emailaddress_0_0.csv": "Person.id|email\n1|z@x\n1|a@x\n",
    "person_speaks_language_0_0.csv": "Person.id|language\n2|de\n",
    "person_knows_person_0_0.csv": "Person.id|Person.id|creationDate\n1|2|2012-01-01T00:00:00.000+0000\n",
    "organisation_0_0.csv": "id|type|name|url\n5|university|U|http://u\n",
    "person_studyAt_organisation_0_0.csv": "Person.id|Organisation.id|classYear\n1|5|1999\n",
    "updateStream_0_0_forum.csv": "what|ever\n",
}


def write(folder, files):
    for name, body in files.items():
        p = folder / ("deep" if name.startswith("organ") else ".") / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(body)


def test_social_csv(spark, tmp_path):
    write(tmp_path, FILES)
    g = csv_graph.social_csv(spark, str(tmp_path))
    assert set(g.vertices) == {"person", "organisation"}
    got = {r.id: r for r in g.vertices["person"].collect()}
    assert got[1].email == ["a@x", "z@x"] and got[2].email == [] and got[2].language == ["de"]
    assert got[2].firstname == "" and got[1].birthday == datetime.date(1980, 1, 2)
    assert sorted((r.src, r.dst) for r in g.edge("knows").collect()) == [(1, 2), (2, 1)]  # both ways, once
    assert [tuple(r) for r in g.edge("studyat").collect()] == [(1, 5, 1999)]
    store = str(tmp_path / "store")
    graph_store.save(g, store)
    again = graph_store.load(spark, store, by="dst")
    assert sorted(map(tuple, again.edge("knows").collect())) == sorted(map(tuple, g.edge("knows").collect()))
    assert again.label_counts().count() == 2
    graph_store.register(again)
    assert spark.sql("SELECT count(*) FROM edge_knows").first()[0] == 2


def test_bad_csv(spark, tmp_path):
    with pytest.raises(ValueError):
        csv_graph.classify("x", ["foo", "bar"])
    write(tmp_path, {"thing_0.csv": "id|colour\n1|red\n"})
    with pytest.raises(ValueError):
        csv_graph.social_csv(spark, str(tmp_path))
    big = spark.createDataFrame([("18446744073709551615",)], "c string")
    with pytest.raises(Exception, match="id out of range"):
        big.select(csv_graph.typed("c", "id")).collect()


def test_leaks_csv(spark, tmp_path):
    write(tmp_path, {"nodes-entity.csv": "node_id,name,countries\n1,Acme,PA\n2,,\n", "nodes-officer.csv": "node_id,name\n9,Jo\n", "edges-officer-director-entity.csv": "node_id_start,node_id_end,link,start_date\n9,1,director of,\n"})
    g = csv_graph.leaks_csv(spark, str(tmp_path))
    assert [tuple(r) for r in g.edge("director").collect()] == [(9, 1, "director of", "")]
    assert {r.id: r.name for r in g.vertices["entity"].collect()} == {1: "Acme", 2: ""}


def test_params():
    assert params.parse_case("ic2", "7|1262304000000") == {"person": 7, "max_date": "2010-01-01"}
    assert params.parse_case("bi10", "7|United States|Music", "|") == {"person": 7, "country": "United States", "tagclass": "Music"}
    assert params.parse_case("ic13", "1 2") == {"a": 1, "b": 2}
    assert params.cases("bi12", ["date|lengthThreshold|languages", "2010-01-01|20|ar;hu", ""]) == [{"date": "2010-01-01", "threshold": 20, "languages": ["ar", "hu"]}]
    assert len(params.cases("khops", ["1", "2", "3"], 2)) == 2
    assert params.cases("ic13", ["1 2", "3 4"]) == [{"a": 1, "b": 2}, {"a": 3, "b": 4}]  # no header, so none is guessed
    assert params.cases("bi3", ["c|k", "Music|United States"], header=True, sep="|") == [{"tagclass": "Music", "country": "United States"}]
    for query, lines in (("khops", ["1", "x"]), ("ic13", ["1 x", "1 2"]), ("bi3", ["Music United States"]), ("ic13", ["1 2 3"])):
        with pytest.raises(ValueError):
            params.cases(query, lines)


def test_runner(spark, tmp_path):
    write(tmp_path, FILES)
    g = csv_graph.social_csv(spark, str(tmp_path))
    results, timing = runner.run(g, "ic13", ["1 2", "1 1"])
    assert [r.first()[0] for r in results] == [1, 0] and timing["cases"] == 2
    runner.show(results[0], str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), sep="|").first()[0] == "1"
    runner.show(results[0].limit(0), str(tmp_path / "none"))
    assert spark.read.text(str(tmp_path / "none")).first()[0] == "EMPTY TABLE"
    runner.show(results[0], str(tmp_path / "out"), header=True)
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "hops"
    for _ in range(2):
        runner.append_timing(spark, str(tmp_path / "times"), "ic13", timing)
    assert spark.read.text(str(tmp_path / "times")).where("value like 'ic13 cases=2%'").count() == 2
    graph_store.save(g, str(tmp_path / "saved"))
    again, seconds = runner.startup(spark, str(tmp_path / "saved"))
    assert set(again.vertices) == set(g.vertices) and seconds > 0 and tuple(again.size().first()) == (3, 3)
    texts = spark.createDataFrame([(1, "abab"), (2, "ba")], "id long, t string")
    assert runner.text_command(texts, "id", "t", "count ab").first()[0] == 2
    assert sorted(tuple(r) for r in runner.text_command(texts, "id", "t", "locate ba").collect()) == [(1, 1), (2, 0)]
    assert runner.text_command(texts, "id", "t", "extract 1 1").where("id = 2").first()[1] == "a"
    with pytest.raises(ValueError):
        runner.text_command(texts, "id", "t", "build")


ODD = {
    "person_0_0.csv": 'id|firstName|lastName|gender|birthday|creationDate|locationIP|browserUsed\n1|"A|B|male|1980-01-02|2010-01-01T10:00:00.000+0000|1.2.3.4|F\n',
    "post_0_0.csv": 'id|imageFile|creationDate|locationIP|browserUsed|language|content|length\n7||2010-01-01T23:59:59.000+0000|1.1.1.1|F|de|"open quote|5\n8|p.jpg|2010-01-02T00:00:00.000+0000|1.1.1.1|F|de||0\n',
    "comment_0_0.csv": "id|creationDate|locationIP|browserUsed|content|length\n9|2010-02-01T00:00:00.000+0000|1.1.1.1|F|yes|3\n",
    "place_0_0.csv": "id|name|url|type\n3|Bern|u|city\n4|Switzerland|u|country\n5|Europe|u|continent\n",
    "place_isPartOf_place_0_0.csv": "Place.id|Place.id\n3|4\n4|5\n",
    "person_isLocatedIn_place_0_0.csv": "Person.id|Place.id\n1|3\n",
    "post_hasCreator_person_0_0.csv": "Post.id|Person.id\n7|1\n8|1\n",
    "comment_hasCreator_person_0_0.csv": "Comment.id|Person.id\n9|1\n",
    "comment_replyOf_post_0_0.csv": "Comment.id|Post.id\n9|7\n",
    "post_isLocatedIn_place_0_0.csv": "Post.id|Place.id\n7|4\n",
    "person_likes_post_0_0.csv": "Person.id|Post.id|creationDate\n1|8|2010-01-02T00:00:00.000+0000\n",
}


def test_as_queried(spark, tmp_path):
    """Posts and comments become messages, places cities and countries; a quotation mark is a character."""
    write(tmp_path, ODD)
    g = as_queried(csv_graph.social_csv(spark, str(tmp_path)))
    said = {r.id: r for r in g.vertices["message"].collect()}
    assert {i: (r.kind, r.creator, str(r.day), r.length, r.content, r.imageFile) for i, r in said.items()} == {7: ("post", 1, "2010-01-01", 5, '"open quote', ""), 8: ("post", 1, "2010-01-02", 0, "", "p.jpg"), 9: ("comment", 1, "2010-02-01", 3, "yes", None)}
    assert g.vertices["person"].first().firstName == '"A' and g.vertices["person"].first().cityId == 3
    assert [tuple(r) for r in g.vertices["city"].collect()] == [(3, "Bern", 4)] and [tuple(r) for r in g.edge("isPartOf").collect()] == [(3, 4)]
    assert [tuple(r)[:2] for r in g.edge("replyOf").collect()] == [(9, 7)] and g.edge("HASCREATOR").count() == 3
    assert g.edge("likes", "person", "message").count() == 1 and g.edge("isLocatedIn", "person").count() == 1
    with pytest.raises(LookupError):
        g.edge("isLocatedIn")  # persons and messages have one each


def test_ids_and_parts(spark, tmp_path):
    write(tmp_path, {"tag_0_0.csv": "id|name|url\n1|a|u\n|b|u\n"})
    with pytest.raises(Exception, match="id out of range"):
        csv_graph.social_csv(spark, str(tmp_path)).vertices["tag"].collect()
    (tmp_path / "tag_0_0.csv").unlink()
    spark.range(7).selectExpr("id", "'n' as name", "'u' as url").repartition(3).write.options(header=True, sep="|").csv(str(tmp_path / "tag_0_0.csv"))
    assert csv_graph.social_csv(spark, str(tmp_path)).vertices["tag"].count() == 7  # the parts of one table, each with its header
    for folder, row in (("a", "1,Acme,7"), ("b", "2,Beta,x")):
        (tmp_path / "leaks" / folder).mkdir(parents=True)
        (tmp_path / "leaks" / folder / "nodes-entity.csv").write_text(f'node_id,name,internal_id\n{row}\n3,"quoted, name",\n')
    got = csv_graph.leaks_csv(spark, str(tmp_path / "leaks")).vertices["entity"].collect()
    assert sorted(map(tuple, got), key=str) == [(1, "Acme", 7), (2, "Beta", None), (3, "quoted, name", None), (3, "quoted, name", None)]


def test_functions(spark):
    t = spark.createDataFrame([(1262304000123 + 3661000, "a|b|", "type|x|y", "2010-01-01T23:00:00")], "ms long, row string, info string, d string")
    got = t.select(dates.iso_ms(F.col("ms")), scalars.column_of(F.col("row"), 1), scalars.column_of(F.col("row"), 2), scalars.column_of(F.col("row"), 5), scalars.edge_type_of(F.col("info")), scalars.edge_rest_of(F.col("info")), dates.day_of(F.col("d")), dates.epoch_ms(dates.day_of_ms(F.col("ms"))), scalars.bit_length(F.lit(8))).first()
    assert tuple(got) == ("2010-01-01T01:01:01.000+0000", "b", "", None, "type", "x|y", datetime.date(2010, 1, 1), 1262304000000, 4)


def test_compressed_csv(spark, tmp_path):
    """A file may be compressed, alone or as a part; the fixture's files are."""
    import gzip

    with gzip.open(tmp_path / "tag_0_0.csv.gz", "wt") as f:
        f.write("id|name|url\n5|five|\n")
    (tmp_path / "tag_1_0.csv").write_text("id|name|url\n6|six|\n")
    spark.createDataFrame([("7|seven|",)], "`id|name|url` string").write.options(header=True, sep="\x01", quote="", compression="gzip").csv(str(tmp_path / "tag_2_0.csv"))
    tags = csv_graph.social_csv(spark, str(tmp_path)).vertices["tag"]
    assert sorted((r.id, r.name) for r in tags.collect()) == [(5, "five"), (6, "six"), (7, "seven")]
