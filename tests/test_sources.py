"""Sources and sinks on files that the tests write."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.placement import Rules
from corpusloom.sources import feeds, pages, sinks
from corpusloom.streaming import incremental

PAGE = '---\ntitle: "A cím"\ndate: 2012-03-04T00:00:00Z\nregi_cimkek:\n  - "egy, kettő"\n  - három\nslug: x\n---\nA **szöveg** [itt](http://a.b).\n'


def test_pages(spark, tmp_path):
    (tmp_path / "a.md").write_text(PAGE, encoding="utf-8")
    (tmp_path / "b.md").write_text("no front matter", encoding="utf-8")
    (tmp_path / "_index.md").write_text(PAGE, encoding="utf-8")
    got = pages.parse_pages(pages.raw_files(spark, str(tmp_path / "*.md")), "archive").collect()
    assert [(r.title, r.text, r.year, r.fittable) for r in got] == [("A cím", "A szöveg itt.", 2012, False)]
    front = spark.createDataFrame([(got[0].front,)], "front string")
    assert front.select(pages.list_items(F.col("front"), "regi_cimkek").alias("x")).first().x == ["egy, kettő", "három"]
    assert front.select(pages.list_items(F.col("front"), "tags").alias("x")).first().x == []


def test_front_matter_round_trip(spark):
    def put(text, key, values):
        rows = spark.createDataFrame([(text, values)], "t string, v array<string>")
        return rows.select(sinks.with_list_key(F.col("t"), key, F.col("v")).alias("x")).first().x

    values = ["a \"b\"", "c: d"]
    once = put(PAGE, "temak", values)
    assert once.endswith(PAGE[PAGE.index("\n---\n", 3) :]) and put(once, "temak", values) == once
    assert '  - "a \\"b\\""\n  - "c: d"\n---\n' in once
    assert put(once, "temak", []) == PAGE and put(once, "temak", None) == PAGE
    assert "három" not in put(PAGE, "regi_cimkek", [])
    assert put("---\n---\nbody\n---\n", "temak", ["x"]) == '---\ntemak:\n  - "x"\n---\nbody\n---\n'
    assert put(None, "temak", ["x"]) is None
    with pytest.raises(Exception, match="no front matter"):
        put("body", "temak", [])


def test_feeds(spark, tmp_path):
    entry = "<entry><id>{}</id><title>t</title><author><name>{}</name></author><type>{}</type><status>{}</status><content>c</content></entry>"
    (tmp_path / "atom.xml").write_text("<feed>" + entry.format(1, "me", "POST", "LIVE") + entry.format(2, "me", "PAGE", "LIVE") + entry.format(3, "me", "POST", "DRAFT") + entry.format(4, "you", "POST", "LIVE") + "</feed>")
    kept, skipped = feeds.atom_entries(spark, str(tmp_path / "atom.xml"), "me")
    assert [r.id for r in kept.collect()] == ["1"] and {r.reason: r.n for r in skipped.collect()} == {"not a post": 1, "not live": 1, "other author": 1}
    (tmp_path / "wxr.xml").write_text("<channel><item><title>a</title><post_type>post</post_type><status>publish</status><post_date_gmt>2010-01-02 03:04:05</post_date_gmt></item><item><title>b</title><post_type>page</post_type><status>publish</status></item></channel>")
    assert [r.published for r in feeds.wxr_items(spark, str(tmp_path / "wxr.xml")).collect()] == ["2010-01-02T03:04:05Z"]


def test_analyser(spark):
    tsv = "form\tanas\tlemma\txpostag\nParlamentben\t[]\tparlament\t[/N][Ine]\n\nshort\nfelszólalt\t[]\tfelszólal\t[/V]\n"
    got = feeds.analyser_tokens(spark.createDataFrame([(1, tsv)], "doc_id int, tsv string")).orderBy("pos").collect()
    assert [(r.form, r.lemma) for r in got] == [("Parlamentben", "parlament"), ("felszólalt", "felszólal")]
    with pytest.raises(Exception, match="no column"):
        feeds.analyser_tokens(spark.createDataFrame([(1, "a\tb\n1\t2")], "doc_id int, tsv string")).collect()


def test_registry_and_artefacts(spark, tmp_path):
    old, new = spark.createDataFrame([("a",), ("b",)], "slug string"), spark.createDataFrame([("b",), ("c",)], "slug string")
    sinks.write_registry(old, new, str(tmp_path / "r"))
    assert sorted(r.slug for r in pages.registry(spark, str(tmp_path / "r")).collect()) == ["a", "b", "c"]
    assert feeds.artefact(spark, str(tmp_path / "none"), "a int", strict=False).count() == 0
    sinks.write_artefact(spark.range(3), str(tmp_path / "art"), {"seed": "42"})
    assert spark.read.json(str(tmp_path / "art" / "rows")).count() == 3


def test_themes_and_calibration(spark, tmp_path):
    assert feeds.themes(spark, [{"kulcs": "a", "nev": "A"}]).first().allapot == "aktiv"
    with pytest.raises(ValueError):
        feeds.themes(spark, [{"kulcs": "a", "nev": "A", "allapot": "x"}])
    (tmp_path / "t.yaml").write_text("x")
    (tmp_path / "c.json").write_text(json.dumps({"themes_sha256": hashlib.sha256(b"x").hexdigest(), "tau": 1}))
    assert feeds.calibration(str(tmp_path / "c.json"), str(tmp_path / "t.yaml"))["tau"] == 1
    (tmp_path / "t.yaml").write_text("y")
    with pytest.raises(feeds.StaleCalibrationError):
        feeds.calibration(str(tmp_path / "c.json"), str(tmp_path / "t.yaml"))


def test_stream_equals_batch(spark, data, tmp_path):
    themes = spark.createDataFrame([(0, 5, [1.0, 0.0]), (1, 5, [0.0, 1.0])], "theme int, k int, vec array<double>").cache()
    rows = spark.createDataFrame([(k, "long", [k / 10, 1 - k / 10]) for k in range(11)], "vec_id int, kind string, vec array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    rules = Rules(tau={"long": 0.5}, delta=0.1)
    want = {r.vec_id: r.themes for r in incremental.place_stream(rows, themes, rules).collect()}
    stream = incremental.place_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), themes, rules)
    run = stream.writeStream.format("memory").queryName("placed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination()
    assert {r.vec_id: r.themes for r in spark.table("placed").collect()} == want
