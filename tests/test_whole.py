"""Queries that take whole texts and all rows, on small tables that show what a prefix or a filter would lose."""

import datetime

import numpy as np
import pytest

from corpusloom.operators import discover
from corpusloom.plans import catalog

LONG = "word " * 80
TEXTS = [
    (1, LONG + "see [this](http://x.y) and **that** here ```code``` end"),
    (2, LONG + "open ``` fence"),
    (3, LONG + "odd ** mark"),
    (4, ". " * 80 + "Late title"),
    (5, "a ab abcd abcde abcdef abcdefghijkl abcdeg zebra"),
]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, '<a href="/Zebra">x</a><a href="/ab">y</a>')], "page_id long, html string").write.parquet(f"{at}/pages.parquet")
    day = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(day, "click", 1.0), (day, "error", 50.0), (day + datetime.timedelta(3), "view", 2.0)], "ts timestamp, event_type string, value double").write.parquet(f"{at}/events.parquet")
    spark.createDataFrame([(day.date() - datetime.timedelta(9499), "F", 10.0)], "o_orderdate date, o_orderstatus string, o_totalprice double").write.parquet(f"{at}/orders.parquet")
    x = np.eye(8)[np.arange(5200) % 8] + np.random.default_rng(1).normal(0, 0.02, (5200, 8))
    rows = [(k, 0, v) for k, v in enumerate(x.tolist())] + [(9000 + k, 1, v) for k, v in enumerate(x[:40].tolist())]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{at}/embeddings.parquet")
    return at


def rows(spark, sf, name):
    return [tuple(r) for r in catalog.QUERIES[name](spark, sf).collect()]


def test_markup(spark, sf):
    plain = dict(rows(spark, sf, "f01_strip_markup"))
    assert "see this and that here end" in plain[1] and plain[1].count("word") == 80
    odd = {r[0]: r[1:] for r in rows(spark, sf, "f07_markdown_qa")}
    assert odd[1] == (False, False) and odd[2][0] and odd[3][1]


def test_slugs(spark, sf):
    assert dict(rows(spark, sf, "f08_import_slug"))[4] == "late-title"
    assert dict(rows(spark, sf, "f10_term_directory"))[4] == "-".join(["."] * 80) + "-late-title"


def test_prefix(spark, sf):
    got = sorted(r for r in rows(spark, sf, "f24_prefix") if r[0] == 2)
    assert got == [(2, 0, "passage: " + LONG.strip()), (2, 1, "passage: open ``` fence")]


def test_lemmas(spark, sf):
    terms = {t.lower().strip(".") for _, x in TEXTS for t in x.replace("`", " ").replace("*", " ").replace("[", " ").replace("](http://x.y)", " http x y ").split()} - {""}
    match = {t: sorted(m for m in terms if t.startswith(m[:5])) for t in terms}
    assert sorted(rows(spark, sf, "f26_matches_lemma")) == sorted((t, len(m), m[0], m[-1]) for t, m in match.items())
    assert "a" in match["abcdef"] and "abcdeg" in match["abcdefghijkl"] and "abcdef" in match["abcde"]


@pytest.mark.parametrize("cut", [0.2, 1.2])
def test_linkage_in_rounds(spark, cut, monkeypatch):
    """Joined in rounds, against joining the nearest two over and over; small blocks, copies, vectors of length zero."""
    monkeypatch.setattr("corpusloom.operators.evaluate.BLOCK_ROWS", 40)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 6))[rng.integers(0, 12, 100)] + rng.normal(0, 0.3, (100, 6))
    x = np.concatenate([x, x[:20], x[:5], np.zeros((2, 6))])
    v = spark.createDataFrame([(1, k, [float(a) for a in row]) for k, row in enumerate(x)], "label int, vec_id long, vec array<double>")
    found = {}
    for r in discover.groups(v, cut).collect():
        found.setdefault(r.grp, []).append(r.vec_id)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    assert [sorted(found[g]) for g in sorted(found)] == discover.average_linkage(x, cut)


def test_large_groups(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("embedding", "vec")
    got = {(r.label, r.grp): r["count"] for r in discover.groups(v, 0.2).groupBy("label", "grp").count().collect()}
    assert got == {(0, g): 650 for g in range(8)} | {(1, g): 5 for g in range(8)}
    assert sorted(r[0] for r in rows(spark, sf, "agg22_seed_count_curve")) == [3, 4, 5, 6, 8]


def test_unreferenced(spark, sf):
    got = {r[0] for r in rows(spark, sf, "j16_unreferenced")}
    assert {"/a", "/abcd", "/abcdefghijkl", "/word"} <= got and not got & {"/ab", "/zebra"}


def test_spine(spark, sf):
    d = datetime.date(2024, 1, 1)
    assert [(r[0], r[1], float(r[2])) for r in sorted(rows(spark, sf, "agg10_day_spine"))] == [(d, 2, 100.0), (d.replace(day=2), 1, 50.0), (d.replace(day=3), 0, 0.0), (d.replace(day=4), 1, 50.0)]


def test_evidence_by_lemma(spark, data):
    """Sentence scores against a count word by word: a term counts once, by the beginning of any word."""
    import re

    from corpusloom.functions import text as tx
    from corpusloom.plans import text_queries

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {(r.doc_id, r.pos): r.score for r in text_queries._scored_sentences(spark, data).collect()}
    want = {}
    for i, text in docs.items():
        sentences = [s for s in re.split(r"(?<=[.!?…])\s+", (text or "").strip(" ")) if s]
        for k, s in enumerate(sentences):
            words = re.findall(r"\w+", s.lower())
            want[i, k] = sum(any(w.startswith(t) for w in words) for t in text_queries._EVIDENCE)
    assert set(got) == set(want)
    assert sum(got.values()) > 0 and sum(abs(got[k] - want[k]) for k in want) == 0, tx.TOKEN
