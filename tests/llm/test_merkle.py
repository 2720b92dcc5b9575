"""The manifest against a tree built in memory; order inside groups against sorting."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import merkle
from corpusloom.llm.common import Workspace
from corpusloom.llm.ordered import ordered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx int, tree string, hash string, proof string, none int"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", "h", "p", 0) for r in rows], SCHEMA).repartition(3)


def rows_of(seed, n):
    rng = random.Random(seed)
    out = [(k, rng.choice([None, "", "a\nb", "é\n漢", "x " * 4000, "plain"]), rng.choice(["en", None]), rng.choice(["hot", "hot", "hot", "b", "", None, "Z", "ü"]), rng.choice([None, 3])) for k in range(n)]
    return [*out, out[0], out[0], (None, "no id", "en", "hot", 1), (n, "alone\n", "en", "lone", 1)]


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def grown(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, k):
    """[(siblings on the left, on the right)] from the leaf up."""
    out = []
    for level in levels[:-1]:
        first = k - k % 3
        out.append((level[first:k], level[k + 1 : first + 3]))
        k //= 3
    return out


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = grown([leaf(r, r[1]) for r in groups[s]])
    top = grown([trees[s][-1][0] for s in names])
    out = []
    for t, s in enumerate(names):
        for k, r in enumerate(groups[s]):
            steps = path(trees[s], k) + path(top, t)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            back = leaf(r, r[1].replace("\n", "") if tampered else r[1])
            for left, right in steps:
                back = sha("".join([*left, back, *right]))
            root = top[-1][0]
            out.append((r[0], leaf(r, r[1]), trees[s][-1][0], root, sha("".join("".join(a + b) for a, b in steps)), back, back == root))
    return out


@pytest.mark.parametrize("n", [0, 1, 60])
def test_manifest_against_a_tree_in_memory(spark, tmp_path, n):
    rows = rows_of(n, n) if n else [(7, "one", None, None, None)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()]
    want = expected(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert n < 60 or {r[-1] for r in got} == {True, False}


def test_nodes_and_sources(spark):
    rows = rows_of(4, 40)
    manifest = merkle.Manifest(table(spark, rows), fields=("doc_id", "source", "lang", "n_chars", "text"))
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    sources = {r.source: r for r in manifest.sources.collect()}
    assert {s: r.n_rows for s, r in sources.items()} == {s: len(g) for s, g in groups.items()}
    nodes = {(r.top, r.source, r.level, r.place): r.digest for r in manifest.nodes().collect()}
    assert sum(k[2] == 0 for k in nodes) == len(rows)
    for s, g in groups.items():
        g = sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        for level, digests in enumerate(grown([leaf(r, r[1]) for r in g])):
            assert [nodes[False, s, level, k] for k in range(len(digests))] == digests
    assert manifest.root in nodes.values()


def test_any_change_shows(spark):
    rows = rows_of(2, 30)
    kept = {"other": merkle.leaf_digest(*(F.col(c) for c in ("doc_id", "source", "lang")), F.col("n_chars") + 1, F.col("text"))}
    manifest = merkle.Manifest(table(spark, rows), keep=kept)
    got = manifest.proofs().select("n_chars" if False else "other", merkle.folded("leaf").alias("same"), merkle.folded("other").alias("changed"), F.hex("leaf").alias("leaf"), F.hex("other").alias("told")).collect()
    assert len(got) == len(rows) and all(r.same == manifest.root and (r.changed == manifest.root) == (r.leaf == r.told) for r in got)


def test_empty_table_and_other_ids(spark):
    none = merkle.Manifest(table(spark, rows_of(1, 3)).limit(0))
    assert none.root == sha("") and none.proofs().count() == 0 and none.nodes().count() == 0
    named = spark.createDataFrame([("b", "s", "x"), ("a", "s", "y")], "name string, part string, body string")
    manifest = merkle.Manifest(named, id_col="name", group_col="part", fields=("name", "body"))
    assert manifest.root == sha(sha("1:a1:y") + sha("1:b1:x"))
    assert all(r[0] == manifest.root for r in manifest.proofs().select(merkle.folded("leaf")).collect())


@pytest.mark.parametrize("weight", [None, "w"])
def test_ordered_against_sorting(spark, weight):
    rng = random.Random(7)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None, ""]), k if rng.random() < 0.9 else None, rng.randint(1, 9)) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, w long").withColumn("part", F.lit("x")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered(Workspace(spark, "ordered"), df, "g", [F.col("k").asc_nulls_first(), F.col("w")], "before", weight).select("g", "k", "w", "before").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for g in {r[0] for r in rows}:
        total = 0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            want.append((*r, total))
            total += r[2] if weight else 1
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert ordered(Workspace(spark, "ordered"), df.limit(0), "g", [F.col("k")], "before").count() == 0
