"""Average linkage that searches only what a join has changed, against joining the nearest two over and over."""

from unittest import mock

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import discover, evaluate, nearest


def points(rows, dims, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(12, dims))[rng.integers(0, 12, rows)] + rng.normal(0, 0.3, (rows, dims))
    return np.concatenate([x, x[: rows // 5], x[:5], np.zeros((2, dims))])


@pytest.mark.parametrize("cut, cells", [(0.2, 0), (1.2, 0), (1.2, 40 * 6)])
def test_rounds_search_what_has_changed(spark, cut, cells):
    """Rounds of the cluster, in blocks of 16 rows: all rows are searched once, then only those that a join has changed."""
    x, asked = points(100, 6), []
    v = spark.createDataFrame([(1, k, [float(a) for a in row]) for k, row in enumerate(x)], "label int, vec_id long, vec array<double>")

    def counted(search):
        return lambda rows, *more: asked.append((search.__name__, rows.count(), more[0].count() if len(more) > 1 else None)) or search(rows, *more)

    parts = mock.patch.multiple(nearest, BLOCK_ROWS=16, nearest=counted(nearest.nearest), nearest_of=counted(nearest.nearest_of))
    found = {}
    with parts, mock.patch.multiple(discover, TASK_CELLS=cells), mock.patch.multiple(evaluate, BLOCK_ROWS=10):
        for r in discover.groups(v, cut).collect():
            found.setdefault(r.grp, []).append(r.vec_id)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    assert [sorted(found[g]) for g in sorted(found)] == discover.average_linkage(unit, cut)
    assert [a[0] for a in asked] == ["nearest"] + ["nearest_of"] * (len(asked) - 1) and len(asked) > 2
    assert sum(a[1] < a[2] for a in asked[1:]) > 0


def test_one_task_searches_what_has_changed():
    x = np.random.default_rng(1).normal(size=(2000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7, 3] = np.nan
    products, search = [], nearest.greatest

    def counted(a, b, *more):
        products.append(len(a) * len(b))
        return search(a, b, *more)

    key = np.arange(2000) + (1 << 60)  # keys that doubles cannot tell apart
    with mock.patch.object(nearest, "greatest", counted):
        joins = discover._rounds(0.9)(pd.DataFrame({"by": 1, "key": key, "vec": list(x), "n": 1, "near": key}))
    first = {k: k for k in key}
    for a, b in sorted(zip(joins["key"], joins["near"]), key=lambda p: -p[1]):
        first[b] = a
    groups = {}
    for k in key:
        top = k
        while first[top] != top:
            top = first[top]
        groups.setdefault(top, []).append(int(k - key[0]))
    own = [k for k in range(2000) if k != 7]
    want = [[own[i] for i in g] for g in discover.average_linkage(x[own], 0.9)]
    assert sorted((g for g in groups.values() if len(g) >= 3), key=lambda g: (-len(g), g[0])) == want
    assert len(products) > 15 and 2000**2 <= sum(products) < 4 * 2000**2


def test_nearest_of_some(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(90, 3)), 1)
    x[10:40] = x[0]
    rows = spark.createDataFrame([(0, k, [float(a) for a in v]) for k, v in enumerate(x)], "by int, key long, vec array<double>")
    sims = np.round(x @ x.T, 12)
    np.fill_diagonal(sims, -np.inf)
    with mock.patch.multiple(nearest, BLOCK_ROWS=20):
        got = nearest.nearest_of(rows.where("key % 2 = 0"), rows, 1).groupBy("key").agg(F.min(F.struct(-F.round("sim", 12), "near"))["near"].alias("near")).collect()
    assert {r.key: r.near for r in got} == {k: int(np.argmax(sims[k])) for k in range(0, 90, 2)}


def test_proposals_move_texts_of_groups_only(spark):
    """No table of all writings' words is kept; parts of two texts and keys joined by a shuffle give the same rows."""
    rng = np.random.default_rng(2)
    x = [np.eye(6)[k % 2] + rng.normal(0, 0.05, 6) if k < 12 else rng.normal(size=6) for k in range(20)]
    candidates = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)], "doc_id long, vec array<double>")
    texts = [(k, " ".join(f"w{w}" + "." * int(w % 9 == 0) for w in rng.integers(0, 40, 60)) + f" own{k % 2} own{k % 2}") for k in range(300)]
    writings = spark.createDataFrame([*texts, (300, None), (3, "w1 again again.")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, f"l{k % 3}") for k in range(300)], "doc_id long, label string")
    themes = spark.createDataFrame([(t, [float(a) for a in v]) for t, v in enumerate(np.eye(3, 6))], "theme long, vec array<double>")
    kept, keep = [], discover.checkpointed

    def counted(df):
        out = keep(df)
        kept.append(out.count())
        return out

    with mock.patch.multiple(discover, checkpointed=counted):
        one = sorted(map(str, discover.proposals(candidates, writings, labels, themes, 0.3).collect()))
    with mock.patch.multiple(discover, GROUP_TEXTS=2, MOST_KEYS=0):
        assert sorted(map(str, discover.proposals(candidates, writings, labels, themes, 0.3).collect())) == one
    assert sum("part='term'" in r for r in one) >= 2 and max(kept) < 100


@pytest.mark.parametrize("kind", ["random", "copies", "near", "zero"])
def test_the_greatest_product(kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(230, 16))
    if kind == "copies":
        x[50:200] = x[0]
    if kind == "near":
        x[50:200] = x[0] + rng.normal(size=(150, 16)) * 1e-8
    if kind == "zero":
        x[:60] = 0
    sims = np.round(x @ x.T, 12)
    np.fill_diagonal(sims, -np.inf)
    some, long = np.arange(0, 230, 3), np.sqrt((x * x).sum(axis=1)).max()
    with mock.patch.multiple(nearest, ROWS=64, COLUMNS=90, MOST=8):
        for got in (nearest.greatest(x[some], x, 1, some), nearest.greatest(x[some], x, 1, some, (x.astype(np.float32), long))):
            assert got[0].tolist() == list(range(len(some))) and got[1].tolist() == sims[some].argmax(axis=1).tolist()
