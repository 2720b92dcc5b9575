"""Nearest rows by packed blocks against sorting all products; copies, near copies and odd lengths."""

from unittest import mock

import numpy as np
import pytest

from corpusloom.operators import evaluate, nearest


def plain(x, y, k, same):
    sims = x @ y.T
    if same:
        np.fill_diagonal(sims, -np.inf)
    top = np.argsort(-np.round(sims, 12), axis=1, kind="stable")[:, :k]
    return {(r, c) for r in range(len(x)) for c in top[r] if np.isfinite(sims[r, c])}


@pytest.mark.parametrize("kind", ["random", "copies", "near", "long", "huge", "zero"])
def test_greatest_against_sorting(kind):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(150, 16)), rng.normal(size=(230, 16))
    if kind == "copies":
        y[50:200] = x[0]
    if kind == "near":
        y[50:200] = x[0] + rng.normal(size=(150, 16)) * 1e-8
    if kind in ("long", "huge"):
        y *= rng.lognormal(0, 4, (230, 1)) * (1e25 if kind == "huge" else 1)
        x = np.round(x, 1)
    if kind == "zero":
        x[:20], y[:60] = 0, 0
    with mock.patch.multiple(nearest, ROWS=64, COLUMNS=90, FIRST=20, MOST=8):
        for a, b, same in ((x, y, False), (y, y, True), (x[:3], y[:2], False), (y[:1], y[:1], True)):
            row, col, sim = nearest.greatest(a, b, 3, same)
            assert set(zip(row.tolist(), col.tolist())) == plain(a, b, 3, same)
            assert np.allclose(sim, np.einsum("ij,ij->i", a[row], b[col]))


def test_neighbours_of_copies(spark):
    """Copies are one vector in the search: of 3,000 rows of two vectors only two meet."""
    rows = spark.range(3000).selectExpr("id AS vec_id", "id % 7 AS label", "IF(id % 3 = 0, array(1D, 0D), array(0.6D, 0.8D)) AS vec")
    got = {}
    for r in evaluate.neighbours(rows, 3).collect():
        got.setdefault(r.vec_id, []).append((r["rank"], r.near, r.label, r.near_label))
    assert len(got) == 3000
    for i, found in got.items():
        want = [j for j in range(16) if (j % 3 == 0) == (i % 3 == 0) and j != i][:3]
        assert sorted(found) == [(p + 1, j, i % 7, j % 7) for p, j in enumerate(want)]


def test_neighbours_against_sorting(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(90, 3)), 1)
    x[10:40] = x[0]
    keys = [int(k) for k in rng.permutation(90)]
    rows = spark.createDataFrame([(k, 0, [float(v) for v in x[k]]) for k in keys], "vec_id long, label int, vec array<double>")
    with mock.patch.multiple(nearest, SPREAD_ROWS=20):
        got = {(r.vec_id, r["rank"], r.near) for r in evaluate.neighbours(rows, 4).collect()}
    sims = np.round(x @ x.T, 12)
    np.fill_diagonal(sims, -np.inf)
    top = np.argsort(-sims, axis=1, kind="stable")[:, :4]
    assert got == {(k, p + 1, int(top[k, p])) for k in range(90) for p in range(4)}
