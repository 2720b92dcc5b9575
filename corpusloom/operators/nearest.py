"""The nearest rows of each row, exactly: packed blocks of vectors meet in pairs, one task a pair.

A block is one row of Spark, so a vector is moved as often as there are blocks, not once a pair of rows. Products are
taken in single precision first; what could be among the k greatest by its error bound is multiplied again in double.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed

#: Rows of a block: a task holds two blocks. Small tables are dealt into SPREAD blocks, so that all cores have work.
BLOCK_ROWS, SPREAD, SPREAD_ROWS = 32_768, 12, 1_000
#: Rows and columns that are multiplied at once.
ROWS, COLUMNS, FIRST = 512, 2_048, 2_048
#: So many candidates a row are worth picking out; beyond, the whole piece is sorted in double precision.
MOST = 128


def greatest(x: np.ndarray, y: np.ndarray, k: int, same: bool | np.ndarray = False, single: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, product) of the k greatest products of each row of x with rows of y, to 12 decimals, the lesser column first of equals.

    same: x is y, and a row is not its own column; or the column that each row is, -1 where it is none. single: y in single
    precision and the greatest length of its rows, where these are finite and it is known.
    """
    none = np.zeros(0, np.int64)
    if not len(x) or not len(y):
        return none, none, np.zeros(0)
    with np.errstate(over="ignore"):
        x32, y32 = x.astype(np.float32), y.astype(np.float32) if single is None else single[0]
    mine = same if isinstance(same, np.ndarray) else np.arange(len(x)) if same else np.full(len(x), -1)
    long = np.sqrt((y * y).sum(axis=1)).max() if single is None else single[1]
    error = 2 * (x.shape[1] + 4) * 2.0**-24 * np.sqrt((x * x).sum(axis=1)) * long + 2e-12
    plain = not (np.isfinite(x).all() and (single is not None or np.isfinite(y).all())) or error.max() > 1e20 or long > 1e18
    out, room = [], np.empty(min(ROWS, len(x)) * min(COLUMNS, len(y)), np.float32)
    for r in range(0, len(x), ROWS):
        own = slice(r, min(r + ROWS, len(x)))
        n = own.stop - r
        best, least = (none, none, np.zeros(0)), np.full(n, -np.inf)
        for c in range(0, len(y), COLUMNS):
            other = slice(c, min(c + COLUMNS, len(y)))
            both = np.flatnonzero((mine[own] >= c) & (mine[own] < other.stop))
            itself = mine[own][both] - c
            row = None
            if not plain:
                sims = np.matmul(x32[own], y32[other].T, out=room[: n * (other.stop - c)].reshape(n, -1))
                sims[both, itself] = -np.inf
                some = slice(None)
                if k == 1:  # only rows whose greatest of this piece can be their greatest of all
                    top = sims.max(axis=1)
                    some = np.flatnonzero(top >= (least - error[own]).astype(np.float32))
                    least = np.maximum(least, top)
                elif c == 0 and other.stop > k:
                    w = min(FIRST, other.stop)
                    least = np.partition(sims[:, :w], w - k, axis=1)[:, w - k].astype(float) if w >= k else least
                row, col = np.divmod(np.flatnonzero(sims[some] >= (least - error[own]).astype(np.float32)[some, None]), sims.shape[1])
                row = some[row] if k == 1 else row
                row = None if len(row) > MOST * n else row
            if row is None:
                sims = x[own] @ y[other].T
                sims[both, itself] = -np.inf
                col = np.argsort(-np.round(sims, 12), axis=1, kind="stable")[:, :k]
                row, col = np.repeat(np.arange(n), col.shape[1]), col.ravel()
                value = sims[row, col]
            else:
                value = np.einsum("ij,ij->i", x[own][row], y[other][col])
                value[sims[row, col] == -np.inf] = -np.inf
            row, col, value = (np.concatenate(p) for p in zip(best, (row, col + c, value), strict=True))
            row, col, value = (a[np.isfinite(value)] for a in (row, col, value))
            order = np.lexsort((col, -np.round(value, 12), row))
            row, col, value = row[order], col[order], value[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            best = tuple(a[place < k] for a in (row, col, value))
            last = place == k - 1
            least = np.full(n, -np.inf)
            least[row[last]] = value[last]
        out.append((best[0] + r, best[1], best[2]))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("key")
    x = np.stack(pdf["vec"].to_numpy()).astype(float)
    with np.errstate(over="ignore"):
        half = x.astype(np.float32)
    raw = half if (half == x).all() else x  # single precision where nothing is lost by it
    return pd.DataFrame({"by": [pdf["by"].iloc[0]], "own": [pdf["own"].iloc[0]], "parts": [pdf["parts"].iloc[0]], "keys": [pdf["key"].to_numpy()], "single": [raw is half], "mat": [raw.tobytes()]})


def _matrix(single: bool, mat: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(mat, np.float32 if single else float).reshape(rows, -1).astype(float)


def nearest(rows: DataFrame, k: int) -> DataFrame:
    """rows(by, key, vec), keys unique in each value of `by` -> by, key, near, sim: what holds the k nearest of each row among those of its value, itself left out; up to k of every block."""
    largest = rows.groupBy("by").count().agg(F.max("count")).first()[0] or 1
    parts = max(-(-largest // BLOCK_ROWS), min(SPREAD, -(-largest // SPREAD_ROWS)))
    kind, by = rows.schema["key"].dataType.simpleString(), rows.schema["by"].dataType.simpleString()
    dealt = rows.select("by", "key", "vec", F.pmod(F.hash("key"), F.lit(parts)).alias("own"), F.lit(parts).alias("parts"))
    blocks = checkpointed(dealt.groupBy("by", "own").applyInPandas(_packed, f"by {by}, own int, parts int, keys array<{kind}>, single boolean, mat binary"))
    left = blocks.select("by", F.col("own").alias("i"), F.explode(F.expr("sequence(own, parts - 1)")).alias("j"), "keys", "single", "mat")
    # other names on the right, as both sides come from one frame
    right = blocks.select(F.col("by").alias("by2"), F.explode(F.expr("sequence(0, own)")).alias("i2"), F.col("own").alias("j2"), F.col("keys").alias("keys2"), F.col("single").alias("single2"), F.col("mat").alias("mat2"))

    def pairs(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"by": [], "key": [], "near": [], "sim": []})
        keys, keys2 = np.asarray(a["keys"].iloc[0]), np.asarray(b["keys2"].iloc[0])
        x, y = _matrix(a["single"].iloc[0], a["mat"].iloc[0], len(keys)), _matrix(b["single2"].iloc[0], b["mat2"].iloc[0], len(keys2))
        same = a["i"].iloc[0] == a["j"].iloc[0]
        row, col, sim = greatest(x, y, k, same)
        out = [pd.DataFrame({"key": keys[row], "near": keys2[col], "sim": sim})]
        if not same:
            row, col, sim = greatest(y, x, k)
            out.append(pd.DataFrame({"key": keys2[row], "near": keys[col], "sim": sim}))
        return pd.concat(out).assign(by=a["by"].iloc[0])[["by", "key", "near", "sim"]]

    return left.groupBy("by", "i", "j").cogroup(right.groupBy("by2", "i2", "j2")).applyInPandas(pairs, f"by {by}, key {kind}, near {kind}, sim double")


def nearest_of(wanted: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """wanted and rows(by, key, vec), keys unique in each value of `by` -> by, key, near, sim: what holds the k nearest among `rows` of each row wanted, the row of its own key left out; up to k of every block.

    As `nearest`, for a part of the rows: blocks of those wanted meet all blocks.
    """
    largest = rows.groupBy("by").count().agg(F.max("count")).first()[0] or 1
    most = wanted.groupBy("by").count().agg(F.max("count")).first()[0] or 1
    parts, sides = max(-(-largest // BLOCK_ROWS), min(SPREAD, -(-largest // SPREAD_ROWS))), -(-most // BLOCK_ROWS)
    kind, by = rows.schema["key"].dataType.simpleString(), rows.schema["by"].dataType.simpleString()

    def packed(rows: DataFrame, n: int) -> DataFrame:
        dealt = rows.select("by", "key", "vec", F.pmod(F.hash("key"), F.lit(n)).alias("own"), F.lit(n).alias("parts"))
        return dealt.groupBy("by", "own").applyInPandas(_packed, f"by {by}, own int, parts int, keys array<{kind}>, single boolean, mat binary")

    left = packed(wanted, sides).select("by", F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("j"), "keys", "single", "mat")
    right = packed(rows, parts).select(F.col("by").alias("by2"), F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("i2"), F.col("own").alias("j2"), F.col("keys").alias("keys2"), F.col("single").alias("single2"), F.col("mat").alias("mat2"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"by": [], "key": [], "near": [], "sim": []})
        keys, keys2 = np.asarray(a["keys"].iloc[0]), np.asarray(b["keys2"].iloc[0])
        x, y = _matrix(a["single"].iloc[0], a["mat"].iloc[0], len(keys)), _matrix(b["single2"].iloc[0], b["mat2"].iloc[0], len(keys2))
        row, col, sim = greatest(x, y, k, pd.Index(keys2).get_indexer(keys))
        return pd.DataFrame({"by": [a["by"].iloc[0]] * len(row), "key": keys[row], "near": keys2[col], "sim": sim})

    return left.groupBy("by", "i", "j").cogroup(right.groupBy("by2", "i2", "j2")).applyInPandas(meet, f"by {by}, key {kind}, near {kind}, sim double")
