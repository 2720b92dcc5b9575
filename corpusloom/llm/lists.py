"""Index lists as sorted streams: rows of one token side by side, walked without building objects.

Rows reach a task sorted by token; `whole_lists` hands on batches that end at a list's end, and
`pairs_in_lists` walks all lists of a batch at once by distance: rows k apart, for k = 1, 2, ..., for
as long as a list has rows k apart that the length filter lets through. Rows are sorted by length
inside a list, so when a row's partner at distance k is too long, all its later ones are skipped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one list that one task compares; longer lists are cut into blocks, compared block by block.
LIST_ROWS = 50_000


def whole_lists(batches, keys: int):
    """Batches of columns as arrays, cut where the first `keys` columns change."""
    held = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        if not len(cols[0]):
            continue
        last = np.zeros(len(cols[0]), bool)
        for k in range(keys):
            last |= cols[k] != cols[k][-1]
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        held = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols]
    if held is not None and len(held[0]):
        yield held


def starts_of(cols: list[np.ndarray]) -> np.ndarray:
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return np.flatnonzero(new)


def pairs_in_lists(keys: list[np.ndarray], size: np.ndarray, longest, step: int = 300_000):
    """Index pairs (i, j), i before j in one list, with size[j] <= longest(size[i]); in pieces."""
    if not len(size):
        return
    start = starts_of(keys)
    end = np.repeat(np.append(start[1:], len(size)), np.diff(np.append(start, len(size))))
    limit = longest(size)
    i, k, out, n = np.arange(len(size)), 0, [], 0
    while len(i):
        k += 1
        i = i[i + k < end[i]]
        i = i[size[i + k] <= limit[i]]
        if len(i):
            out.append((i, i + k))
            n += len(i)
        if n >= step or (out and not len(i)):
            yield np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
            out, n = [], 0


def blocks(rows: DataFrame, key: str, by: str, count: str) -> DataFrame:
    """Rows of long lists copied to the pairs of blocks they take part in: columns block_a, block_b, own added.

    Rows meet in (key, block_a, block_b); where the blocks differ only rows of different blocks are to be compared.
    """
    parts = F.ceil(F.col(count) / F.lit(LIST_ROWS)).cast("int")
    own = F.pmod(F.hash(by), parts)
    out = rows.withColumn("_parts", parts).withColumn("own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return out.withColumn("block_a", F.least("own", "_other")).withColumn("block_b", F.greatest("own", "_other")).drop("_parts", "_other")


def batch_of(columns: dict) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v) for v in columns.values()], names=list(columns))
