"""Summaries of fixed size: counts by hash bucket for rarity, and Bloom filters for membership.

Both have a size that does not grow with the corpus, which is why they may be broadcast; both only
steer work. A fuller sketch orders tokens less finely and a fuller filter lets more rows through, and
neither changes a result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, mix

BLOCK = 1 << 16  # buckets or bytes in a row of a summary
TELLERS = 4  # tasks that hand a summary to the driver, each by a job of its own


def _told(rows: DataFrame):
    """Rows of a summary in the driver. All tasks merge at once, and the shuffle's files go before the rows are read."""
    space = Workspace(rows.sparkSession, "summary")
    table = space.table(rows)
    yield from table.coalesce(TELLERS).toLocalIterator()
    space.drop(table)
_ZSTD = pa.Codec("zstd", compression_level=1)


def dense_rows(counts: np.ndarray) -> pa.RecordBatch:
    """A task's counts as rows (block, data) of the blocks that have any."""
    counts = np.pad(counts, (0, -len(counts) % BLOCK)) if len(counts) % BLOCK else counts
    rows = [(k // BLOCK, _ZSTD.compress(counts[k : k + BLOCK].tobytes(), asbytes=True)) for k in range(0, len(counts), BLOCK) if counts[k : k + BLOCK].any()]
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "data"])


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BLOCK, np.int64)
    for x in pdf.data:
        total += np.frombuffer(_ZSTD.decompress(x, BLOCK * 4), np.uint32)
    return pd.DataFrame({"block": [pdf.block.iloc[0]], "data": [(np.minimum(255, np.ceil(8 * np.log2(1 + total)))).astype(np.uint8).tobytes()]})


def rarity(rows: DataFrame, buckets: int) -> np.ndarray:
    """Bucket -> 8 log2(1 + count), from rows of dense_rows(): one byte a bucket comes to the driver."""
    merged = rows.groupBy("block").applyInPandas(_added, "block long, data binary")
    out = np.zeros(buckets, np.uint8)
    for r in _told(merged):
        part = np.frombuffer(r.data, np.uint8)
        out[r.block * BLOCK : r.block * BLOCK + len(part)] = part[: buckets - r.block * BLOCK]
    return out


def _bits(keys: np.ndarray, bits: int, hashes: int, first: int = 0, last: int | None = None) -> np.ndarray:
    a, b = mix(keys ^ np.uint64(0xA24BAED4963EE407)), mix(keys ^ np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(hashes)[first:last]]).astype(np.int64)


class Bloom:
    """Membership of 64-bit keys, of `most_bits` bits at most."""

    def __init__(self, data: np.ndarray, hashes: int):
        self.data, self.hashes = data, hashes

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        found, left = np.zeros(len(keys), bool), np.arange(len(keys))
        for a in range(0, self.hashes, 2):  # most keys are not in it, and one or two bits tell
            p = _bits(keys[left], len(self.data) * 8, self.hashes, a, a + 2)
            left = left[((self.data[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(axis=0)]
        found[left] = True
        return found


def bloom(keys: DataFrame, rows: int, most_bits: int = 1 << 28, hashes: int = 8) -> Bloom:
    """Bloom filter over the first column of keys (long); 24 bits a row or more, within the bound."""
    bits = int(min(most_bits, max(BLOCK * 8, 1 << int(np.ceil(np.log2(24 * max(1, rows)))))))

    def set_bits(batches):
        for batch in batches:
            p = np.unique(_bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits, hashes))
            block = p // (BLOCK * 8)
            cuts = np.flatnonzero(np.diff(block)) + 1
            parts = np.split(p, cuts) if len(p) else []
            yield pa.record_batch([pa.array([int(x[0] // (BLOCK * 8)) for x in parts], pa.int64()), pa.array([(x % (BLOCK * 8)).astype(np.uint32).tobytes() for x in parts], pa.binary())], names=["block", "data"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(BLOCK * 8, np.uint8)
        for x in pdf.data:
            flags[np.frombuffer(x, np.uint32)] = 1
        return pd.DataFrame({"block": [pdf.block.iloc[0]], "data": [np.packbits(flags, bitorder="little").tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    for r in _told(keys.mapInArrow(set_bits, "block long, data binary").groupBy("block").applyInPandas(merged, "block long, data binary")):
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.data, np.uint8)
    return Bloom(out, hashes)


def _member(shared):
    @F.pandas_udf("boolean")
    def member(key: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(key.to_numpy(np.int64).view(np.uint64)))

    return member


def split_by(rows: DataFrame, key, keys: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """rows whose key (a long column, never null) may be among the n of keys, and the rows whose key is surely not.

    What is surely not among them need not shuffle to find that out.
    """
    member = _member(rows.sparkSession.sparkContext.broadcast(bloom(keys, n)))
    return rows.where(member(key)), rows.where(~member(key))


def without(rows: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """rows whose id is not in gone(id_col); rows with a null id stay. Only rows that the filter lets through shuffle."""
    n = gone.count()
    if not n:
        return rows
    key = F.xxhash64(F.col(id_col))
    maybe, rest = split_by(rows, key, gone.select(F.xxhash64(id_col).alias("key")), n)
    return maybe.join(gone.select(id_col).distinct().hint("shuffle_hash"), id_col, "left_anti").select(*rows.columns).unionByName(rest)
