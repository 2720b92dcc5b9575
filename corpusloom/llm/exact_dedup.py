"""Exact dedup by two passes over a Bloom filter.

Pass 1 sets bits for each text's fingerprint and notes which bits two or more rows have set. Pass 2
tests every row: a row with any bit that only it set is unique and goes straight to the result; only
rows whose bits are all set twice shuffle, and their SHA-256 decides. False positives cost a shuffle,
never a wrong result.

Scale: the filter is cut into slices by fingerprint, so that a slice holds at most `slice_rows` rows
and `slice_rows * bits_per_row / 8` bytes (48 MB at the defaults), whatever the corpus holds; each
slice's filter is broadcast, and all of them live until the result has been read. Bits are gathered by segment through a shuffle, so no task holds more
than a segment. Copies of one text, even a third of all rows, are counted map-side and joined back
by `join_groups`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, join_groups, mix, read

SEGMENT_BITS = 1 << 20
_NOTE = 500_000  # rows after which a task hands on its bits


def positions(fp: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """(hashes, rows) bit positions by double hashing."""
    a, b = mix(fp), mix(fp ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(hashes)])


def _segments(once: np.ndarray, twice: np.ndarray):
    """Positions cut into rows (segment, once, twice), each list as bytes of uint32 offsets."""
    for kind, p in (("once", once), ("twice", twice)):
        seg = (p // SEGMENT_BITS).astype(np.int64)
        cuts = np.flatnonzero(np.diff(seg)) + 1
        for part in np.split(p, cuts) if len(p) else ():
            yield int(part[0] // SEGMENT_BITS), kind, (part % SEGMENT_BITS).astype(np.uint32).tobytes()


def note_bits(bits: int, hashes: int):
    """mapInArrow function: fingerprints -> rows (segment, once, twice)."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        # A row counts once per bit, even if two of its hashes meet in one bit.
        p = np.sort(positions(np.concatenate(held), bits, hashes), axis=0)
        first = np.vstack([np.ones((1, p.shape[1]), bool), p[1:] != p[:-1]])
        at, n = np.unique(p[first], return_counts=True)
        rows = list(_segments(at[n == 1], at[n > 1]))
        return pa.record_batch(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] if r[1] == "once" else b"" for r in rows], pa.binary()), pa.array([r[2] if r[1] == "twice" else b"" for r in rows], pa.binary())],
            names=["segment", "once", "twice"],
        )

    def run(batches):
        held, n = [], 0
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), _NOTE):
                held.append(fp[i : i + _NOTE])
                n += len(held[-1])
                if n >= _NOTE:
                    yield flush(held)
                    held, n = [], 0
        if held and n:
            yield flush(held)

    return run


def merge_segment(pdf: pd.DataFrame) -> pd.DataFrame:
    """All notes on one segment -> its bits that two rows or more have set."""
    once = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf.once])
    at, n = np.unique(once, return_counts=True)
    twice = np.union1d(at[n > 1], np.concatenate([np.frombuffer(x, np.uint32) for x in pdf.twice]))
    return pd.DataFrame({"segment": [pdf.segment.iloc[0]], "twice": [twice.astype(np.uint32).tobytes()]}) if len(twice) else pd.DataFrame({"segment": [], "twice": []})


def repeated_filter(hashed: DataFrame, bits: int, hashes: int) -> np.ndarray:
    """One slice's filter of bits set twice; bits / 8 bytes come to the driver at most."""
    notes = hashed.select("fp").mapInArrow(note_bits(bits, hashes), "segment long, once binary, twice binary")
    merged = notes.groupBy("segment").applyInPandas(merge_segment, "segment long, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        at = np.frombuffer(row.twice, np.uint32).astype(np.int64) + row.segment * SEGMENT_BITS
        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def _tester(seen, bits: int, hashes: int):
    """Column function: could another row have this fingerprint?"""

    @F.pandas_udf("boolean")
    def repeats(fp: pd.Series) -> pd.Series:
        p = positions(fp.to_numpy(np.int64).view(np.uint64), bits, hashes).astype(np.int64)
        return pd.Series(((seen.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(axis=0))

    return repeats


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, hashes: int = 4, slice_rows: int = 24_000_000) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; of equal texts the largest id stays. Rows that repeat an id each give
    a row; equal texts under one id are a group too, and every row with the kept id is kept. Texts of
    any length leave the scan as their digests. Other columns of docs, whatever their names, are not looked at. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "exact_dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.count()
    slices = max(1, -(-total // slice_rows))
    bits = max(SEGMENT_BITS, 1 << int(np.ceil(np.log2(max(1, bits_per_row * total / slices)))))
    hashed = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("sha"))
    hashed = hashed.withColumn("fp", F.xxhash64("sha")).withColumn("slice", F.pmod(F.shiftrightunsigned("fp", 40), F.lit(slices)))
    hashed = space.table(hashed, by=["slice"])
    parts = []
    for k in range(slices):
        part = hashed.where(F.col("slice") == k).select("id", "sha", "fp") if slices > 1 else hashed.select("id", "sha", "fp")
        seen = spark.sparkContext.broadcast(repeated_filter(part, bits, hashes))

        parts.append(part.withColumn("maybe", _tester(seen, bits, hashes)("fp")).drop("fp"))
    flagged = parts[0]
    for p in parts[1:]:
        flagged = flagged.unionByName(p)
    maybe, rest = flagged.where("maybe").drop("maybe"), flagged.where("not maybe").drop("maybe")
    groups = space.table(maybe.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")))
    out = join_groups(maybe, groups, ["sha"], "group_size", total).select("id", "keep_id", "group_size", "sha")
    out = out.unionByName(rest.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g USING (text)
"""
