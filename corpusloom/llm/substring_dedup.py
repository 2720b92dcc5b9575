"""Substring dedup with a compressed FM-index per shard.

A passage repeats if a window of `n` words also starts in a document with a smaller id. Shards are cut
by content, not by document, so that one index sees every place of a window: each window belongs to
its anchor, the least of its k-word hashes, and consecutive windows of one anchor form a segment.
Equal windows have equal anchors and so meet in one shard. There the distinct segments are indexed,
and streamed back through the index by backward search over its wavelet matrix; the suffix range of a
window gives all its places, and their least document id decides about it.

Scale: first only anchors shuffle, to find those in two documents or more; segments of all other
anchors cannot repeat and stay where they are. Equal segments are one entry, whatever number of
documents has them. An anchor with more than ANCHOR_SEGMENTS distinct segments is cut into its single
windows, which are dealt out by their own content. The texts shuffle once, with what to remove.
Hashes of 64 bits choose anchors and name segments; words are compared as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, gram_hashes, hashed_words, join_groups, ordered_ids, read
from .fm_index import FMIndex
from .sketches import bloom, split_by

SHARD_SEGMENTS = 4_000
ANCHOR_SEGMENTS = 2_000
STEP = 500  # texts hashed together


def segments(h: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window of each segment of a document with word hashes h."""
    if len(h) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    g = gram_hashes(h, k)
    v = np.lib.stride_tricks.sliding_window_view(g, n - k + 1)
    at = v.argmin(axis=1) + np.arange(len(v))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return g[at[first]], first, np.append(first[1:], len(at)) - 1


def _encoded(column) -> list[bytes]:
    return [x.encode("utf-8", "replace") if x else b"" for x in column.to_pylist()]


def _segments_of(texts: list[bytes], n: int, k: int):
    h, count, _ = hashed_words(texts)
    at = 0
    for m in count.tolist():
        yield segments(h[at : at + m], n, k)
        at += m


def _longs(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _anchors(n: int, k: int):
    """(anchor, least id, greatest id), combined within some hundred texts."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy().astype(np.int64)
            texts = batch.column(1)
            for i in range(0, len(ids), STEP):
                found = [x[0] for x in _segments_of(_encoded(texts[i : i + STEP]), n, k)]
                a, d = np.concatenate(found), np.repeat(ids[i : i + STEP], [len(x) for x in found])
                if len(a):
                    order = np.lexsort((d, a))
                    a, d = a[order], d[order]
                    at = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                    yield pa.record_batch([_longs(a[at]), pa.array(d[at]), pa.array(d[np.append(at[1:], len(a)) - 1])], names=["anchor", "lo", "hi"])

    return run


def _cut(n: int, k: int, repeated):
    """Segments with an anchor in the filter: (anchor, seg, id, row, start, text), text with the first of a task only."""

    def run(batches):
        sent = set()
        for batch in batches:
            out = []
            texts = (t for i in range(0, batch.num_rows, STEP) for e in [_encoded(batch.column(2)[i : i + STEP])] for t in zip(e, _segments_of(e, n, k)))
            for i, row, (x, (anchor, first, last)) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                hit = np.flatnonzero(repeated.value.has(anchor))
                ws = x.split() if len(hit) else []
                for a, f, e in zip(anchor[hit].view(np.int64).tolist(), first[hit].tolist(), last[hit].tolist()):
                    text = b" ".join(ws[f : e + n])
                    seg = xxhash.xxh3_64_intdigest(text) - (1 << 63)
                    if seg in sent:
                        text = None
                    else:
                        if len(sent) >= 200_000:
                            sent.clear()
                        sent.add(seg)
                    out.append((a, seg, i, row, f, text))
                if len(out) > 50_000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    return run


_CUT = {"anchor": pa.int64(), "seg": pa.int64(), "id": pa.int64(), "row": pa.int64(), "start": pa.int64(), "text": pa.binary()}


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), _CUT.values())], names=list(_CUT))


def _single_windows(n: int):
    """Segments of frequent anchors -> their windows, each under its own content."""

    def run(batches):
        for batch in batches:
            out = []
            for seg, text, lo in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ws = text.split(b" ")
                for k in range(len(ws) - n + 1):
                    part = b" ".join(ws[k : k + n])
                    out.append((xxhash.xxh3_64_intdigest(part) - (1 << 63), seg, k, part, lo))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))], names=["key", "seg", "skip", "text", "lo"])

    return run


def search_shard(n: int):
    """applyInPandas function: the segments of a shard -> (seg, from, to, least): windows from..to of seg start in document `least` first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, int] = {}
        parts, size = [], []
        for text in pdf.text:
            ws = text.split(b" ")
            parts += [known.setdefault(w, len(known) + 1) for w in ws]
            parts.append(0)
            size.append(len(ws))
        text, size = np.array(parts, np.int64), np.array(size)
        begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        index = FMIndex(text, n)
        # document ids in suffix order: the least of a range is the first document that has the window
        lo_at = np.repeat(pdf.lo.to_numpy(np.int64), size + 1)
        sampled = lo_at[index.order]
        windows = size - n + 1
        owner = np.repeat(np.arange(len(pdf)), windows)
        within = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        lo, hi = index.search(text, begin[owner] + within, n)
        least = lo_at[begin[owner] + within]  # a window in one place has its own segment's first document
        many = np.flatnonzero(hi - lo > 1)
        if len(many):
            # equal windows have equal ranges, and ranges do not overlap
            a, back = np.unique(lo[many], return_inverse=True)
            b = np.zeros(len(a), np.int64)
            b[back] = hi[many]
            cuts = np.empty(2 * len(a), np.int64)
            cuts[0::2], cuts[1::2] = a, b
            least[many] = np.minimum.reduceat(np.append(sampled, sampled[-1]), cuts)[0::2][back]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])])
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(owner)) - 1
        skip = pdf["skip"].to_numpy(np.int64)[owner[at]]
        return pd.DataFrame({"seg": pdf.seg.to_numpy(np.int64)[owner[at]], "from": within[at] + skip, "to": within[end] + skip, "least": least[at]})

    return run


def covered(n_words: int, spans) -> np.ndarray:
    """Which words lie in one of the spans (start, end)."""
    edge = np.zeros(n_words + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    return np.cumsum(edge)[:-1] > 0


def _removed(digest: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for x, a, b in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                ws = (x.as_py() or "").encode("utf-8", "replace").split()
                n = len(ws)
                if a:
                    ws = [w for w, gone in zip(ws, covered(n, zip(a, b)).tolist()) if not gone]
                kept = b" ".join(ws)
                rows.append((n, n - len(ws), hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
            yield pa.record_batch([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], names=["id", "n_words", "n_removed", "kept"])

    return run


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 13, k: int = 6) -> DataFrame:
    """(id, row, starts, ends): the word spans of each document that a document with a smaller id has too. row is the text's hash."""
    spark = docs.sparkSession
    space = Workspace(spark, "substring_dedup")
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    anchors = texts.select("id", "text").mapInArrow(_anchors(n, k), "anchor long, lo long, hi long")
    anchors = space.table(anchors.repartition("anchor").groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("anchor"))
    repeated = spark.sparkContext.broadcast(bloom(anchors, anchors.count()))
    places = space.table(texts.select("id", "row", "text").mapInArrow(_cut(n, k, repeated), "anchor long, seg long, id long, row long, start long, text binary"))
    total = places.count()
    first = places.groupBy("seg").agg(F.min("id").alias("lo"), F.count("*").alias("n_places"))
    first = space.table(first)
    distinct = places.where("text IS NOT NULL").groupBy("seg").agg(F.first("text").alias("text"), F.first("anchor").alias("anchor"))
    distinct = space.table(distinct.join(first.select("seg", "lo"), "seg"))
    per_anchor = distinct.groupBy("anchor").agg(F.count("*").alias("n_segments"))
    frequent = per_anchor.where(F.col("n_segments") > ANCHOR_SEGMENTS)
    # at most (segments / ANCHOR_SEGMENTS) anchors are frequent: a shuffled join, or a broadcast where Spark sees that they are few
    marked = distinct.join(frequent, "anchor", "left")
    few = marked.where("n_segments IS NULL").select(F.col("anchor").alias("key"), "seg", F.lit(0).cast("long").alias("skip"), "text", "lo")
    many = marked.where("n_segments IS NOT NULL").select("seg", "text", "lo").mapInArrow(_single_windows(n), "key long, seg long, skip long, text binary, lo long")
    shards = max(1, -(-distinct.count() // SHARD_SEGMENTS))
    dealt = few.unionByName(many).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    found = space.table(dealt.groupBy("shard").applyInPandas(search_shard(n), "seg long, from long, to long, least long"))
    space.drop(distinct)
    found = found.join(first.select("seg", "n_places"), "seg")
    spans = join_groups(places.select("seg", "id", "row", "start"), found, ["seg"], "n_places", total).where("least < id")
    return spans.select("id", "row", (F.col("start") + F.col("from")).alias("a"), (F.col("start") + F.col("to") + n).alias("b")).groupBy("id", "row").agg(F.collect_list("a").alias("starts"), F.collect_list("b").alias("ends"))


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 13, k: int = 6, digest: bool = False) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed and kept, the words that stay joined by one space (digest: their SHA-256).

    Null and empty texts have no words. Rows without an id neither lose words nor make others lose
    any. Rows that share an id do not make each other lose words. Ids of any type that can be ordered
    are taken. Texts of any length are taken whole. Other columns of docs are not looked at; an empty
    table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    space = Workspace(docs.sparkSession, "substring_spans")
    texts = docs.select(F.col(id_col).alias("id0"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row"))
    order = ordered_ids(space, texts.select("id0"))
    if order is None:
        texts = texts.withColumn("id", F.col("id0").cast("long"))
    else:
        texts = texts.join(order.select(F.col("id").alias("id0"), F.col("number").alias("id")), "id0", "left")
    spans = space.table(repeated_spans(texts, id_col="id", text_col="text", n=n, k=k))
    some, rest = split_by(texts, F.xxhash64("id", "row"), spans.select(F.xxhash64("id", "row").alias("key")), spans.count())
    joined = some.join(spans.hint("shuffle_hash"), ["id", "row"], "left").unionByName(rest, allowMissingColumns=True)
    joined = joined.select(F.col("id0").alias("id"), "text", "starts", "ends")
    return joined.mapInArrow(_removed(digest), f"id {kind}, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS gram FROM d, unnest(range(1, len(ws) - 11)) AS t(i)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS least FROM g) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, unnest(range(0, 13)) AS t(k)),
w AS (SELECT doc_id, i, ws[i] AS word FROM d, unnest(range(1, len(ws) + 1)) AS t(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
