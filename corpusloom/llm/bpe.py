"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than a chunk is cut at multiples of the chunk length. Around each cut, two
pre-tokenisations, one begun an overlap before the cut and one at the cut, are compared; where their
boundaries first agree the text can be cut for good, provided that the run from the chunk's own start
has the boundary too. Where it has not, the chunk is carried on past that cut, so the pieces are those
of one pass over the whole text. Each piece is then encoded by itself; decoding joins the raw bytes.

Scale: most texts are one chunk and are encoded where they are read, with no shuffle. Texts above
`long_chars` are dealt out by (text, chunk) so that their chunks are encoded side by side, and only
their token ids meet again. Vocabulary and pattern are broadcast (a file of fixed size). Workers serve stage
after stage, so a task drops its encoder when it ends: otherwise every idle worker of an executor keeps one.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, read

#: Characters beyond a boundary that can have a say in it, for patterns with short lookahead.
MARGIN = 16


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Pieces(dict):
    """Piece -> what make says of it: a cache that is emptied when full."""

    def __init__(self, make, most: int = 100_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, piece: str):
        found = self.make(piece)
        if len(piece) < 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = found
        return found


def _packed(encode_piece):
    """Piece -> its ids as 32-bit integers in one bytes object."""
    return lambda piece: np.array(encode_piece(piece.encode("utf-8", "replace")), np.int32).tobytes()


def _told(encode_piece, bytes_of):
    """Piece -> (number of ids, ids as text, decoded bytes)."""

    def make(piece: str):
        ids = encode_piece(piece.encode("utf-8", "replace"))
        return len(ids), " ".join(map(str, ids)), b"".join(map(bytes_of.__getitem__, ids))

    return make


class Codec:
    """Ranks and pattern -> encoder and decoder of one process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, chunk: int = 65_536, overlap: int = 1_024):
        import tiktoken

        if overlap <= 2 * MARGIN or chunk <= 2 * overlap:
            raise ValueError("overlap must exceed twice MARGIN, and chunk twice the overlap")
        self.rx = regex.compile(pattern)
        self.encode_piece = tiktoken.Encoding("corpusloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.chunk, self.overlap = chunk, overlap
        # no reference back to self: what a task has built goes at once when it drops the codec
        self.packed, self.told = Pieces(_packed(self.encode_piece)), Pieces(_told(self.encode_piece, self.bytes_of))

    def ends(self, text: str, start: int, stop: int) -> list[int]:
        """Boundaries of one run from start that more text could not move; all of them if stop is the end."""
        sure = len(text) if stop >= len(text) else stop - MARGIN
        return [e for m in self.rx.finditer(text, start, min(stop, len(text))) if (e := m.end()) <= sure]

    def resync(self, text: str, cut: int) -> int | None:
        """The first boundary at or after cut on which a run from an overlap earlier and one from cut agree."""
        stop = min(len(text), cut + self.overlap)
        early = {e for e in self.ends(text, cut - self.overlap, stop) if e >= cut}
        if cut in early:
            return cut
        return next((e for e in self.ends(text, cut, stop) if e in early), None)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Text cut into spans at boundaries that one pass over the whole text has too."""
        out, start = [], 0
        for cut in range(self.chunk, len(text) - self.overlap, self.chunk):
            at = self.resync(text, cut)
            if at is not None and at > start and at in self.ends(text, start, min(len(text), at + self.overlap)):
                out.append((start, at))
                start = at
        return [*out, (start, len(text))]

    def between(self, text: str, start: int, end: int) -> list[str]:
        """Pieces from one boundary to another; what follows stays in sight, for the pattern's lookahead."""
        return [m.group() for m in self.rx.finditer(text, start, min(len(text), end + MARGIN)) if m.end() <= end]

    def pretokens(self, text: str) -> list[str]:
        if len(text) <= self.chunk:
            return self.rx.findall(text)
        return [p for a, b in self.spans(text) for p in self.between(text, a, b)]

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.packed.__getitem__, self.pretokens(text or ""))), np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.ids(text).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, and the hashes of their decimal form and of their decoded bytes."""
        found = [self.told[p] for p in self.pretokens(text or "")]
        return sum(f[0] for f in found), hashlib.sha256(" ".join([f[1] for f in found]).encode()).hexdigest(), hashlib.sha256(b"".join([f[2] for f in found])).hexdigest()

    def part(self, window: str, at: int, first: bool, last: bool) -> tuple[bool, list[int]]:
        """Ids of one chunk in its window, in which the chunk begins at `at`; False where it does not end at its cut."""
        start = 0 if first else self.resync(window, at)
        end = len(window) if last else self.resync(window, at + self.chunk)
        if start is None or end is None or not (last or end in self.ends(window, start, min(len(window), end + self.overlap))):
            return False, []
        return True, [i for p in self.between(window, start, end) for i in self.encode_piece(p.encode("utf-8", "replace"))]


class Shared:
    """What the executors need for a Codec, as three values instead of an object for each rank; a task builds it once."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str, chunk: int, overlap: int):
        ends = np.cumsum([len(b) for b in ranks], dtype=np.int64)
        self.value = spark.sparkContext.broadcast((b"".join(ranks), ends, np.fromiter(ranks.values(), np.int64, len(ranks)), pattern, chunk, overlap))

    def codec(self) -> Codec:
        key = id(self.value.value)
        if _BUILT.get("key") != key:
            raw, ends, ids, *rest = self.value.value
            ends = ends.tolist()
            _BUILT.update(key=key, codec=Codec({raw[a:b]: i for a, b, i in zip([0, *ends], ends, ids.tolist())}, *rest))
        return _BUILT["codec"]

    def drop(self) -> None:
        """Of this worker's module: a function that is pickled by value has a copy of _BUILT."""
        _BUILT.clear()


_BUILT: dict = {}


def _whole(shared: Shared, mode: str):
    def run(batches):
        try:
            codec = shared.codec()
            for batch in batches:
                texts = (x.as_py() for x in batch.column(1))
                if mode == "ids":
                    for k in range(0, batch.num_rows, 250):
                        ids = [codec.ids(x.as_py()) for x in batch.column(1)[k : k + 250]]
                        ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
                        yield pa.record_batch([batch.column(0)[k : k + 250], pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))], names=["id", "ids"])
                else:
                    rows = [codec.digest(t) for t in texts]
                    yield pa.record_batch([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            shared.drop()

    return run


def _chunks(shared: Shared):
    def run(batches):
        try:
            codec = shared.codec()
            for batch in batches:
                rows = [codec.part(w, at, first, last) for w, at, first, last in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)))]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array([r[0] for r in rows]), pa.array([np.array(r[1], np.int32).tobytes() for r in rows], pa.binary())], names=["sha", "k", "ok", "ids"])
        finally:
            shared.drop()

    return run


def _joined(shared: Shared, mode: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        codec, ok = shared.codec(), bool(pdf.ok.all())
        ids = np.concatenate([np.frombuffer(x, np.int32) for x in pdf.sort_values("k").ids]).tolist() if ok else []
        if mode == "ids":
            return pd.DataFrame({"sha": [pdf.sha.iloc[0]], "ok": [ok], "ids": [ids]})
        return pd.DataFrame({"sha": [pdf.sha.iloc[0]], "ok": [ok], "n_tokens": [len(ids)], "ids_sha256": [hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()], "decoded_sha256": [hashlib.sha256(codec.decode(ids)).hexdigest()]})

    return run


def bpe(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, mode: str = "ids", id_col: str = "doc_id", text_col: str = "text", chunk: int = 65_536, overlap: int = 1_024, long_chars: int = 4_194_304) -> DataFrame:
    """id and ids (mode "ids"), or id, n_tokens, ids_sha256 and decoded_sha256 (mode "digest").

    One row per row of docs, repeated ids included. Null counts as empty: no ids. Other columns of
    docs are not looked at; an empty table gives an empty result. Texts above long_chars characters
    are encoded chunk by chunk on several tasks; one whose chunks do not all meet at their cuts is
    encoded in one task instead.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    made = "ids array<int>" if mode == "ids" else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    shared = Shared(docs.sparkSession, ranks, pattern, chunk, overlap)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.where("text IS NULL OR length(text) <= %d" % long_chars).mapInArrow(frugal(_whole(shared, mode)), f"id {kind}, {made}")
    long = rows.where("length(text) > %d" % long_chars).withColumn("sha", F.sha2("text", 256))
    parts = (
        long.dropDuplicates(["sha"])
        .select("sha", "text", F.length("text").alias("n"))
        .select("sha", "text", "n", F.explode(F.expr(f"sequence(0, greatest(0, cast(floor((n - {overlap} - 1) / {chunk}) AS int)))")).alias("k"))
        .withColumn("last", F.expr(f"(k + 1) * {chunk} >= n - {overlap}"))
        .withColumn("from", F.expr(f"greatest(0, k * {chunk} - {overlap})"))
        .select("sha", "k", F.expr(f"substring(text, from + 1, CASE WHEN last THEN n ELSE (k + 1) * {chunk} + {overlap} - from END)").alias("window"), F.expr(f"k * {chunk} - from").alias("at"), F.expr("k = 0").alias("first"), "last")
        .repartition("sha", "k")
    )
    encoded = parts.mapInArrow(frugal(_chunks(shared)), "sha string, k int, ok boolean, ids binary")
    joined = encoded.groupBy("sha").applyInPandas(_joined(shared, mode), f"sha string, ok boolean, {made}")
    found = long.join(joined, "sha")
    names = [c.split()[0] for c in made.split(", ")]
    out = out.unionByName(found.where("ok").select("id", *names))
    out = out.unionByName(found.where("NOT ok").select("id", "text").mapInArrow(frugal(_whole(shared, mode)), f"id {kind}, {made}"))
    return out.withColumnRenamed("id", id_col)


def op7_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return bpe(read(spark, sf_dir, "documents"), load_ranks(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, mode="digest")
