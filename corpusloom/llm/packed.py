"""Exchanges of many small numeric rows as packed blobs: a row of Spark holds thousands of them.

A mapper collects columns of numbers, sorts them by a 64-bit key and cuts them where the key's range
passes from one part to the next; each piece becomes one binary value, with every column in the
narrowest type that holds it. Spark then moves a few large rows, and a part is one task's work.

Parts are ranges of hashed keys, so they are even but for repeats of one key; who emits rows must
combine those first. Up to FAN parts are dealt at once; beyond that the exchange takes two steps, so
that blobs stay large whatever the number of parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Parts that one exchange deals out to.
FAN = 4096
#: Rows that a mapper holds before it emits them.
FLUSH = 250_000
#: Low bits that a key may leave empty: they are not moved, so the steps between the sorted keys that a mapper holds fit in 32 bits.
SPARE_BITS = 19
SCHEMA = "part int, kind byte, data binary"
_SPARE = np.uint64((1 << SPARE_BITS) - 1)
_NARROW = (np.uint8, np.uint16, np.uint32, np.uint64)
_MOST = np.array([np.iinfo(t).max for t in _NARROW], np.uint64)


def pack(cols: list[np.ndarray]) -> bytes:
    """Columns of 64-bit numbers, the first ascending as unsigned ones, as bytes."""
    n = len(cols[0])
    head, body = [n, len(cols)], []
    for k, c in enumerate(cols):
        c = c.astype(np.int64, copy=False).view(np.uint64) if c.dtype != np.uint64 else c
        shift = SPARE_BITS if k == 0 and not (c & _SPARE).any() else 0
        if k == 0:
            lo = c[0] >> np.uint64(shift)
            rest = np.diff(c >> np.uint64(shift), prepend=lo)
        else:
            lo = c.view(np.int64).min().view(np.uint64)
            rest = c - lo
        most = int(rest.max())
        kind = 0 if most == 0 else 1 + next(i for i, t in enumerate(_NARROW) if most <= np.iinfo(t).max)
        head += [int(np.uint64(lo).view(np.int64)), kind | shift << 8]
        if kind:
            body.append(rest.astype(_NARROW[kind - 1]).tobytes())
    return np.array(head, np.int64).tobytes() + b"".join(body)


def pack_pieces(cols: list[np.ndarray], starts: np.ndarray):
    """pack() of each run of rows from one start to the next; ranges are found for all of them at once."""
    n = np.diff(np.append(starts, len(cols[0])))
    head = np.empty((len(starts), 2 + 2 * len(cols)), np.int64)
    head[:, 0], head[:, 1] = n, len(cols)
    rests, kinds = [], []
    for k, c in enumerate(cols):
        c = c.astype(np.int64, copy=False).view(np.uint64) if c.dtype != np.uint64 else c
        if k == 0:
            shift = np.where(np.bitwise_or.reduceat(c, starts) & _SPARE, 0, SPARE_BITS)
            c = c >> np.repeat(shift, n).astype(np.uint64)
            lo = c[starts]
            rest = np.diff(c, prepend=lo[:1])
            rest[starts] = 0
        else:
            shift = 0
            lo = np.minimum.reduceat(c.view(np.int64), starts).view(np.uint64)
            with np.errstate(over="ignore"):
                rest = c - np.repeat(lo, n)
        most = np.maximum.reduceat(rest, starts)
        kind = np.where(most == 0, 0, 1 + np.searchsorted(_MOST, most))
        head[:, 2 + 2 * k], head[:, 3 + 2 * k] = lo.view(np.int64), kind | shift << 8
        rests.append(rest)
        kinds.append(kind.tolist())
    for i, (a, m) in enumerate(zip(starts.tolist(), n.tolist())):
        yield b"".join([head[i].tobytes(), *(r[a : a + m].astype(_NARROW[k[i] - 1]).tobytes() for r, k in zip(rests, kinds) if k[i])])


def unpack(data, most: int | None = None) -> list[np.ndarray]:
    """The columns of pack(), or as many of them: the first as uint64, the others as int64."""
    n, k = np.frombuffer(data, np.int64, 2).tolist()
    head = np.frombuffer(data, np.int64, 2 * k, 16)
    at, out = 16 + 16 * k, []
    for i in range(k)[:most]:
        lo, kind = head[2 * i].view(np.uint64), int(head[2 * i + 1])
        shift, kind = kind >> 8, kind & 0xFF
        if kind:
            t = np.dtype(_NARROW[kind - 1])
            rest = np.frombuffer(data, t, n, at).astype(np.uint64)
            at += n * t.itemsize
        else:
            rest = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            if i == 0:
                out.append((np.cumsum(rest, dtype=np.uint64) + lo) << np.uint64(shift))
            else:
                out.append((rest + lo).view(np.int64))
    return out


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of 64-bit keys, numbered."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Outbox:
    """Rows of several kinds, held until there are FLUSH of them and then emitted by part."""

    def __init__(self, parts: int):
        self.parts, self.held, self.n = parts, {}, 0

    def add(self, kind: int, *cols: np.ndarray) -> None:
        if len(cols[0]):
            self.held.setdefault(kind, []).append(cols)
            self.n += len(cols[0])

    @property
    def full(self) -> bool:
        return self.n >= FLUSH

    def take(self, kind: int) -> list[np.ndarray] | None:
        """All rows of a kind, sorted by key; they are held no more."""
        rows = self.held.pop(kind, None)
        if rows is None:
            return None
        cols = [np.concatenate(c) for c in zip(*rows)]
        order = np.argsort(cols[0])
        return [c[order] for c in cols]

    def flush(self):
        for kind in list(self.held):
            yield from self.blobs(kind, self.take(kind))
        self.n = 0

    def blobs(self, kind: int, cols: list[np.ndarray] | None):
        if cols is None or not len(cols[0]):
            return
        part = part_of(cols[0], self.parts)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1])
        where, data, size = [], [], 0
        for at, piece in zip(part[starts].tolist(), pack_pieces(cols, starts)):
            where.append(at)
            data.append(piece)
            size += len(piece)
            if size > 1 << 23:
                yield _rows(where, kind, data)
                where, data, size = [], [], 0
        if where:
            yield _rows(where, kind, data)


def _rows(where: list[int], kind: int, data: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(where, pa.int32()), pa.array([kind] * len(where), pa.int8()), pa.array(data, pa.binary())], names=["part", "kind", "data"])


def exchange(rows: DataFrame, parts: int) -> DataFrame:
    """Blobs of one part in one task. rows come from an Outbox of coarse(parts) parts."""
    if parts <= FAN:
        return rows.repartitionById(parts, "part")

    def finer(batches):
        box = Outbox(parts)
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2)):
                box.add(kind, *unpack(data.as_buffer()))
                if box.full:
                    yield from box.flush()
        yield from box.flush()

    return rows.repartitionById(FAN, "part").mapInArrow(finer, SCHEMA).repartitionById(parts, "part")


def coarse(parts: int) -> int:
    """Parts that the first mapper deals out to."""
    return min(parts, FAN)


def _picked(blobs: list[bytes], pick) -> list[np.ndarray]:
    """Columns of the rows that pick, told all keys, lets through; the others are unpacked blob by blob only."""
    keys = [unpack(x, 1)[0] for x in blobs]
    through = np.split(pick(np.concatenate(keys)), np.cumsum([len(k) for k in keys])[:-1])
    rows = [[c[m] for c in unpack(x)] for x, m in zip(blobs, through) if m.any()]
    return [np.concatenate(c) for c in zip(*rows)] if rows else [c[:0] for c in unpack(blobs[0])]


def received(batches, picks: dict | None = None):
    """(part, {kind: columns}) for each part of a task: one, as a rule. A task holds its own parts, packed.

    picks: kind -> function that says which of all the kind's keys in a part are wanted.
    """
    picks = picks or {}
    held: dict[int, dict[int, list[bytes]]] = {}
    for batch in batches:
        for part, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            held.setdefault(part, {}).setdefault(kind, []).append(data.as_py())
    for part in list(held):
        kinds = held.pop(part)
        yield part, {kind: _picked(blobs, picks[kind]) if kind in picks else [np.concatenate(c) for c in zip(*(unpack(x) for x in blobs))] for kind, blobs in kinds.items()}
