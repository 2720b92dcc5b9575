"""What line dedup does not do: hash lines that no pair asks for, unpack rows that nothing meets, read texts to count ids."""

import numpy as np
import pyarrow as pa

from corpusloom.llm import line_dedup as ld
from corpusloom.llm import packed


class Filter:
    def __init__(self, keys):
        self.value, self.keys = self, set(keys.tolist())

    def has(self, keys):
        return np.array([k in self.keys for k in keys.tolist()], bool)


def test_only_wanted_lines_are_hashed(monkeypatch):
    hashed, real = [], ld.line_sets
    monkeypatch.setattr(ld, "line_sets", lambda texts, *a: hashed.extend(texts) or real(texts, *a))
    zero = np.zeros(1, np.int64)
    one = np.ones(1, np.int64)
    batch = pa.record_batch([pa.array([7, 8]), pa.array([0, 0]), pa.array(["a b\nc d d\n \ne", "a b\nc d"])], names=["id", "row", "text"])
    wanted = Filter(np.concatenate([ld.line_keys(zero + 7, zero, one), ld.line_keys(zero + 7, zero, 2 * one)]))
    rows = [r for b in ld._words_of(Filter(ld.line_keys(zero + 7, zero, zero)), wanted)([batch]) for r in b.to_pylist()]
    assert [(r["id"], r["row"], r["line"], len(r["words"])) for r in rows] == [(7, 0, 1, 16)]
    assert sorted(hashed) == [b" ", b"c d d"]


def test_rows_that_meet_nothing_are_not_held():
    box = packed.Outbox(3)
    keys = np.arange(1, 9, dtype=np.uint64) << np.uint64(60)
    box.add(0, np.concatenate([keys, keys[2:4]]), np.arange(10))
    box.add(1, keys[:1], np.arange(1))
    batches = list(box.flush())
    got = {k: v for _, kinds in packed.received(batches, {0: ld._repeated, 1: ld._repeated}) for k, c in kinds.items() for v in [list(zip(*(x.tolist() for x in c)))] if v}
    assert {k: sorted(v) for k, v in got.items()} == {0: sorted((int(keys[k]), v) for k, v in ((2, 2), (2, 8), (3, 3), (3, 9)))}


def test_pieces_are_packed_as_one_by_one():
    rng = np.random.default_rng(1)
    for shift in (0, 16):
        key = np.sort(rng.integers(0, 1 << 40, 500).astype(np.uint64)) << np.uint64(shift)
        cols = [key, rng.integers(-3, 300, 500), rng.integers(-(1 << 62), 1 << 62, 500), np.full(500, 9), np.repeat([1, 2], 250)]
        starts = np.array([0, 1, 200, 250])
        pieces = list(packed.pack_pieces(cols, starts))
        for data, a, b in zip(pieces, starts, [*starts[1:], 500]):
            assert data == packed.pack([c[a:b] for c in cols])
            assert all((x == c[a:b]).all() for x, c in zip(packed.unpack(data), cols))


def test_ids_are_counted_without_texts(spark, tmp_path):
    rows = [(1, "a b c d e f"), (2, "a b c d e f\nx"), (2, None), (3, None), (None, "a b c d e f")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = ld.line_dedup(spark.read.parquet(str(tmp_path / "d"))).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, rows[0][1], 1, 0), (2, "x", 2, 1), (2, None, 0, 0), (3, None, 0, 0), (None, rows[4][1], 1, 0)], key=str)
