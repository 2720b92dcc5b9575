"""Line dedup's second round works on rows that the first has kept; summaries come to the driver by a few jobs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import line_dedup as ld
from corpusloom.llm import packed, sketches

from .test_line_lists import Members, Shared, lines_of, rows_of, similar


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("limits", [(64, 4, 256, 20_000), (2, 1, 3, 4), (1, 1, 2, 2), (3, 2, 100, 3)])
def test_kept_rows_tell_every_repeat(monkeypatch, seed, limits):
    for name, value in zip(("FIRST", "OFFERS", "ALONE", "LIST_ROWS"), limits):
        monkeypatch.setattr(ld, name, value)
    monkeypatch.setattr(packed, "FLUSH", 300)
    rng = random.Random(seed)
    common = [f"c{k}" for k in range(12)]
    lines = [[" ".join(rng.sample(common, rng.randint(4, 12)) + [f"v{rng.randint(0, 5)}" for _ in range(rng.randint(0, 3))]) for _ in range(rng.randint(1, 4))] for _ in range(80)]
    docs = [(i, "\n".join(x + rng.choice(lines)[:1])) for i, x in enumerate(lines)]
    rng.shuffle(docs)
    lines = lines_of(docs)
    order = sorted(lines)
    want = {b for k, b in enumerate(order) if any(similar(lines[a], lines[b]) for a in order[:k])}

    batches = [pa.record_batch([pa.array([i for i, _ in part]), pa.array([0] * len(part)), pa.array([t for _, t in part])], names=["id", "row", "text"]) for part in (docs[:15], docs[15:])]
    counts = np.zeros(ld.BUCKETS)
    for _, text in docs:
        np.add.at(counts, (ld.hashed_words([text.encode()])[0] & np.uint64(ld.BUCKETS - 1)).astype(np.int64), 1)
    rare = Shared(np.minimum(255, np.ceil(8 * np.log2(1 + counts))).astype(np.uint8))
    settled = rows_of(ld._settled()(ld._met(80, 5)([b for batch in batches for b in ld._listed(80, 5, rare)([batch])])))
    found = {(r["id"], r["line"]) for r in settled if r["kind"] == ld.GONE}
    pairs = [((r["id"], r["line"]), (r["id2"], r["line2"]), r["turn"], r["more"]) for r in settled if r["kind"] == ld.PAIRS]
    found |= {b for b, a, turn, _ in pairs if a < b and 0 < turn <= ld.OFFERS and similar(lines[a], lines[b])}
    open_ = {b for b, _, turn, more in pairs if more or turn > ld.OFFERS} - found

    key = lambda i, k: int(ld.line_keys(np.array([i]), np.array([0]), np.array([k])).view(np.int64)[0])
    asked = Shared(Members(key(*b) for b in open_))
    hot = [pa.record_batch([pa.array([r["data"] for r in settled if r["kind"] == ld.HOT], pa.binary())], names=["data"])]
    only = Shared(Members(r["key"] for r in rows_of(ld._hot_keys(asked)(hot))))
    rest = rows_of(ld._settled()(ld._full(80, 5)(ld._recalled(5, only, asked)(hot))))
    rest = [((r["id"], r["line"]), (r["id2"], r["line2"])) for r in rest] + [(b, a) for b, a, turn, _ in pairs if turn > ld.OFFERS]
    assert found | {b for b, a in rest if a < b and b in open_ and similar(lines[a], lines[b])} == want


def test_keys_move_in_four_bytes():
    """A mapper's sorted keys are so close, less their empty bits, that 32 bits hold the steps; a pair's rarity stays readable."""
    rng = np.random.default_rng(2)
    h, size = rng.integers(0, 1 << 63, 400_000).astype(np.uint64), np.full(20_000, 20)
    r = rng.integers(9, 200, len(h)).astype(np.uint8)
    owner, key, place = ld._neighbours(h, r, size, 80)
    at = 20 * owner + place
    assert ((key >> np.uint64(packed.SPARE_BITS)).astype(np.uint8) == np.minimum(r[at], r[at + 1])).all()
    order = np.sort(key)
    assert (packed.unpack(packed.pack([order, np.zeros(len(order), np.int64)]))[0] == order).all()
    assert len(packed.pack([order, np.zeros(len(order), np.int64)])) < 4.1 * len(order)


@pytest.mark.parametrize("reread", [False, True])
def test_second_round_leaves_texts_alone(spark, monkeypatch, reread):
    monkeypatch.setattr(ld, "FIRST", 1)
    monkeypatch.setattr(ld, "OFFERS", 1)
    called, real = [], ld._again
    monkeypatch.setattr(ld, "_again", lambda *a: called.append(a) or real(*a))
    rng = random.Random(5)
    docs = [(i, " ".join(rng.sample([f"c{k}" for k in range(14)], 10))) for i in range(60)]
    lines = lines_of(docs)
    order = sorted(lines)
    want = {b[0] for k, b in enumerate(order) if any(similar(lines[a], lines[b]) for a in order[:k])}
    got = ld.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), id_col="doc_id", text_col="text", reread=reread)
    assert {r.id for r in got.collect()} == want
    assert len(called) == reread


def test_summaries_need_few_jobs(spark):
    """However many parts a shuffle has, a job each for TELLERS of them and some for the shuffle."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(x) for x in names]
    context = spark.sparkContext
    try:
        for name, value in zip(names, ("40", "false")):
            spark.conf.set(name, value)
        context.setJobGroup("summaries", "")
        found = sketches.bloom(spark.range(3000), 3000)
        assert found.has(np.arange(3000, dtype=np.uint64)).all()
        assert len(context.statusTracker().getJobIdsForGroup("summaries")) <= sketches.TELLERS + 4
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for name, value in zip(names, before):
            spark.conf.set(name, value)
