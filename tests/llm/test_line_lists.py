"""The steps of line dedup one by one, without Spark: crowded lists, cut lists and blocks against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import line_dedup as ld
from corpusloom.llm import packed


class Shared:
    def __init__(self, value):
        self.value = value


class Members(set):
    def has(self, keys):
        return np.array([int(np.int64(np.uint64(k).view(np.int64))) in self for k in keys], bool)


def lines_of(docs):
    return {(i, k): frozenset(x.split()) for i, text in docs for k, x in enumerate(text.split("\n")) if x.split()}


def similar(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def rows_of(batches):
    return [r for b in batches for r in b.to_pylist()]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("limits", [(64, 4, 256, 20_000), (2, 1, 3, 4), (1, 1, 2, 2), (3, 2, 100, 3)])
def test_every_repeat_is_found(monkeypatch, seed, limits):
    for name, value in zip(("FIRST", "OFFERS", "ALONE", "LIST_ROWS"), limits):
        monkeypatch.setattr(ld, name, value)
    monkeypatch.setattr(packed, "FLUSH", 300)
    rng = random.Random(seed)
    common, docs = [f"c{k}" for k in range(12)], []
    for i in range(70):
        lines = []
        for _ in range(rng.randint(1, 4)):
            if rng.random() < 0.6:  # variants of one line: crowded lists, some pairs alike and some not
                line = common[: rng.randint(4, 12)] + [f"v{rng.randint(0, 5)}" for _ in range(rng.randint(0, 3))]
            else:
                line = [f"w{rng.randint(0, 25)}" for _ in range(rng.randint(0, 9))]
            rng.shuffle(line)
            lines.append(" ".join(line))
        docs.append((i, "\n".join(lines)))
    rng.shuffle(docs)
    lines = lines_of(docs)
    order = sorted(lines)
    want = {b for k, b in enumerate(order) if any(similar(lines[a], lines[b]) for a in order[:k])}

    batches = [pa.record_batch([pa.array([i for i, _ in part]), pa.array([0] * len(part)), pa.array([t for _, t in part])], names=["id", "row", "text"]) for part in (docs[:30], docs[30:])]
    counts = np.zeros(ld.BUCKETS)
    for _, text in docs:
        np.add.at(counts, (ld.hashed_words([text.encode()])[0] & np.uint64(ld.BUCKETS - 1)).astype(np.int64), 1)
    rare = Shared(np.minimum(255, np.ceil(8 * np.log2(1 + counts))).astype(np.uint8))

    listed = [b for batch in batches for b in ld._listed(80, 5, rare)([batch])]  # two mappers
    settled = rows_of(ld._settled()(ld._met(80, 5)(listed)))
    gone = {(r["id"], r["line"]) for r in settled if r["kind"] == ld.GONE}
    assert gone <= want
    pairs = [((r["id"], r["line"]), (r["id2"], r["line2"]), r["turn"], r["more"]) for r in settled if r["kind"] == ld.PAIRS]
    found = {b for b, a, turn, _ in pairs if a < b and 0 < turn <= ld.OFFERS and similar(lines[a], lines[b])}
    open_ = {b for b, _, turn, more in pairs if more or turn > ld.OFFERS} - found
    assert want <= gone | found | open_

    key = lambda i, k: int(ld.line_keys(np.array([i]), np.array([0]), np.array([k])).view(np.int64)[0])
    asked = Shared(Members(key(*b) for b in open_))
    hot = [pa.record_batch([pa.array([r["data"] for r in settled if r["kind"] == ld.HOT], pa.binary())], names=["data"])]
    only = Shared(Members(r["key"] for r in rows_of(ld._hot_keys(asked)(hot))))
    inside = Shared(Members(r["key"] for r in rows_of(ld._hot_texts(only)(hot))))
    again = [b for batch in batches for b in ld._again(80, 5, rare, inside, only, asked)([batch])]
    rest = rows_of(ld._settled()(ld._full(80, 5)(again)))
    rest = [((r["id"], r["line"]), (r["id2"], r["line2"])) for r in rest] + [(b, a) for b, a, turn, _ in pairs if turn > ld.OFFERS]
    found |= {b for b, a in rest if a < b and b in open_ and similar(lines[a], lines[b])}
    assert gone | found == want


def test_prefix_holds_a_common_pair():
    """Similar sets share two neighbours among the first prefix(n) of both, whatever the differences are."""
    rng = random.Random(4)
    for _ in range(4000):
        words = rng.sample(range(400), rng.randint(4, 60))
        x = set(words)
        y = set(rng.sample(words, max(1, len(words) - rng.randint(0, 6)))) | set(rng.sample(range(400), rng.randint(0, 6)))
        if x == y or not similar(x, y):
            continue
        heads = [sorted(s)[: int(ld.prefix(np.array([len(s)]), 80)[0])] for s in (x, y)]
        a, b = (set(zip(h, h[1:])) for h in heads)
        assert a & b


def test_exchange_in_two_steps(spark, monkeypatch):
    """More parts than one exchange deals out to: every part still meets whole, in one task."""
    monkeypatch.setattr(packed, "FAN", 4)
    parts, n = 23, 5000
    first = packed.coarse(parts)

    def told(batches):
        for batch in batches:
            box = packed.Outbox(first)
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            key = ld.line_keys(ids // 3, ids * 0, ids * 0)
            box.add(1, key, ids, -ids)
            yield from box.flush()

    def met(batches):
        for part, kinds in packed.received(batches):
            key, ids, minus = kinds[1]
            assert (packed.part_of(key, parts) == part).all() and (ids == -minus).all()
            yield pa.record_batch([pa.array(np.full(len(ids), part, np.int32)), pa.array(key.view(np.int64)), pa.array(ids)], names=["part", "key", "id"])

    sent = spark.range(0, n, 1, 6).mapInArrow(told, packed.SCHEMA)
    rows = packed.exchange(sent, parts).mapInArrow(met, "part int, key long, id long").collect()
    assert sorted(r.id for r in rows) == list(range(n))
    assert len({r.part for r in rows}) == parts and len({(r.key, r.part) for r in rows}) == len({r.key for r in rows})
