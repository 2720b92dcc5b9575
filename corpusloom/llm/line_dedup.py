"""Line dedup by an exact set-similarity join.

A line with a word is the set of its words. A line goes if an earlier line, by (id, line number), has a
Jaccard similarity of need / 100 or more with it; lines are judged on the input, not on what is left.

Words are ordered by rarity. If two lines differ in d words, then d of the gaps between their shared
words hold one at most; so some two shared words stand side by side in both lines among the first
`prefix(n)` of each. A line is listed under those neighbours, pairs of rare words, which far fewer
lines share than share one. In a list, pairs pass the length filter, the positional filter and a bound from
64 parity bits of the two sets, which differ in at least as many words as bits; what passes is verified
on the words themselves.

A line needs one earlier match only. Each list first offers every line its few earliest candidates that
pass the filters; a line that had more to see, and that none of the offers resolves, is then compared with
all candidates of its lists.
So groups of near copies cost as many comparisons as they have lines, and no similar line is missed.
Lists are combined before they shuffle: of a key's lines in one mapper only the earliest go on to other
tasks, and the rest meet those at once.

Scale: listed rows shuffle packed (some 22 bytes each), not lines; words of lines are kept only of lines
in a candidate pair, and texts shuffle once, with the numbers of lines to drop, if they lose any. Copies
of a line are found by name, once a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, free_names, frugal, hashed_words, join_groups, mix, ordered_ids, read, slices
from .packed import SCHEMA, SPARE_BITS, Outbox, coarse, exchange, received, unpack
from .sketches import bloom, dense_rows, rarity, split_by

BUCKETS = 1 << 22
#: Keys that a part holds, about.
PART_KEYS = 1_000_000
#: Words that a mapper counts at once.
COUNTED = 1_000_000
#: Rows of one list that one task compares in full; longer lists are cut into blocks.
LIST_ROWS = 20_000
#: Earliest rows of a list that each of its lines is compared with at first, and how many of them it is offered.
FIRST, OFFERS = 64, 4
#: Rows of one key that a mapper sends on as they are.
ALONE = 256


def _encoded(column) -> list[bytes]:
    """The texts' bytes as they are; nothing for a null."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def _key(owner: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    """One number to sort by: the owner, then parts of one byte, then as much of the last part, a hash, as there is room for."""
    bits = max(1, int(owner.max()).bit_length()) if len(owner) else 1
    key = owner.astype(np.uint64)
    for p in parts[:-1]:
        key = (key << np.uint64(8)) | p.astype(np.uint64)
        bits += 8
    return (key << np.uint64(64 - bits)) | (parts[-1] >> np.uint64(bits))


def line_sets(texts: list[bytes], rare: np.ndarray | None = None):
    """Texts -> per line with a word: text index, line number, number of distinct words; and the words' hashes, sorted in each line.

    With rare (bucket -> rarity) words are sorted by rarity first, and their rarities come too.
    """
    h, _, starts = hashed_words(texts)
    ends = np.flatnonzero(np.frombuffer(b"\n".join(texts), np.uint8) == 10)
    n = np.diff(np.concatenate([[0], np.searchsorted(starts, ends), [len(starts)]]))
    owner = np.repeat(np.arange(len(n)), n)  # lines of all texts are numbered on
    if rare is None:
        order = np.argsort(_key(owner, h))
    else:
        r = rare[(h & np.uint64(BUCKETS - 1)).astype(np.int64)]
        order = np.argsort(_key(owner, r, h))
        r = r[order]
    h, owner = h[order], owner[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, bool)
    h, owner = h[new], owner[new]
    start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(h) else np.zeros(0, np.int64)
    lines, size = owner[start], np.diff(np.append(start, len(h)))
    first = np.concatenate([[0], np.cumsum([t.count(b"\n") + 1 for t in texts])])
    doc = np.searchsorted(first, lines, side="right") - 1
    out = doc, lines - first[doc], size.astype(np.int64), h
    return out if rare is None else (*out, r[new])


def _starts(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else np.zeros(0, np.int64)


def parity(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words of parity bits for each set: bit k says whether an odd number of its members fall on k."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    m = mix(h ^ np.uint64(0xC2B2AE3D27D4EB4F))
    bit = np.uint64(1) << (m & np.uint64(63))
    low = (m >> np.uint64(6)) & np.uint64(1) == 0
    return np.bitwise_xor.reduceat(np.where(low, bit, np.uint64(0)), starts), np.bitwise_xor.reduceat(np.where(low, np.uint64(0), bit), starts)


def short_parity(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 parity bits of each set."""
    if not len(starts):
        return np.zeros(0, np.int64)
    return np.bitwise_xor.reduceat(np.uint64(1) << (mix(h) >> np.uint64(58)), starts).view(np.int64)


def set_names(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set: a mixed sum of its mixed members."""
    if not len(size):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(mix(h ^ np.uint64(0x2545F4914F6CDD1D)), _starts(size)) + size.astype(np.uint64))


def prefix(n: np.ndarray, need: int) -> np.ndarray:
    """How many of the rarest of a line's n words are listed, each with the next.

    Let x lack dx words of its similar line y, and y lack dy of x. Each of the d = dx + dy spoils one gap
    between shared words at most, so an unspoilt one ends at word d + 2 + dx of x at the latest, and
    100 shared >= need (shared + d) bounds dy by dx, and dx by n.
    """
    most = n * (100 - need) // 100
    return np.minimum(n, most + (n - most) * (100 - need) // need + 2)


def line_keys(ids: np.ndarray, row: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A 64-bit key of a line."""
    with np.errstate(over="ignore"):
        return mix(mix(mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ row.astype(np.int64).view(np.uint64)) + line.astype(np.uint64))


def _count():
    """Words of all texts by bucket, as (block, data)."""

    def run(batches):
        counts, held = np.zeros(BUCKETS, np.uint32), []

        def add():
            # equal buckets together: sorting them costs less than to look up each word's count
            bucket = np.sort(np.concatenate(held))
            start, many = _runs(bucket)
            counts[bucket[start]] += many.astype(np.uint32)
            held.clear()

        for batch in batches:
            for a, b in slices(batch.column(0)):
                held.append((hashed_words(_encoded(batch.column(0)[a:b]))[0] & np.uint64(BUCKETS - 1)).astype(np.uint32))
                if sum(map(len, held)) >= COUNTED:
                    add()
        if held:
            add()
        if counts.any():
            yield dense_rows(counts)

    return run


KEYS, NAMES, GONE, PAIRS, HOT = range(5)


_HASH = np.uint64((1 << 64) - (1 << SPARE_BITS + 8))


def _neighbours(h, r, size, need):
    """Rows (owner, key, place) of lines with words in the order of rarity: two words side by side, under a 37-bit hash and the rarer one's rarity."""
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(h)) - _starts(size)[owner]
    # too small a set is similar to none but its equals, which meet by name; a word that was counted once is in no other line
    wide = 100 * size >= need * (size + 1)
    ok = (place + 1 < prefix(size, need)[owner]) & wide[owner] & (r > 8)
    ok[:-1] &= r[1:] > 8
    at = np.flatnonzero(ok)  # the last word of a line is never one of them
    with np.errstate(over="ignore"):
        key = mix(mix(h[at]) + h[at + 1]) & _HASH
    return owner[at], key | np.minimum(r[at], r[at + 1]).astype(np.uint64) << np.uint64(SPARE_BITS), place[at]


def _listed(need: int, parts: int, rare):
    """Blobs: rows of lines under their keys (KEYS), the line's name (NAMES), lines that a task has seen an earlier copy of (GONE)."""

    def run(batches):
        seen: dict[int, tuple] = {}
        box = Outbox(parts)
        for batch in batches:
            ids, rows = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            for a, b in slices(batch.column(2)):
                doc, line, size, h, r = line_sets(_encoded(batch.column(2)[a:b]), rare.value)
                if not len(doc):
                    continue
                names = set_names(h, size)
                lid, lrow = ids[a + doc], rows[a + doc]
                if len(seen) > 100_000:
                    seen.clear()
                fresh, gone = np.zeros(len(doc), bool), []
                for j, (name, me) in enumerate(zip(names.tolist(), zip(lid.tolist(), lrow.tolist(), line.tolist()))):
                    old = seen.setdefault(name, me)
                    if old is me:
                        fresh[j] = True
                    elif me < old:
                        seen[name] = me
                        fresh[j] = True
                        gone.append(old)
                    elif me > old:
                        gone.append(me)
                f = np.flatnonzero(fresh)
                box.add(NAMES, names[f], lid[f], lrow[f], line[f])
                g = np.array(gone, np.int64).reshape(-1, 3)
                box.add(GONE, line_keys(g[:, 0], g[:, 1], g[:, 2]), g[:, 0], g[:, 1], g[:, 2])
                mine = np.repeat(fresh, size)
                h, r, size = h[mine], r[mine], size[f]
                own, key, place = _neighbours(h, r, size, need)
                bits = short_parity(h, _starts(size))[own]
                own, count = f[own], size[own]
                box.add(KEYS, key, lid[own], lrow[own], line[own], count, place, bits)
                if box.full:
                    yield from _combined(box, need)
        yield from _combined(box, need)

    return run


def _combined(box: Outbox, need: int):
    """The held rows, less the later rows of keys that have more than ALONE: those meet the earliest at once."""
    cols = box.take(KEYS)
    if cols is not None:
        start, many = _runs(cols[0])
        if (many > ALONE).any():
            crowd = np.repeat(many > ALONE, many)
            hot = [c[crowd] for c in cols]
            hot = [c[o] for o in [np.lexsort((hot[3], hot[2], hot[1], hot[0]))] for c in hot]
            _offer(box, hot, need)
            turn = _turns(hot[0])
            kept = turn <= FIRST  # one more than others are compared with: who comes later knows that there are more
            cols = [np.concatenate([c[~crowd], x[kept]]) for c, x in zip(cols, hot)]
            order = np.argsort(cols[0])
            cols = [c[order] for c in cols]
            # what is cut off is kept aside for a full comparison
            box.add(HOT, *(x[~kept] for x in hot))
        yield from box.blobs(KEYS, cols)
    yield from box.flush()


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(key)))


def _turns(key: np.ndarray) -> np.ndarray:
    start, many = _runs(key)
    return np.arange(len(key)) - np.repeat(start, many)


def _possible(need, i, j, size, place, *bits):
    """Whether rows i and j of one list can be similar, by length, by position and by parity."""
    both = size[i] + size[j]
    most = np.minimum(place[i], place[j]) + np.minimum(size[i] - place[i], size[j] - place[j])
    differ = sum(np.bitwise_count((p[i] ^ p[j]).view(np.uint64)).astype(np.int64) for p in bits)
    most = np.minimum(most, (both - differ) // 2)
    return (np.minimum(size[i], size[j]) * 100 >= need * np.maximum(size[i], size[j])) & (most * (100 + need) >= need * both)


def _offer(box: Outbox, cols, need: int) -> np.ndarray:
    """Rows sorted by key and position: PAIRS (later line's key, its id, row, line, the earlier line's, more) of the earliest candidates.

    more: the line has more candidates, or rows that were not looked at; with no candidate at all the pair is one of the line with itself.
    Returns which rows are in lists that have, or may have, such lines.
    """
    key, ids, row, line, size, place, bits = cols
    turn = _turns(key)
    start = np.arange(len(key)) - turn
    got = np.zeros(len(key), np.int64)
    more = turn > FIRST
    later, earlier = [], []
    i = np.flatnonzero(turn > 0)
    for k in range(FIRST):
        i = i[turn[i] > k]
        if not len(i):
            break
        j = start[i] + k
        ok = _possible(need, i, j, size, place, bits) & ~((ids[i] == ids[j]) & (row[i] == row[j]) & (line[i] == line[j]))
        a, b = i[ok], j[ok]
        room = got[a] < OFFERS
        more[a[~room]] = True
        got[a[room]] += 1
        later.append(a[room])
        earlier.append(b[room])
    none = np.flatnonzero(more & (got == 0))
    a, b = np.concatenate([*later, none]), np.concatenate([*earlier, none])
    box.add(PAIRS, line_keys(ids[a], row[a], line[a]), ids[a], row[a], line[a], ids[b], row[b], line[b], more[a].astype(np.int64))
    first, many = _runs(key)
    # a list that a mapper has cut has more than FIRST rows here
    return np.repeat(np.logical_or.reduceat(more, first) | (many > FIRST), many) if len(key) else more


def _met(need: int, parts: int):
    """Parts by key and by name -> parts by line: GONE and PAIRS; and HOT, all rows of lists with more to see."""

    def run(batches):
        box = Outbox(parts)
        for _, kinds in received(batches, {NAMES: _repeated, KEYS: _repeated}):
            if GONE in kinds:
                box.add(GONE, *kinds[GONE])
            if PAIRS in kinds:
                box.add(PAIRS, *kinds[PAIRS])
            if NAMES in kinds:
                name, ids, row, line = kinds[NAMES]
                order = np.lexsort((line, row, ids, name))
                name, ids, row, line = (c[order] for c in (name, ids, row, line))
                lead = np.arange(len(name)) - _turns(name)
                gone = (ids != ids[lead]) | (row != row[lead]) | (line != line[lead])
                ids, row, line = ids[gone], row[gone], line[gone]
                box.add(GONE, line_keys(ids, row, line), ids, row, line)
            if KEYS in kinds:
                cols = kinds[KEYS]
                cols = [c[o] for o in [np.lexsort((cols[3], cols[2], cols[1], cols[0]))] for c in cols]
                hot = _offer(box, cols, need)
                box.add(HOT, *(c[hot] for c in cols))
            if HOT in kinds:
                box.add(HOT, *kinds[HOT])
            if box.full:
                yield from box.flush()
        yield from box.flush()

    return run


def _repeated(key: np.ndarray) -> np.ndarray:
    """Whether each key comes more than once."""
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(k), bool)
    if len(k):
        equal = k[1:] == k[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    out = np.zeros(len(k), bool)
    out[order] = same
    return out


_SETTLED = "kind byte, id long, row long, line int, id2 long, row2 long, line2 int, turn int, more boolean, data binary"


def _settled():
    """Parts by line -> rows: GONE lines once each; of lines that are not, their PAIRS, numbered from the earliest on; HOT blobs as they are."""

    def rows(kind, ids, row, line, id2, row2, line2, turn, more):
        n = len(ids)
        cols = [np.full(n, kind, np.int8), ids, row, line.astype(np.int32), id2, row2, line2.astype(np.int32), turn.astype(np.int32), more.astype(bool)]
        return pa.record_batch([*map(pa.array, cols), pa.nulls(n, pa.binary())], names=[c.split()[0] for c in _SETTLED.split(", ")])

    def run(batches):
        def told(batches):
            for batch in batches:
                hot = pa.array(np.asarray(batch.column(1)) == HOT)
                data = batch.column(2).filter(hot)
                if len(data):
                    n = len(data)
                    blank = {"kind": pa.array(np.full(n, HOT, np.int8)), "data": data}
                    types = [pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
                    names = [c.split()[0] for c in _SETTLED.split(", ")]
                    out.append(pa.record_batch([blank.get(c, pa.nulls(n, t)) for c, t in zip(names, types)], names=names))
                yield batch.filter(pa.array(np.asarray(batch.column(1)) != HOT))

        out: list[pa.RecordBatch] = []
        for _, kinds in received(told(batches)):
            gone = np.zeros(0, np.uint64)
            if GONE in kinds:
                gone, first = np.unique(kinds[GONE][0], return_index=True)
                ids, row, line = (c[first] for c in kinds[GONE][1:])
                yield rows(GONE, ids, row, line, ids, row, line, np.zeros(len(ids)), np.zeros(len(ids)))
            if PAIRS in kinds:
                cols = kinds[PAIRS]
                live = ~np.isin(cols[0], gone)
                cols = [c[live] for c in cols]
                if not len(cols[0]):
                    continue
                order = np.lexsort((cols[6], cols[5], cols[4], cols[0]))
                cols = [c[order] for c in cols]
                start, many = _runs(cols[0])
                more = np.repeat(np.maximum.reduceat(cols[7], start), many) > 0
                itself = (cols[1] == cols[4]) & (cols[2] == cols[5]) & (cols[3] == cols[6])
                new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in (cols[0], *cols[4:7])], axis=0)]) & ~itself
                turn = np.cumsum(new)
                turn = turn - np.repeat(turn[start] - new[start], many)  # the pair's number for its line, from 1
                # a line without any pair but with more to see is told by a pair with itself
                alone = (np.repeat(np.add.reduceat(new.astype(np.int64), start), many) == 0) & (_turns(cols[0]) == 0) & more
                at = np.flatnonzero(new | alone)
                yield rows(PAIRS, *(c[at] for c in cols[1:7]), turn[at], more[at])
        yield from out

    return run


def _keys(batches):
    for batch in batches:
        ids, row, line = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        yield pa.record_batch([pa.array(line_keys(ids, row, line).view(np.int64))], names=["key"])


def _text_keys(batches):
    for batch in batches:
        ids, row = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        yield pa.record_batch([pa.array(np.unique(line_keys(ids, row, np.zeros(len(ids), np.int64))).view(np.int64))], names=["key"])


def _near(batch, filters):
    """The rows of a batch (id, row, text) whose text may be in the filter, and their ids and rows."""
    ids, rows = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    near = filters.value.has(line_keys(ids, rows, np.zeros(len(ids), np.int64)))
    return batch.filter(pa.array(near)), ids[near], rows[near]


def _words_of(inside, wanted):
    """Word hashes of the lines in a filter: (id, row, line, words). Most texts have none, and those are not even decoded."""

    def run(batches):
        for batch in batches:
            batch, ids, rows = _near(batch, inside)
            for a, b in slices(batch.column(2)):
                texts = _encoded(batch.column(2)[a:b])
                n = np.array([t.count(b"\n") + 1 for t in texts])
                owner = np.repeat(np.arange(len(texts)), n)
                lines = np.arange(len(owner)) - np.repeat(_starts(n), n)
                hit = wanted.value.has(line_keys(ids[a + owner], rows[a + owner], lines))
                owner, lines = owner[hit], lines[hit]  # most lines are not in the filter, and those are not hashed
                if not len(owner):
                    continue
                split = {k: texts[k].split(b"\n") for k in np.unique(owner).tolist()}
                some, _, size, h = line_sets([split[k][j] for k, j in zip(owner.tolist(), lines.tolist())])
                start, raw = _starts(size), h.tobytes()
                data = [raw[8 * s : 8 * (s + m)] for s, m in zip(start.tolist(), size.tolist())]
                doc = a + owner[some]
                yield pa.record_batch([pa.array(ids[doc]), pa.array(rows[doc]), pa.array(lines[some].astype(np.int32)), pa.array(data, pa.binary())], names=["id", "row", "line", "words"])

    return run


def _similar(need: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = [[x.as_py() for x in batch.column(k)] for k in (3, 4)]
            sizes = [np.array([len(x) // 8 for x in side]) for side in sides]
            h = np.concatenate([np.frombuffer(b"".join(side), np.uint64) for side in sides])
            owner = np.concatenate([np.repeat(np.arange(len(size)), size) for size in sizes])
            order = np.argsort(_key(owner, h))
            h, owner = h[order], owner[order]
            # a side has no word twice, so what comes twice is shared
            n = np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=batch.num_rows)
            ok = pa.array(100 * n >= need * (sizes[0] + sizes[1] - n))
            yield pa.record_batch([batch.column(k).filter(ok) for k in range(3)], names=["id", "row", "line"])

    return run


def _hot_keys(asked):
    """HOT blobs -> keys of lists that have a line in the filter."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                key, ids, row, line = unpack(data.as_buffer(), 4)
                hit = asked.value.has(line_keys(ids, row, line))
                if hit.any():
                    yield pa.record_batch([pa.array(np.unique(key[hit]).view(np.int64))], names=["key"])

    return run


def _hot_texts(only):
    """HOT blobs -> keys of the texts that have a line in a list of the filter."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                key, ids, row = unpack(data.as_buffer(), 3)
                hit = only.value.has(key)
                if hit.any():
                    yield pa.record_batch([pa.array(np.unique(line_keys(ids[hit], row[hit], np.zeros(int(hit.sum()), np.int64))).view(np.int64))], names=["key"])

    return run


def _deal(box: Outbox, asked, key, ids, row, line, size, place, one, two) -> None:
    """Rows of lists under the lists' blocks: every row in its own, asked ones in all."""
    name = line_keys(ids, row, line)
    wanted = asked.value.has(name)
    # no list is longer than its rarer word is frequent
    r = (key >> np.uint64(SPARE_BITS)).astype(np.uint8)
    blocks = np.clip(np.ceil(np.exp2(r / 8.0) / LIST_ROWS), 1, 1 << 14).astype(np.int64)
    mine = (name % blocks.astype(np.uint64)).astype(np.int64)
    pick = np.repeat(np.arange(len(key)), np.where(wanted, blocks, 1))
    block = np.where(wanted[pick], _turns(pick.astype(np.uint64)), mine[pick])
    with np.errstate(over="ignore"):
        dealt = mix(key[pick] + block.astype(np.uint64))
    box.add(KEYS, dealt, *(c[pick] for c in (ids, row, line, size, place, one, two)), ((block == mine[pick]) * 2 + wanted[pick]).astype(np.int64))


def _again(need: int, parts: int, rare, inside, only, asked):
    """Blobs of lists to compare in full: rows with parity bits; lists above LIST_ROWS in blocks, to all of which the asked lines go."""

    def run(batches):
        box = Outbox(parts)
        for batch in batches:
            batch, ids, rows = _near(batch, inside)
            for a, b in slices(batch.column(2)):
                doc, line, size, h, r = line_sets(_encoded(batch.column(2)[a:b]), rare.value)
                if not len(doc):
                    continue
                one, two = parity(h, _starts(size))
                own, key, place = _neighbours(h, r, size, need)
                some = np.flatnonzero(only.value.has(key))
                own, key, place = own[some], key[some], place[some]
                _deal(box, asked, key, ids[a + doc[own]], rows[a + doc[own]], line[own], size[own], place, one[own].view(np.int64), two[own].view(np.int64))
                if box.full:
                    yield from box.flush()
        yield from box.flush()

    return run


def _recalled(parts: int, only, asked):
    """_again from HOT blobs instead of texts, and with the 64 parity bits that are there; copies that a task had seen take no part again."""

    def run(batches):
        box = Outbox(parts)
        for batch in batches:
            for data in batch.column(0):
                cols = unpack(data.as_buffer())
                some = np.flatnonzero(only.value.has(cols[0]))
                if len(some):
                    cols = [c[some] for c in cols]
                    _deal(box, asked, *cols, np.zeros(len(some), np.int64))
                if box.full:
                    yield from box.flush()
        yield from box.flush()

    return run


def _full(need: int, parts: int):
    """Parts by list -> parts by line: PAIRS of every asked line and all earlier lines of its lists that can be similar."""

    def run(batches):
        box = Outbox(parts)
        for _, kinds in received(batches):
            if KEYS not in kinds:
                continue
            cols = kinds[KEYS]
            cols = [c[o] for o in [np.lexsort((cols[3], cols[2], cols[1], cols[0]))] for c in cols]
            key, ids, row, line, size, place, one, two, flags = cols
            turn = _turns(key)
            i = np.flatnonzero((flags & 1 == 1) & (turn > 0))
            k = 0
            while len(i):
                k += 1
                i = i[turn[i] >= k]
                j = i - k
                ok = (flags[j] & 2 == 2) & _possible(need, i, j, size, place, one, two) & ((ids[i] != ids[j]) | (row[i] != row[j]) | (line[i] != line[j]))
                a, b = i[ok], j[ok]
                box.add(PAIRS, line_keys(ids[a], row[a], line[a]), ids[a], row[a], line[a], ids[b], row[b], line[b], np.zeros(len(a), np.int64))
                if box.full:
                    yield from box.flush()
        yield from box.flush()

    return run


def repeated_lines(docs: DataFrame, *, id_col: str, text_col: str, need: int = 80, reread: bool = True) -> DataFrame:
    """(id, row, lines): numbers of the lines of each text that go. row is the text's hash, or null where ids are unique.

    reread: lists to be compared in full are told from the texts anew, by 128 parity bits; else from the rows that
    were kept of them, by 64, which leaves more pairs to verify. What goes is the same.
    Ids are integers. need is 75 or more: with less, similar lines need not have a listed pair of words in common.
    """
    if not 75 <= need <= 100:
        raise ValueError("need is a percentage from 75 to 100")
    spark = docs.sparkSession
    space = Workspace(spark, "line_dedup")
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    # ids of null texts count too: where they repeat, a hash of the text more is carried, and no text is read for this
    if docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).count().where("count > 1").isEmpty():
        texts = texts.withColumn("row", F.lit(0).cast("long"))  # the id alone tells texts apart
        hashed = False
    else:
        hashed = True
    counts = rarity(texts.select("text").mapInArrow(frugal(_count()), "block long, data binary"), BUCKETS)
    rare = spark.sparkContext.broadcast(counts)
    words = float(np.exp2(counts / 8.0).sum() - BUCKETS)
    parts = max(spark.sparkContext.defaultParallelism, int(0.45 * words / PART_KEYS) + 1)
    first = coarse(parts)
    line, ends = ["id", "row", "line"], ["id2", "row2", "line2"]
    met = exchange(texts.mapInArrow(frugal(_listed(need, first, rare)), SCHEMA), parts).mapInArrow(frugal(_met(need, first)), SCHEMA)
    met = space.table(exchange(met, parts).mapInArrow(frugal(_settled()), _SETTLED))
    gone = met.where(F.col("kind") == GONE).select(*line)
    offers = met.where(F.col("kind") == PAIRS)
    pairs = offers.where("id <> id2 OR row <> row2 OR line <> line2").select(*line, *ends, "turn")
    found = space.table(_verified(space, texts, pairs.where(F.col("turn") <= OFFERS).drop("turn"), need, hashed, few=True))
    open_ = space.table(offers.where(F.col("more") | (F.col("turn") > OFFERS)).select(*line).distinct().join(found, line, "left_anti"))
    left = open_.count()
    out = gone.unionByName(found)
    if left:
        asked = spark.sparkContext.broadcast(bloom(open_.mapInArrow(frugal(_keys), "key long"), left))
        hot = met.where(F.col("kind") == HOT).select("data")
        keys = space.table(hot.mapInArrow(frugal(_hot_keys(asked)), "key long"))
        only = spark.sparkContext.broadcast(bloom(keys, keys.count()))
        if reread:
            keys = space.table(hot.mapInArrow(frugal(_hot_texts(only)), "key long"))
            inside = spark.sparkContext.broadcast(bloom(keys, keys.count()))
            rest = texts.mapInArrow(frugal(_again(need, first, rare, inside, only, asked)), SCHEMA)
        else:
            rest = hot.mapInArrow(frugal(_recalled(first, only, asked)), SCHEMA)
        rest = exchange(rest, parts).mapInArrow(frugal(_full(need, first)), SCHEMA)
        rest = exchange(rest, parts).mapInArrow(frugal(_settled()), _SETTLED).select(*line, *ends)
        rest = rest.unionByName(pairs.where(F.col("turn") > OFFERS).drop("turn")).distinct()
        rest = rest.join(open_, line, "left_semi").join(pairs.where(F.col("turn") <= OFFERS).drop("turn"), [*line, *ends], "left_anti")
        out = out.unionByName(_verified(space, texts, space.table(rest), need, hashed))
    out = out.groupBy("id", "row").agg(F.collect_set("line").alias("lines"))
    return out if hashed else out.withColumn("row", F.lit(None).cast("long"))


def _verified(space: Workspace, texts: DataFrame, pairs: DataFrame, need: int, hashed: bool, few: bool = False) -> DataFrame:
    """(id, row, line) of the later lines of the pairs that are similar. few: no later line has more than OFFERS pairs."""
    spark = texts.sparkSession
    line, ends = ["id", "row", "line"], ["id2", "row2", "line2"]
    members = space.table(pairs.select(*line).unionByName(pairs.select(*[F.col(e).alias(x) for e, x in zip(ends, line)])).distinct())
    n = members.count()
    if not n:
        return pairs.select(*line)
    wanted = spark.sparkContext.broadcast(bloom(members.mapInArrow(frugal(_keys), "key long"), n))
    inside = spark.sparkContext.broadcast(bloom(members.select("id", "row").mapInArrow(frugal(_text_keys), "key long"), n))
    words = texts.mapInArrow(frugal(_words_of(inside, wanted)), "id long, row long, line int, words binary")
    words = space.table(words.dropDuplicates(line) if hashed else words)
    total = pairs.count()
    second = words.select(*[F.col(x).alias(e) for e, x in zip(ends, line)], F.col("words").alias("words2")).join(pairs.groupBy(*ends).agg(F.count("*").alias("uses")), ends)
    if few:
        one = pairs.join(words, line)
    else:
        first = words.join(pairs.groupBy(*line).agg(F.count("*").alias("uses")), line)
        one = join_groups(pairs, first, line, "uses", total, least=1000).drop("uses")
    both = join_groups(one, second, ends, "uses", total, least=1000)
    return both.select(*line, "words", "words2").mapInArrow(frugal(_similar(need)), "id long, row long, line int").distinct()


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", need: int = 80) -> DataFrame:
    """docs with the text less its repeated lines, and two columns: n_lines and n_removed.

    Lines are split at newlines and compared as sets of words; words are separated by ASCII white space
    and compared as they are. Lines without a word stay. Ids of any type that can be ordered are taken.
    Rows without an id neither lose lines nor make others lose any; a null text stays null, with 0 lines.
    Ties: of equal lines the first by (id, line number) stays; of rows that share an id, the one whose
    text has the smaller hash counts as earlier, and rows that share id and text are one text, so none
    loses its lines to another. Texts of any length are taken whole; a task holds one text at a time
    beside some megabytes. Columns of docs with other names are kept whatever they are called, columns
    named n_lines and n_removed are replaced; an empty table gives an empty result.
    """
    space = Workspace(docs.sparkSession, "repeated_lines")
    number, key, text_hash, owner, row, lines = free_names(docs, "number", "key", "hash", "owner", "row", "lines")
    order = ordered_ids(space, docs.select(id_col))
    if order is None:
        keyed = docs.withColumn(key, F.col(id_col).cast("long"))
    else:
        order = order.select(F.col("id").alias(number), F.col("number").alias(key))
        keyed = docs.join(order, F.col(id_col) == F.col(number), "left").drop(number)
    gone = space.table(repeated_lines(keyed, id_col=key, text_col=text_col, need=need))
    gone = gone.select(F.col("id").alias(owner), F.col("row").alias(row), F.col("lines").alias(lines))
    # a null row: ids are unique, and stand for their texts
    keyed = keyed.withColumn(text_hash, F.xxhash64(text_col))
    some, rest = split_by(keyed, F.xxhash64(key), gone.select(F.xxhash64(owner).alias("key")), gone.count())
    out = some.join(gone.hint("shuffle_hash"), (F.col(key) == F.col(owner)) & F.coalesce(F.col(text_hash) == F.col(row), F.lit(True)), "left")
    out = out.unionByName(rest, allowMissingColumns=True)
    parts = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(lines, i)), "\n")
    # newlines are counted, and only texts that lose lines are split
    ends = F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
    out = out.withColumn("n_lines", F.coalesce(ends + 1, F.lit(0)).cast("long"))
    out = out.withColumn("n_removed", F.coalesce(F.array_size(lines), F.lit(0)).cast("long"))
    out = out.withColumn(text_col, F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(kept))
    return out.drop(key, text_hash, owner, row, lines)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
