"""N-gram Jaccard join with set-relation skipping, and the classes that its links form.

A document is the set of its n-word shingles, as 64-bit hashes. Shingles are ordered by rarity, from a
sketch of all counts. Two sets with Jaccard >= 0.8 share one of their rarest |x| - ceil(0.8 |x|) + 1
shingles, and 1 + k of them if k more are listed; so index lists hold only those, only of shingles that
two different sets list, and only of sets that share enough of them.

What is skipped, and how the result stays whole:
- equal sets are one entry, whatever number of documents has them;
- by index: in a list sorted by length, all partners beyond 5/4 of a set's length are skipped at once,
  and pairs whose positions, or parity bits, leave room for too few common shingles are not looked at;
- by answer: each set is first compared with one highly similar set, its pivot. Sets in one class need
  no further comparison. A pair of sets from two classes is compared only if the pivot's overlap with
  the partner, already computed, plus what the set has beyond its pivot can reach the threshold.
A pair is left out only if its sets are in one class already or a bound rules it out, so no link
between classes is lost.

Scale: shuffled are (shingle, set) pairs, not texts; sets are kept only of documents that share a
listed shingle. The sketch and the Bloom filter of shared shingles have a fixed size. Lists are joined
through `join_groups` and compared in blocks; copies collapse before any shuffle counts them.
Hashes of 64 bits stand for shingles and sets: by chance two of n different texts are taken for equal
with a probability of about n^2 / 2^65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, frugal, gram_hashes, hashed_words, join_groups, read
from .components import components
from .lists import batch_of, blocks, pairs_in_lists, whole_lists
from .sketches import bloom, dense_rows, rarity, without

BUCKETS = 1 << 22
STEP = 500  # texts hashed together
SPARE = 25  # a set lists one shingle for each so many beyond what it must
_SMALL = np.uint64(0x8A5CD789635D2DFF)


def grams(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Shingle hashes of each text, in order and with repeats; the whole sequence where there are fewer than n words."""
    h, count, _ = hashed_words(texts, lower=True)
    g, at, out = gram_hashes(h, n), 0, []
    for m in count.tolist():
        out.append(g[at : at + m - n + 1] if m >= n else gram_hashes(h[at : at + m], m) ^ _SMALL if m else np.empty(0, np.uint64))
        at += m
    return out


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text; none without words."""
    return np.unique(grams([(text or "").encode("utf-8", "replace")], n)[0])


def least_shared(n, need: int):
    """How many listed shingles a set of n shingles shares with any partner at least: what the smallest partner lists beyond the need."""
    return 1 + ((need * n + 99) // 100) // SPARE


def prefix_size(n, need: int):
    """Rarest shingles to list: n - ceil(need n / 100) + 1, and one more for each SPARE shingles.

    Two sets that share ceil(need n / 100) shingles for both sizes n share 1 + k of the shingles that
    they list if each lists k more than it must.
    """
    return n - (need * n + 99) // 100 + 1 + n // SPARE


def set_id(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def _longs(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


class _Known(dict):
    """Text hash -> (number of shingles, set id) of texts that a task has seen; a cache for copies, emptied when full."""

    def put(self, key: int, value: tuple[int, int]) -> None:
        if len(self) >= 100_000:
            self.clear()
        self[key] = value


def _encoded(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def _count(n: int):
    """The task's counts of shingles by bucket, as (block, data)."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                g = grams(_encoded(batch.column(0)[k : k + STEP]), n)
                np.add.at(counts, (np.concatenate(g) & np.uint64(BUCKETS - 1)).astype(np.int64), np.uint32(1))
        if counts.any():
            yield dense_rows(counts)

    return run


def _prefixes(texts: list[bytes], n: int, need: int, known: _Known, rare: np.ndarray):
    """(set id, set, its prefix in order, the shingles as they stand in the text) of the texts that this task has not seen yet."""
    keys = [xxhash.xxh3_64_intdigest(t) for t in texts]
    fresh = {k: t for k, t in zip(keys, texts) if k not in known}
    for key, g in zip(fresh, grams(list(fresh.values()), n)):
        s = np.unique(g)
        i = set_id(s)
        known.put(key, (len(s), i))
        if len(s):
            order = (rare[(s & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
            p = prefix_size(len(s), need)
            top = np.argpartition(order, p - 1)[:p] if p < len(s) else np.arange(len(s))
            yield i, s, s[top[np.lexsort((s[top], order[top]))]], g


def _listed(n: int, need: int, rare):
    """(shingle, set_id) of listed shingles: the least and the greatest set of some hundred texts."""

    def run(batches):
        known = _Known()
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                found = [(i, p) for i, _, p, _ in _prefixes(_encoded(batch.column(0)[k : k + STEP]), n, need, known, rare.value)]
                if found:
                    s = np.concatenate([p for _, p in found])
                    i = np.repeat(np.array([i for i, _ in found], np.int64), [len(p) for _, p in found])
                    order = np.lexsort((i, s))
                    s, i = s[order], i[order]
                    first = np.concatenate([[True], s[1:] != s[:-1]])
                    ends = first | np.append(first[1:], True)
                    yield pa.record_batch([_longs(s[ends]), pa.array(i[ends])], names=["shingle", "set_id"])

    return run


DOC, INDEX, SET = 0, 1, 2


def _shared(n: int, need: int, rare, filters):
    """Three kinds of rows: documents (id, set_id, size); index rows (shingle, set_id, size, place, spot) of shingles in the filter; sets that have any (set_id, data)."""

    def run(batches):
        known = _Known()
        for batch in batches:
            kind = batch.column(0).type

            def rows(tag, m, **have):
                types = {"kind": pa.int8(), "id": kind, "shingle": pa.int64(), "set_id": pa.int64(), "size": pa.int32(), "place": pa.int32(), "spot": pa.int32(), "data": pa.binary()}
                have["kind"] = pa.array(np.full(m, tag, np.int8))
                return pa.record_batch([have.get(c) if c in have else pa.nulls(m, t) for c, t in types.items()], names=list(types))

            for k in range(0, batch.num_rows, STEP):
                texts = _encoded(batch.column(1)[k : k + STEP])
                if len(known) > 75_000:
                    known.clear()
                ids, index, sets = [], [], []
                for i, s, p, g in _prefixes(texts, n, need, known, rare.value):
                    at = np.flatnonzero(filters.value.has(p))
                    if len(at) >= least_shared(len(s), need):
                        ids.append(i)
                        order = np.argsort(g, kind="stable")
                        spot = order[np.searchsorted(g[order], p[at])]
                        index.append((p[at], np.full(len(at), len(s), np.int32), at.astype(np.int32), spot.astype(np.int32)))
                        sets.append(s.tobytes())
                own = [known[xxhash.xxh3_64_intdigest(t)] for t in texts]
                yield rows(DOC, len(texts), id=batch.column(0)[k : k + STEP], set_id=pa.array([x[1] for x in own], pa.int64()), size=pa.array([x[0] for x in own], pa.int32()))
                if ids:
                    many = [len(r[0]) for r in index]
                    shingle, size, place, spot = (np.concatenate([r[c] for r in index]) for c in range(4))
                    yield rows(INDEX, sum(many), shingle=_longs(shingle), set_id=pa.array(np.repeat(np.array(ids, np.int64), many)), size=pa.array(size), place=pa.array(place), spot=pa.array(spot))
                    yield rows(SET, len(ids), set_id=pa.array(ids, pa.int64()), data=pa.array(sets, pa.binary()))

    return run


def _overlaps(batches):
    for batch in batches:
        one, two = batch.column(2), batch.column(3)
        n = [(len(a := np.frombuffer(x.as_buffer(), np.uint64)), len(b := np.frombuffer(y.as_buffer(), np.uint64)), np.intersect1d(a, b, assume_unique=True).size) for x, y in zip(one, two)]
        yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array([r[k] for r in n], pa.int64()) for k in range(3))], names=["a", "b", "size_a", "size_b", "common"])


def overlaps(space: Workspace, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) -> a, b, size_a, size_b, common. b may be one set for a large share of the pairs."""
    pairs = space.table(pairs)
    total = pairs.count()
    one = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("data").alias("one")), "a")
    uses = pairs.groupBy("b").agg(F.count("*").alias("uses"))
    two = sets.select(F.col("set_id").alias("b"), F.col("data").alias("two")).join(uses, "b")
    both = join_groups(one, two, ["b"], "uses", total).select("a", "b", "one", "two")
    out = space.table(both.mapInArrow(frugal(_overlaps), "a long, b long, size_a long, size_b long, common long"))
    space.drop(pairs)
    return out


def links(seen: DataFrame, need: int) -> DataFrame:
    return seen.where(f"100 * common >= {need} * (size_a + size_b - common)").select("a", "b")


PARITY = [f"p{k}" for k in range(8)]


def _parities(batches):
    """(set_id, data) -> set_id, its size and 512 bits: whether an odd number of the set's members fall on each."""
    for batch in batches:
        out = np.zeros((batch.num_rows, len(PARITY)), np.uint64)
        for k, x in enumerate(batch.column(1)):
            h = np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(20)
            odd = (np.bincount((h & np.uint64(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8)
            out[k] = np.packbits(odd, bitorder="little").view(np.uint64)
        length = pa.array([len(x.as_buffer()) // 8 for x in batch.column(1)], pa.int64())
        yield pa.record_batch([batch.column(0), length, *(_longs(out[:, k]) for k in range(len(PARITY)))], names=["set_id", "length", *PARITY])


def _across(need: int):
    """Pairs of one list that are in two classes and that length, place and parity leave possible.

    Two sets differ in as many shingles as parity bits, at least. A pair is not told in every list that it
    shares: lists that follow each other in both texts form a run, and only a run's ends tell of it. The
    sum of `lists` over a pair's rows, its place in the text after the last list of each run less its
    place before the first, is the number of lists that it shares. (A list whose places rule the pair
    out tells nothing; such a pair is none, whatever the sum.)
    """

    def run(batches):
        for key, block_a, block_b, size, place, own, turn, before, after, ids, root, *bits in whole_lists(batches, 3):
            for i, j in pairs_in_lists([key, block_a, block_b], size, lambda n: n.astype(np.int64) * 100 // need):
                ok = (root[i] != root[j]) & ((block_a[i] == block_b[i]) | (own[i] != own[j]))
                first, last = before[i] != before[j], after[i] != after[j]
                ok &= first | last
                i, j, first, last = i[ok], j[ok], first[ok], last[ok]
                both = size[i].astype(np.int64) + size[j]
                most = np.minimum(place[i], place[j]) + np.minimum(size[i] - place[i], size[j] - place[j])
                ok = most * (100 + need) >= need * both
                i, j, both, first, last = i[ok], j[ok], both[ok], first[ok], last[ok]
                differ = sum(np.bitwise_count((p[i] ^ p[j]).view(np.uint64)).astype(np.int64) for p in bits)
                ok = (both - differ) // 2 * (100 + need) >= need * both
                if ok.any():
                    i, j, first, last = i[ok], j[ok], first[ok], last[ok]
                    a = np.where(ids[i] > ids[j], i, j)
                    lists = np.where(last, turn[a].astype(np.int64), 0) - np.where(first, turn[a].astype(np.int64) - 1, 0)
                    # partners share this many listed shingles: a pair met in fewer lists is none
                    least = 1 + np.minimum(size[i], size[j]) // SPARE
                    yield batch_of({"a": ids[a], "b": np.minimum(ids[i], ids[j]), "lists": lists, "least": least})

    return run


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, need: int = 80, rounds: int = 1) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id.

    Two documents link when their sets' Jaccard similarity is need / 100 or more; component_id is the
    least id reachable by links. Null, empty and word-less texts have no shingles and are their own
    class; equal texts are linked; repeated ids are one document of several texts for component_id.
    Other columns of docs are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "ngram_join")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rare = spark.sparkContext.broadcast(rarity(texts.select("text").mapInArrow(frugal(_count(n)), "block long, data binary"), BUCKETS))
    # No map-side sums: nearly all shingles are single, and a task has combined the frequent ones already.
    listed = texts.select("text").mapInArrow(frugal(_listed(n, need, rare)), "shingle long, set_id long").repartition("shingle")
    listed = space.table(listed.groupBy("shingle").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo < hi").select("shingle"))
    filters = spark.sparkContext.broadcast(bloom(listed, listed.count()))
    shared = space.table(texts.mapInArrow(frugal(_shared(n, need, rare, filters)), f"kind byte, id {kind}, shingle long, set_id long, size int, place int, spot int, data binary"))
    described = space.table(shared.where(F.col("kind") == DOC).select("id", F.col("size").cast("long").alias("n_shingles"), "set_id"))
    sets = space.table(shared.where(F.col("kind") == SET).groupBy("set_id").agg(F.first("data").alias("data")))
    parities = space.table(sets.mapInArrow(frugal(_parities), "set_id long, length long, " + ", ".join(f"{p} long" for p in PARITY)))
    index = listed_rows = space.table(shared.where(F.col("kind") == INDEX).select("shingle", "set_id", "size", "place", "spot"))
    space.drop(shared, listed)  # sets were twice there
    index_rows = index.count()
    lists = space.table(index.groupBy("shingle").agg(F.min("set_id").alias("pivot"), F.max("set_id").alias("last"), F.count("*").alias("n")).where("pivot < last").drop("last"))
    index = space.table(join_groups(index, lists, ["shingle"], "n", index_rows).dropDuplicates(["shingle", "set_id"]))
    space.drop(listed_rows, lists)
    # Each set against the pivot that it shares most lists with.
    pivots = index.where("set_id <> pivot").groupBy("set_id", "pivot").agg(F.count("*").alias("c")).groupBy("set_id").agg(F.max(F.struct("c", "pivot")).alias("best"))
    seen = overlaps(space, pivots.select(F.col("set_id").alias("a"), F.col("best.pivot").alias("b")), sets)
    to_pivot = seen
    edges = links(seen, need)
    classes = components(space, edges)
    kept = index
    open_ = index.drop("pivot", "n")
    for step in range(rounds + 1):
        # Lists that still hold two classes. By one plan at all sizes: the classes grow with the sets.
        rooted = open_.drop("root").join(classes.withColumnRenamed("node", "set_id").hint("merge"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        rooted = space.table(rooted)
        space.drop(kept)
        mixed = space.table(rooted.groupBy("shingle").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n_rows")).where("r0 < r1").drop("r0", "r1"))
        open_ = kept = space.table(join_groups(rooted.drop("n_rows"), mixed, ["shingle"], "n_rows", index_rows))
        space.drop(rooted, mixed)
        if step == rounds:
            break
        # In each list, sets outside its largest class against one member of that, another one each step and
        # list, and one set of each class against one of the next: no more pairs than rows.
        pairs = _tries(open_, step).join(seen.select("a", "b"), ["a", "b"], "left_anti")
        fresh = overlaps(space, close_pairs(space, pairs, parities, need), sets)
        new = space.table(links(fresh, need))
        seen = seen.unionByName(fresh)
        if new.isEmpty():
            break
        edges = edges.unionByName(new)
        classes = components(space, edges)
    # A set that shares too few lists with other classes has no partner in any.
    meets = open_.groupBy("set_id").agg(F.count("*").alias("n_lists"))
    able = parities.join(meets, "set_id").where(f"n_lists >= 1 + floor(ceil({need} * length / 100) / {SPARE})").drop("length", "n_lists")
    across = open_.select("shingle", "set_id", "size", "place", "spot", "root", "n_rows").join(able, "set_id")
    # the lists that a set's text has just before and after; where there is none, a number that no other set has
    text = Window.partitionBy("set_id").orderBy("spot", "shingle")
    across = across.withColumn("turn", F.row_number().over(text)).withColumn("before", F.coalesce(F.lag("shingle").over(text), "set_id")).withColumn("after", F.coalesce(F.lead("shingle").over(text), "set_id"))
    across = blocks(across, "shingle", "set_id", "n_rows")
    across = across.repartition("shingle", "block_a", "block_b").sortWithinPartitions("shingle", "block_a", "block_b", "size", "set_id")
    across = across.select("shingle", "block_a", "block_b", "size", "place", "own", "turn", "before", "after", "set_id", "root", *PARITY).mapInArrow(frugal(_across(need)), "a long, b long, lists long, least int")
    across = across.groupBy("a", "b").agg(F.sum("lists").alias("met"), F.max("least").alias("least")).where("met >= least").select("a", "b")
    across = space.table(across.join(seen.select("a", "b"), ["a", "b"], "left_anti"))
    # Answers of a set from those of its pivot: |y and z| <= |pivot and z| + |y beyond its pivot|.
    beyond = to_pivot.select("a", F.col("b").alias("x"), (F.col("size_a") - F.col("common")).alias("beyond"), "size_a")
    derived = across.join(beyond, "a", "left")
    asked = derived.where("x IS NOT NULL AND x <> b").select(F.greatest("x", "b").alias("a"), F.least("x", "b").alias("b")).distinct()
    asked = overlaps(space, asked.join(seen.select("a", "b"), ["a", "b"], "left_anti"), sets)
    seen = seen.unionByName(asked)
    edges = edges.unionByName(links(asked, need))
    known = seen.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"), "common", F.when(F.col("a") >= F.col("b"), F.col("size_b")).otherwise(F.col("size_a")).alias("size_lo"), F.when(F.col("a") >= F.col("b"), F.col("size_a")).otherwise(F.col("size_b")).alias("size_hi")).dropDuplicates(["hi", "lo"])
    derived = derived.withColumn("hi", F.greatest("x", "b")).withColumn("lo", F.least("x", "b")).join(known, ["hi", "lo"], "left")
    size_b = F.when(F.col("b") == F.col("hi"), F.col("size_hi")).otherwise(F.col("size_lo"))
    possible = F.col("common").isNull() | ((F.col("common") + F.col("beyond")) * (100 + need) >= need * (F.col("size_a") + size_b))
    rest = overlaps(space, derived.where(possible).select("a", "b").distinct(), sets)
    classes = components(space, edges.unionByName(links(rest, need)))
    # Sets -> classes -> documents.
    total = described.count()
    kinds = described.groupBy("set_id").agg(F.min("id").alias("least"), F.count("*").alias("n_docs"), F.max("n_shingles").alias("n_shingles"))
    kinds = space.table(kinds.join(classes.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id")))
    roots = space.table(kinds.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_sets")))
    kinds = space.table(join_groups(kinds, roots, ["root"], "n_sets", total).where("n_shingles > 0").select("set_id", "n_docs", "component_id"))
    some = join_groups(described.where("n_shingles > 0"), kinds, ["set_id"], "n_docs", total).select("id", "n_shingles", "component_id")
    none = described.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return some.unionByName(none).withColumnRenamed("id", id_col)


def first_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs less those whose class has a smaller id. Rows with a null id stay."""
    space = Workspace(docs.sparkSession, "ngram_first")
    classes = space.table(jaccard_classes(docs, id_col=id_col, text_col=text_col, **how))
    return without(docs, id_col, classes.where(F.col(id_col) > F.col("component_id")).select(id_col))


def _tries(rows: DataFrame, step: int) -> DataFrame:
    """rows(shingle, set_id, root) of lists with several classes -> distinct pairs (a, b) to compare, linear in the rows."""
    heads = rows.groupBy("shingle", "root").agg(F.count("*").alias("n"), F.min_by("set_id", F.xxhash64("set_id", "shingle", F.lit(step))).alias("head"))
    largest = heads.groupBy("shingle").agg(F.max_by(F.struct("root", "head"), F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    largest = largest.select("shingle", F.col("top.root").alias("top_root"), F.col("top.head").alias("b"))
    outside = rows.select("shingle", "set_id", "root").join(largest, "shingle").where("root <> top_root").select(F.col("set_id").alias("a"), "b")
    after = heads.withColumn("b", F.lag("head").over(Window.partitionBy("shingle").orderBy("root"))).where("b IS NOT NULL").select(F.col("head").alias("a"), "b")
    return outside.unionByName(after).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def close_pairs(space: Workspace, pairs: DataFrame, parities: DataFrame, need: int) -> DataFrame:
    """The pairs (a, b) that sizes and parity bits leave possible."""
    pairs = space.table(pairs)
    uses = pairs.groupBy("b").agg(F.count("*").alias("uses"))
    second = parities.select(F.col("set_id").alias("b"), F.col("length").alias("length_b"), *[F.col(p).alias(f"{p}_b") for p in PARITY]).join(uses, "b")
    both = join_groups(pairs.join(parities.withColumnRenamed("set_id", "a"), "a"), second, ["b"], "uses", pairs.count())
    differ = sum(F.bit_count(F.col(p).bitwiseXOR(F.col(f"{p}_b"))) for p in PARITY)
    size = F.col("length") + F.col("length_b")
    most = F.least("length", "length_b", F.floor((size - differ) / 2))
    return both.where(most * (100 + need) >= need * size).select("a", "b")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir, "documents"))
