"""A Merkle manifest of a dataset: digests of rows, of runs of three of them, and so on up to one root, with a proof for every row.

Leaves are the SHA-256 of a row's fields, each written as its byte count, a colon and its value (null:
a dash). The leaves of a group (source) form a tree by id; the groups' roots form another tree on top.

Bottom up, each level is a table: nodes with the digests of their children, made by one exchange by
(tree, place // 3). Top down, each level's children are joined to their parents, and each puts its
siblings before the proof that its parent has inherited; a tree's root inherits the proof that its
place in the tree on top has. Both take one exchange of a level a step, and levels shrink to a third,
so all of it moves about one and a half times the leaves' digests up, and the parents' proofs down.

Scale: no key is hot, as a parent has three children at most, whatever a source holds. Places of leaves
come from one range exchange (`ordered`), sizes of sources by `join_groups`. Levels persist in the
shared folder, so that a lost executor costs a step, not the tree. Texts are read once.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_repair import CRC_TABLE, crc
from .common import Workspace, join_groups, read
from .ordered import ordered

FAN = 3  # children of a node
SIZE = 32  # bytes of a digest


def leaf_digest(*fields: Column) -> Column:
    """The binary SHA-256 of fields, each as its byte count, a colon and its value; null is a dash."""
    strings = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in strings)), 256))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _hash(digests: Column) -> Column:
    return F.unhex(F.sha2(_hex(digests), 256))


def _parents(nodes: DataFrame) -> DataFrame:
    """The next level: nodes (tree, idx, n, kids, hash), where n counts the tree's nodes on this level."""
    none = F.lit(b"")
    kid = [F.coalesce(F.max(F.when(F.col("idx") % FAN == k, F.col("hash"))), none) for k in range(FAN)]
    up = nodes.groupBy("tree", F.floor(F.col("idx") / FAN).alias("idx"), F.ceil(F.col("n") / FAN).alias("n")).agg(F.concat(*kid).alias("kids"))
    return up.withColumn("hash", _hash(F.col("kids")))


class Forest:
    """Levels of many trees at once, as tables. leaves: tree (string, not null), idx, n, hash; n is the tree's number of leaves."""

    def __init__(self, space: Workspace, leaves: DataFrame):
        self.space, self.levels = space, [leaves]
        most = leaves.agg(F.max("n")).first()[0] or 0
        while most > 1:
            self.levels.append(space.table(_parents(self.levels[-1].where("n > 1"))))
            most = -(-most // FAN)

    def roots(self) -> DataFrame:
        """tree, hash."""
        out = None
        for level in self.levels:
            one = level.where("n = 1").select("tree", "hash")
            out = one if out is None else out.unionByName(one)
        return out

    def pushed(self, inherited: DataFrame) -> DataFrame:
        """tree, idx, proof and the further columns of inherited, for each leaf.

        inherited: tree, proof (binary) and whatever else every leaf of a tree gets; the proof of the tree's root.
        """
        more = [c for c in inherited.columns if c not in ("tree", "proof")]
        held = None
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            here = level.where("n = 1").select("tree", "idx").join(inherited, "tree")
            if held is not None:
                place = F.col("idx") % FAN
                siblings = F.concat(F.substring("kids", F.lit(1), place * SIZE), F.substring("kids", (place + 1) * SIZE + 1, F.lit(FAN * SIZE)))
                children = level.where("n > 1").select("tree", "idx", F.floor(F.col("idx") / FAN).alias("above"))
                above = held.select("tree", F.col("idx").alias("above"), "kids", "proof", *more)
                here = here.unionByName(children.join(above, ["tree", "above"]).select("tree", "idx", F.concat(siblings, "proof").alias("proof"), *more))
            if k:
                held = self.space.table(here.join(level.select("tree", "idx", "kids"), ["tree", "idx"]))
        return here


def steps(idx: int, n: int):
    """(place in its run, length of the run) of a leaf's ancestors, from the leaf up."""
    while n > 1:
        first = idx - idx % FAN
        yield idx - first, min(FAN, n - first)
        idx, n = idx // FAN, -(-n // FAN)


def fold(leaf: bytes, proof: bytes, *paths: tuple[int, int]) -> str:
    """The root, in hexadecimal, that a leaf and its proof lead to; paths: (place, number of leaves) in each tree on the way up."""
    digest, siblings, at = leaf.hex(), proof.hex(), 0
    for idx, n in paths:
        for place, run in steps(idx, n):
            left, right = at + 2 * SIZE * place, at + 2 * SIZE * (run - 1)
            digest = hashlib.sha256((siblings[at:left] + digest + siblings[left:right]).encode()).hexdigest()
            at = right
    return digest


def _folded(leaf: pd.Series, proof: pd.Series, idx: pd.Series, n: pd.Series, top: pd.Series, tops: pd.Series) -> pd.Series:
    return pd.Series([fold(x, p, (i, m), (t, s)) for x, p, i, m, t, s in zip(leaf, proof, idx, n, top, tops, strict=True)])


def folded(leaf: Column | str, proof: Column | str = "proof", place: Column | str = "place", n_rows: Column | str = "n_rows", top: Column | str = "top", tops: Column | str = "tops") -> Column:
    """The root, in hexadecimal, that a leaf (binary) of `proofs()` leads to."""
    return F.pandas_udf(_folded, "string")(leaf, proof, place, n_rows, top, tops)


class Manifest:
    """The manifest of rows: `root` (hex), `sources` (source, its place, number of rows and subroot), `nodes()` and `proofs()`.

    A row's leaf is the digest of id, group and the other fields in the order given. In its group it
    stands by id (nulls first), then by leaf, so equal rows are leaves side by side. Null is a group of
    its own, before all others, which follow bytewise. Texts may be of any length: digests only leave the
    scan. An empty table has no rows, and the root is the digest of nothing. Columns that aren't named take no part;
    those in `keep` come back beside the proofs.
    """

    def __init__(self, rows: DataFrame, *, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), keep: dict[str, Column] | None = None):
        self.space, self.kept = Workspace(rows.sparkSession, "merkle"), list(keep or {})
        tree = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))  # "" is null; the sign keeps the order
        kept = F.struct(*(c.alias(k) for k, c in (keep or {"none": F.lit(None).cast("int")}).items()))
        leaves = self.space.table(rows.select(F.col(id_col).alias("id"), tree.alias("tree"), leaf_digest(*(F.col(f) for f in fields)).alias("hash"), kept.alias("kept")))
        placed = ordered(self.space, leaves, "tree", [F.col("id").asc_nulls_first(), F.col("hash")], "idx")
        sizes = self.space.table(leaves.groupBy("tree").agg(F.count("*").alias("n")))
        total, self.trees = (x or 0 for x in sizes.agg(F.sum("n"), F.count("*")).first())
        self._leaves = self.space.table(join_groups(placed, sizes, ["tree"], "n", total))
        self.space.drop(leaves)
        self._forest = Forest(self.space, self._leaves)
        subroots = self.space.table(self._forest.roots())
        tops = ordered(self.space, subroots.select(F.lit("").alias("all"), F.col("tree").alias("of"), "hash"), "all", [F.col("of")], "idx")
        self._subroots = self.space.table(tops.select(F.lit("").alias("tree"), "idx", F.lit(self.trees).cast("long").alias("n"), "hash", "of"))
        self._top = Forest(self.space, self._subroots)
        root = self._top.roots().first()
        self.root = root.hash.hex() if root else hashlib.sha256().hexdigest()

    @property
    def sources(self) -> DataFrame:
        """source, place, n_rows, subroot."""
        sizes = self._leaves.where("idx = 0").select(F.col("tree").alias("of"), F.col("n").alias("n_rows"))
        return self._subroots.join(sizes, "of").select(F.when(F.col("of") != "", F.expr("substring(of, 2)")).alias("source"), F.col("idx").alias("place"), "n_rows", _hex("hash").alias("subroot"))

    def nodes(self) -> DataFrame:
        """source (null also in the tree on top), top, level, place, digest: the whole manifest as one table."""
        out = None
        for top, forest in ((False, self._forest), (True, self._top)):
            for k, level in enumerate(forest.levels):
                if top and not k:
                    continue  # the subroots are there already
                one = level.select(F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias("source"), F.lit(top).alias("top"), F.lit(k).alias("level"), F.col("idx").alias("place"), _hex("hash").alias("digest"))
                out = one if out is None else out.unionByName(one)
        return out

    def proofs(self) -> DataFrame:
        """id, the kept columns, leaf, subroot and proof (binary), place and n_rows in the source's tree, top and tops: the source's place in the tree on top and the number of sources."""
        space = self.space
        none = self._top.levels[0].limit(1).select("tree", F.lit(b"").alias("proof"))
        above = self._top.pushed(none).select("idx", F.col("proof").alias("proof"))
        above = space.table(above.join(self._subroots.select("idx", F.col("of").alias("tree"), F.col("hash").alias("subroot")), "idx").select("tree", "proof", F.col("idx").alias("top"), "subroot"))
        proofs = self._forest.pushed(above)
        leaves = self._leaves.select("id", "kept", "tree", "idx", F.col("hash").alias("leaf"), "n")
        out = leaves.join(proofs, ["tree", "idx"])
        return out.select("id", *(F.col(f"kept.{k}").alias(k) for k in self.kept), "leaf", "subroot", "proof", F.col("idx").alias("place"), F.col("n").alias("n_rows"), "top", F.lit(self.trees).cast("long").alias("tops"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    hurt = leaf_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), F.replace("text", F.lit("\n"), F.lit("")))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, hurt)
    manifest = Manifest(docs, keep={"tampered": tampered})
    rows = manifest.proofs()
    back = folded(F.coalesce("tampered", "leaf"))
    rows = rows.select("id", "leaf", "subroot", F.sha2(_hex("proof"), 256).alias("proof_sha256"), back.alias("folded_root"))
    return rows.select(F.col("id").alias("doc_id"), _hex("leaf").alias("leaf"), _hex("subroot").alias("subroot"), F.lit(manifest.root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == manifest.root).alias("verified"))


def _leaf(text: str) -> str:
    """SQL for a document's leaf, its text being the expression given."""
    return "sha256(" + " || ".join(f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


ORACLE = f"""
WITH RECURSIVE crc_t AS MATERIALIZED (SELECT {CRC_TABLE} AS t),
d AS (SELECT doc_id, coalesce('+' || source, '') AS tree, {_leaf("text")} AS leaf, CASE WHEN {crc("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS hurt FROM documents, crc_t),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d),
up AS (
  SELECT tree, 0 AS level, idx, n, leaf AS hash, [leaf] AS kids FROM l
  UNION ALL
  SELECT tree, any_value(level) + 1, idx // 3, any_value((n + 2) // 3), sha256(string_agg(hash, '' ORDER BY idx)), list(hash ORDER BY idx) FROM up WHERE n > 1 GROUP BY tree, idx // 3
),
s AS MATERIALIZED (SELECT tree, hash, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, idx, n, hash, [hash] AS kids FROM s
  UNION ALL
  SELECT any_value(level) + 1, idx // 3, any_value((n + 2) // 3), sha256(string_agg(hash, '' ORDER BY idx)), list(hash ORDER BY idx) FROM top WHERE n > 1 GROUP BY idx // 3
),
u AS MATERIALIZED (SELECT * FROM up), v AS MATERIALIZED (SELECT * FROM top),
walk AS (
  SELECT tree, idx AS leaf_idx, false AS high, 0 AS level, idx, n, '' AS proof, coalesce(hurt, leaf) AS digest FROM l
  UNION ALL
  SELECT w.tree, leaf_idx, CASE WHEN NOT high AND w.n = 1 THEN true ELSE high END, CASE WHEN NOT high AND w.n = 1 THEN 0 ELSE w.level + 1 END,
    CASE WHEN NOT high AND w.n = 1 THEN s.idx ELSE w.idx // 3 END, CASE WHEN NOT high AND w.n = 1 THEN s.n ELSE (w.n + 2) // 3 END,
    proof || CASE WHEN w.n = 1 THEN '' ELSE array_to_string(list_concat(k.kids[:w.idx % 3], k.kids[w.idx % 3 + 2:]), '') END,
    CASE WHEN w.n = 1 THEN digest ELSE sha256(array_to_string(list_concat(list_concat(k.kids[:w.idx % 3], [digest]), k.kids[w.idx % 3 + 2:]), '')) END
  FROM walk w LEFT JOIN s ON s.tree = w.tree
  LEFT JOIN (SELECT tree, false AS top, level, idx, kids FROM u UNION ALL SELECT '' AS tree, true, level, idx, kids FROM v) k
    ON k.top = w.high AND k.tree = CASE WHEN w.high THEN '' ELSE w.tree END AND k.level = w.level + 1 AND k.idx = w.idx // 3
  WHERE NOT (w.high AND w.n = 1)
)
SELECT l.doc_id, l.leaf, s.hash AS subroot, r.hash AS root, sha256(w.proof) AS proof_sha256, w.digest AS folded_root, w.digest = r.hash AS verified
FROM l JOIN walk w ON w.tree = l.tree AND w.leaf_idx = l.idx AND w.high AND w.n = 1 JOIN s ON s.tree = l.tree, (SELECT hash FROM v WHERE n = 1) r
"""
