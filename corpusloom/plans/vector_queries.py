"""Vector, placement, evaluation and discovery queries, on embeddings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import discover, evaluate, gate, placement
from .registry import _vectors, query, sql, table

RULES = placement.Rules(tau={"long": 0.2, "short": 0.15}, g={3: 0.2, 5: 0.3, 8: 0.35}, delta=0.1, cap=3)

_BASE = """
WITH v AS (SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN 'short' ELSE 'long' END AS kind, embedding::DOUBLE[] AS vec FROM embeddings),
m AS (SELECT list(x ORDER BY i) AS mean FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(vec) AS x, unnest(range(64)) AS i FROM v) GROUP BY i)),
d AS (SELECT vec_id, label, kind, list_transform(list_zip(vec, mean), lambda z: z[1] - z[2]) AS vec FROM v, m),
c AS (SELECT vec_id, label, kind, CASE WHEN list_dot_product(vec, vec) = 0 THEN vec ELSE list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) END AS vec FROM d),
s AS (SELECT vec_id, label AS theme FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM v) WHERE r <= 3 + label % 6),
tm AS (SELECT theme, i, avg(x) AS x FROM (SELECT theme, unnest(vec) AS x, unnest(range(64)) AS i FROM s JOIN c USING (vec_id)) GROUP BY ALL),
tu AS (SELECT theme, list(x ORDER BY i) AS vec FROM tm GROUP BY theme),
t AS (SELECT theme, (SELECT count(*) FROM s WHERE s.theme = tu.theme) AS k, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec FROM tu),
sims AS (SELECT c.vec_id, c.kind, t.theme, t.k, list_dot_product(c.vec, t.vec) AS sim, s.vec_id IS NOT NULL AS seed FROM c CROSS JOIN t LEFT JOIN s ON s.vec_id = c.vec_id AND s.theme = t.theme),
r1 AS (SELECT *, CASE kind WHEN 'long' THEN 0.2 ELSE 0.15 END + CASE WHEN k >= 7 THEN 0.35 - 0.3 ELSE 0.0 END AS thr, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, theme) AS rank, max(sim) OVER (PARTITION BY vec_id) AS best, count(*) FILTER (WHERE seed) OVER (PARTITION BY vec_id) AS n_seeds FROM sims),
r2 AS (SELECT *, min(rank) FILTER (WHERE sim >= thr) OVER (PARTITION BY vec_id) AS first FROM r1),
r3 AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY seed DESC, rank) AS turn FROM r2 WHERE seed OR (n_seeds = 0 AND rank = first) OR (sim >= thr AND best - sim <= 0.1)),
p AS (SELECT vec_id, theme, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, rank) AS position, round(sim, 4) AS sim, round(best, 4) AS best, CASE WHEN n_seeds > 0 THEN 'seed' ELSE 'placed' END AS role FROM r3 WHERE turn <= greatest(3, n_seeds))
"""


def _parts(spark, sf):
    """(centred vectors, seeds, themes)"""
    from pyspark.sql.window import Window

    v = _vectors(spark, sf).withColumn("kind", F.when(F.col("vec_id") % 3 == 0, "short").otherwise("long"))
    mean = _mean(v)
    c = placement.centred(v, mean)
    first = Window.partitionBy("label").orderBy("vec_id")
    seeds = v.withColumn("r", F.row_number().over(first)).where(F.col("r") <= 3 + F.col("label") % 6).select("vec_id", F.col("label").alias("theme"))
    return c, seeds, placement.theme_vectors(c, seeds)


def _mean(v):
    return vx.mean_by(v.withColumn("_all", F.lit(1)), ["_all"], "vec").drop("_all")


def _sims(spark, sf):
    c, seeds, themes = _parts(spark, sf)
    sims = placement.similarities(c, themes)
    return sims.join(seeds.withColumn("seed", F.lit(True)), ["vec_id", "theme"], "left").withColumn("seed", F.coalesce("seed", F.lit(False)))


def _placed(spark, sf):
    return placement.place(_sims(spark, sf), RULES)


query("w02_place_top3", _BASE + "SELECT vec_id, theme, position, sim, best, role FROM p")(
    lambda spark, sf: _placed(spark, sf).select("vec_id", "theme", F.col("position").cast("long").alias("position"), F.round("sim", 4).alias("sim"), F.round("best", 4).alias("best"), "role")
)
query("agg26_roles", _BASE + "SELECT role, count(*) AS n FROM (SELECT c.vec_id, CASE WHEN q.role IS NULL THEN CASE WHEN c.vec_id % 11 = 0 THEN 'subjectless' ELSE 'none' END WHEN q.role = 'placed' AND c.vec_id % 11 = 0 THEN 'subjectless' ELSE q.role END AS role FROM c LEFT JOIN (SELECT DISTINCT vec_id, role FROM p) q USING (vec_id)) GROUP BY role")(
    lambda spark, sf: placement.roles(_placed(spark, sf), table(spark, sf, "embeddings"), table(spark, sf, "embeddings").where("vec_id % 11 = 0")).groupBy("role").agg(F.count("*").alias("n"))
)


@query("agg11_coverage", _BASE + ", n AS (SELECT c.vec_id, count(p.theme) AS k FROM c LEFT JOIN p USING (vec_id) GROUP BY c.vec_id), b AS (SELECT max(n) AS top FROM (SELECT count(*) AS n FROM p GROUP BY theme)) SELECT round(avg(CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(k), 6) AS mean_themes, round(max(top) / count(*)::DOUBLE, 6) AS largest_share FROM n, b")
def coverage(spark, sf):
    p = _placed(spark, sf)
    n = table(spark, sf, "embeddings").select("vec_id").join(p.groupBy("vec_id").agg(F.count("*").alias("k")), "vec_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    top = p.groupBy("theme").agg(F.count("*").alias("n")).agg(F.max("n").alias("top"))
    return n.crossJoin(F.broadcast(top)).agg(F.round(F.avg((F.col("k") > 0).cast("double")), 6).alias("coverage"), F.round(F.avg("k"), 6).alias("mean_themes"), F.round(F.max("top") / F.count("*"), 6).alias("largest_share"))


query("j04_theme_vectors", _BASE + "SELECT theme, k, round(vec[1], 8) AS x1, round(vec[64], 8) AS x64, round(list_dot_product(vec, vec), 8) AS norm2 FROM t")(
    lambda spark, sf: _parts(spark, sf)[2].select("theme", "k", F.round(F.col("vec")[0], 8).alias("x1"), F.round(F.col("vec")[63], 8).alias("x64"), F.round(vx.dot(F.col("vec"), F.col("vec")), 8).alias("norm2"))
)
query("j05_similarities", _BASE + "SELECT vec_id, theme, round(sim, 8) AS sim, seed FROM sims")(lambda spark, sf: _sims(spark, sf).select("vec_id", "theme", F.round("sim", 8).alias("sim"), "seed"))
query("f60_unit", "SELECT vec_id, round(list_dot_product(u, u), 6) AS norm2, round(u[1], 8) AS x1 FROM (SELECT vec_id, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS u FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3) AS w FROM embeddings))")(
    lambda spark, sf: _vectors(spark, sf).select("vec_id", vx.unit(F.transform("vec", lambda x: x * 3)).alias("u")).select("vec_id", F.round(vx.dot(F.col("u"), F.col("u")), 6).alias("norm2"), F.round(F.col("u")[0], 8).alias("x1"))
)
query("f61_cosine_to_next", "SELECT vec_id, round(list_cosine_similarity(vec, lead(vec) OVER (PARTITION BY label ORDER BY vec_id)), 8) AS cosine FROM @vectors")(
    lambda spark, sf: _next_cosine(spark, sf)
)


def _next_cosine(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("label").orderBy("vec_id")
    rows = _vectors(spark, sf).withColumn("after", F.lead("vec").over(w))
    return rows.select("vec_id", F.round(vx.dot(F.col("vec"), F.col("after")) / (vx.norm(F.col("vec")) * vx.norm(F.col("after"))), 8).alias("cosine"))


query("f62_centre", _BASE + "SELECT vec_id, round(vec[1], 8) AS x1, round(list_sum(vec), 8) AS total FROM c")(
    lambda spark, sf: _parts(spark, sf)[0].select("vec_id", F.round(F.col("vec")[0], 8).alias("x1"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 8).alias("total"))
)
query("f63_threshold", "SELECT k, kind, CASE kind WHEN 'long' THEN 0.2::DOUBLE ELSE 0.15::DOUBLE END + CASE WHEN k >= 7 THEN 0.35::DOUBLE - 0.3::DOUBLE ELSE 0.0::DOUBLE END AS threshold FROM (SELECT DISTINCT 3 + label % 6 AS k, CASE WHEN vec_id % 3 = 0 THEN 'short' ELSE 'long' END AS kind FROM embeddings)")(
    lambda spark, sf: table(spark, sf, "embeddings").select((3 + F.col("label") % 6).alias("k"), F.when(F.col("vec_id") % 3 == 0, "short").otherwise("long").alias("kind")).distinct().withColumn("threshold", RULES.threshold_column(F.col("k"), F.col("kind")))
)
query("f65_drift", "SELECT label, round(max(list_max(list_transform(range(1, 65), lambda i: abs(a[i] - b[i])))), 8) AS most_drift FROM (SELECT label, vec AS a, lead(vec) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM @vectors) GROUP BY label")(lambda spark, sf: _drift(spark, sf))


def _drift(spark, sf):
    from pyspark.sql.window import Window

    rows = _vectors(spark, sf).withColumn("after", F.lead("vec").over(Window.partitionBy("label").orderBy("vec_id")))
    return rows.groupBy("label").agg(F.round(F.max(vx.drift(F.col("vec"), F.col("after"))), 8).alias("most_drift"))


query("f34_mixture", "SELECT vec_id, round(list_sum(list_transform(a, lambda x: x / list_sum(a))), 6) AS total, round(a[1] / list_sum(a), 8) AS x1 FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: abs(x)) AS a FROM embeddings)")(
    lambda spark, sf: _vectors(spark, sf).select("vec_id", vx.mixture(F.transform("vec", F.abs)).alias("u")).select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.col("u")[0], 8).alias("x1"))
)


@query("f35_labels_above", "SELECT vec_id, i AS column_id, round(x, 8) AS strength, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS position FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings) WHERE x >= 0.25")
def labels_above(spark, sf):
    pairs = F.transform("vec", lambda x, i: F.struct((-x).alias("minus"), i.alias("i")))
    kept = F.array_sort(F.filter(pairs, lambda p: p["minus"] <= -0.25))
    rows = _vectors(spark, sf).select("vec_id", F.posexplode(kept).alias("k", "p"))
    return rows.select("vec_id", F.col("p.i").cast("long").alias("column_id"), F.round(-F.col("p.minus"), 8).alias("strength"), (F.col("k") + 1).cast("long").alias("position"))


@query("f36_label_set", "SELECT vec_id, count(*) AS n, sum(i)::BIGINT AS id_sum FROM (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM (SELECT vec_id, x, i, max(x) OVER (PARTITION BY vec_id) AS top FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings)) WHERE x >= 0.5 * top) WHERE r <= 3 GROUP BY vec_id")
def label_set(spark, sf):
    """The strongest column first, others of half its strength or more, three at most."""
    pairs = F.array_sort(F.transform("vec", lambda x, i: F.struct((-x).alias("minus"), i.alias("i"))))
    kept = F.slice(F.filter("pairs", lambda p: p["minus"] <= 0.5 * F.col("pairs")[0]["minus"]), 1, 3)
    rows = _vectors(spark, sf).select("vec_id", pairs.alias("pairs")).select("vec_id", kept.alias("kept"))
    return rows.select("vec_id", F.size("kept").cast("long").alias("n"), F.aggregate("kept", F.lit(0).cast("long"), lambda s, p: s + p["i"]).alias("id_sum"))


query("f37_probability_columns", "SELECT DISTINCT label AS column_id FROM embeddings WHERE label > 0")(lambda spark, sf: table(spark, sf, "embeddings").where("label > 0").select(F.col("label").alias("column_id")).distinct())


@query("f64_pool_chunks", r"SELECT doc_id, round(avg(n), 6) AS mean_length, count(*) AS n_chunks FROM (SELECT doc_id, length(array_to_string(w[k * 80 + 1 : k * 80 + 80], ' ')) AS n FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents), unnest(range(CAST(ceil(len(w) / 80.0) AS BIGINT))) AS t(k)) GROUP BY doc_id")
def pool_chunks(spark, sf):
    """Chunk, encode, pool: here with the stand-in encoder whose first number is the chunk's length."""
    pieces = table(spark, sf, "documents").select("doc_id", F.explode(tx.chunk_texts(F.col("text"), 80)).alias("piece"))
    ws = F.regexp_extract_all("piece", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = pieces.select("doc_id", encode(F.array_join(ws, " ")).alias("vec"))
    pooled = vx.mean_by(rows, ["doc_id"], "vec")
    return pooled.join(rows.groupBy("doc_id").agg(F.count("*").alias("n_chunks")), "doc_id").select("doc_id", F.round(F.col("mean")[0], 6).alias("mean_length"), "n_chunks")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def encode(s: pd.Series) -> pd.Series:
    """A stand-in for a sentence encoder: (length, first code point, 1)."""
    return s.map(lambda x: [float(len(x)), float(ord(x[0])) if x else 0.0, 1.0])


query("f68_encode_cached", "SELECT sha256(text) AS text_sha, min(length(text))::DOUBLE AS x1 FROM documents WHERE lang <> 'en' AND text NOT IN (SELECT text FROM documents WHERE lang = 'en') GROUP BY text")(lambda spark, sf: _encode_missing(spark, sf))


def _encode_missing(spark, sf):
    """Only texts that the cache lacks reach the encoder, each distinct one once."""
    docs = table(spark, sf, "documents").withColumn("text_sha", F.sha2("text", 256))
    cache = docs.where("lang = 'en'").select("text_sha").distinct()
    fresh = docs.where("lang <> 'en'").dropDuplicates(["text_sha"]).join(cache, "text_sha", "left_anti")
    return fresh.select("text_sha", encode("text")[0].alias("x1"))


# --- evaluation -------------------------------------------------------------------------------

query("j06_neighbours", "SELECT vec_id, rank, near, round(sim, 6) AS sim FROM (SELECT a.vec_id, b.vec_id AS near, list_dot_product(a.vec, b.vec) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.vec, b.vec), 12) DESC, b.vec_id) AS rank FROM @vectors a JOIN @vectors b ON a.vec_id <> b.vec_id) WHERE rank <= 5")(
    lambda spark, sf: evaluate.neighbours(_vectors(spark, sf)).select("vec_id", F.col("rank").cast("long").alias("rank"), "near", F.round("sim", 6).alias("sim"))
)
query("agg21_knn_agreement", "SELECT round(avg(share), 6) AS agreement, count(*) AS n FROM (SELECT vec_id, avg(CASE WHEN la = lb THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT a.vec_id, a.label AS la, b.label AS lb, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.vec, b.vec), 12) DESC, b.vec_id) AS rank FROM @vectors a JOIN @vectors b ON a.vec_id <> b.vec_id) WHERE rank <= 5 GROUP BY vec_id)")(
    lambda spark, sf: evaluate.knn_agreement(_vectors(spark, sf)).select(F.round("agreement", 6).alias("agreement"), "n")
)

_BCUBED_ITEMS = "(SELECT d.doc_id AS key, CASE WHEN d.doc_id % 5 = 0 THEN []::VARCHAR[] WHEN d.doc_id % 5 < 3 THEN [d.lang] ELSE [d.lang, d.source] END AS pred, ['q' || l.quality, 's' || (d.n_chars % 4)] AS gold FROM documents d JOIN labels l USING (doc_id))"


def _bcubed_items(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    pred = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 5 < 3, F.array("lang")).otherwise(F.array("lang", "source"))
    gold = F.when(F.col("quality").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("q"), "quality"), F.concat(F.lit("s"), F.col("n_chars") % 4)))
    return d.select(F.col("doc_id").alias("key"), pred.alias("pred"), gold.alias("gold"))


_BCUBED = f"""
WITH i AS (SELECT * FROM {_BCUBED_ITEMS}),
pr AS (SELECT a.key, len(list_intersect(a.pred, b.pred)) AS sp, len(list_intersect(a.gold, b.gold)) AS sg FROM i a JOIN i b ON len(list_intersect(a.pred, b.pred)) > 0 OR len(list_intersect(a.gold, b.gold)) > 0),
p AS (SELECT i.key, coalesce(avg(least(sp, sg) / sp::DOUBLE) FILTER (WHERE sp > 0), 1.0) AS p, coalesce(avg(least(sp, sg) / sg::DOUBLE) FILTER (WHERE sg > 0), 1.0) AS r FROM i JOIN pr USING (key) GROUP BY i.key)
SELECT round(avg(p), 8) AS precision, round(avg(r), 8) AS recall, round(2 * avg(p) * avg(r) / (avg(p) + avg(r)), 8) AS f, count(*) AS n FROM p"""
query("agg18_bcubed", _BCUBED)(lambda spark, sf: evaluate.bcubed(_bcubed_items(spark, sf)).select(F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"), F.round("f", 8).alias("f"), "n"))


@query("agg33_baseline_b", _BCUBED.replace("AS pred,", "AS pred0,").replace("WITH i AS (SELECT * FROM", "WITH i AS (SELECT key, list_filter(pred0, lambda x: x <> 'en') AS pred, gold FROM"))
def baseline_b(spark, sf):
    """The same score after genre-like themes are taken out of the prediction."""
    items = _bcubed_items(spark, sf).withColumn("pred", F.array_except("pred", F.array(F.lit("en"))))
    return evaluate.bcubed(items).select(F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"), F.round("f", 8).alias("f"), "n")


_SCORES = "(SELECT label, sqrt(abs(embedding[1]::DOUBLE)) AS a, sqrt(abs(embedding[2]::DOUBLE)) AS b FROM embeddings)"


def _pairs(spark, sf):
    return _vectors(spark, sf).select("label", F.sqrt(F.abs(F.col("vec")[0])).alias("a"), F.sqrt(F.abs(F.col("vec")[1])).alias("b"))


@query("agg19_paired_bootstrap", None)
def paired_bootstrap(spark, sf):
    """The placement of agg18 against the one without genre-like themes, on the same resamples."""
    items = _bcubed_items(spark, sf).select(F.array_except("pred", F.array(F.lit("en"))).alias("a"), F.col("pred").alias("b"), "gold")
    return evaluate.paired_bootstrap(items)


def _halves(spark, sf):
    """The items of agg18 as rows (held out) and pages, and of each those whose themes are known beforehand."""
    items = _bcubed_items(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "source"), "key").withColumn("new", F.col("pred"))
    test = tx.split_of(F.col("key").cast("string")) == "test"
    posts = items.where("key % 7 = 0").withColumn("expected", F.array("source"))
    return items.where(test), items.where(~test), posts.where(test), posts.where(~test)


@query("job05_gate", None)
def release_gate(spark, sf):
    """The held-out half of the items of agg18, with the other half as pages; the baseline is each item's language alone."""
    rows, pages, posts, _ = _halves(spark, sf)
    return gate.gate(rows.select("new", F.slice("pred", 1, 1).alias("base"), "gold"), ["en"], pages=pages, posts=posts, forbidden=["de"])


_HALVES = """
WITH i AS (SELECT doc_id AS key, source, CASE WHEN doc_id % 5 = 0 THEN []::VARCHAR[] WHEN doc_id % 5 < 3 THEN [lang] ELSE [lang, source] END AS new, CASE WHEN ('0x' || right(sha1(doc_id::VARCHAR), 1))::INT % 2 = 0 THEN 'pages' ELSE 'rows' END AS half FROM documents),
c AS (SELECT half, max(c) AS top FROM (SELECT half, t, count(*) AS c FROM (SELECT half, unnest(new) AS t FROM i) GROUP BY ALL) GROUP BY half)
SELECT half, round(avg(CASE WHEN len(new) > 0 THEN 1.0 ELSE 0.0 END), 8) AS coverage, round(avg(len(new)), 8) AS mean_themes, round(any_value(top) / count(*)::DOUBLE, 8) AS largest_share,
  count(*) FILTER (WHERE key % 7 = 0) AS n_posts, count(*) FILTER (WHERE key % 7 = 0 AND (list_contains(new, 'de') OR len(new) > 0 AND NOT list_contains(new, source))) AS bad_posts
FROM i JOIN c USING (half) GROUP BY half"""


@query("job05_limits", _HALVES)
def release_limits(spark, sf):
    """What the gate limits by class, and what it knows beforehand."""
    rows, pages, posts, page_posts = _halves(spark, sf)
    out = None
    for half, items, known in (("rows", rows, posts), ("pages", pages, page_posts)):
        judged = gate.named_posts(known, ["de"]).agg(F.count("*").alias("n_posts"), F.count_if(~F.col("ok")).alias("bad_posts"))
        figures = [F.round(c, 8).alias(c) for c in ("coverage", "mean_themes", "largest_share")]
        one = gate.spread(items, "new").crossJoin(judged).select(F.lit(half).alias("half"), *figures, "n_posts", "bad_posts")
        out = one if out is None else out.unionByName(one)
    return out


query("agg20_paired_mean_delta", None)(lambda spark, sf: evaluate.paired_mean_delta(_pairs(spark, sf), ["label"]))
query("agg34_variant_delta", f"SELECT label, round(avg(b - a), 8) AS delta, avg(b - a) >= 0.03 AS clears, count(*) AS n FROM {_SCORES} GROUP BY label")(
    lambda spark, sf: _pairs(spark, sf).groupBy("label").agg(F.round(F.avg(F.col("b") - F.col("a")), 8).alias("delta"), (F.avg(F.col("b") - F.col("a")) >= 0.03).alias("clears"), F.count("*").alias("n"))
)
query("agg14_mean_vector", "SELECT i, round(avg(x), 8) AS mean FROM (SELECT unnest(vec) AS x, unnest(range(64)) AS i FROM @vectors) GROUP BY i")(lambda spark, sf: _mean(_vectors(spark, sf)).select(F.posexplode("mean").alias("i", "mean")).select(F.col("i").cast("long").alias("i"), F.round("mean", 8).alias("mean")))
query("agg15_centroids", "SELECT label, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 8) AS x FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(vec) AS x, unnest(range(64)) AS i FROM @vectors) GROUP BY ALL)")(
    lambda spark, sf: vx.mean_by(_vectors(spark, sf), ["label"], "vec").select("label", F.posexplode(vx.unit(F.col("mean"))).alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 8).alias("x"))
)
sql("agg16_median", "SELECT event_type, median(value) AS middle FROM @events GROUP BY event_type")
sql("agg17_percentiles", "SELECT event_type, round(percentile(value, 0.025), 8) AS low, round(percentile(value, 0.975), 8) AS high FROM @events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.025), 8) AS low, round(quantile_cont(value, 0.975), 8) AS high FROM @events GROUP BY event_type")


@query("agg22_seed_count_curve", None)
def seed_count_curve(spark, sf):
    """Median similarity of a group's members to the mean of k random seeds of it, by k."""
    import numpy as np

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("vec_id").vec.to_numpy())
        rng, out = np.random.default_rng(42), []
        for k in (3, 4, 5, 6, 8):
            if len(x) > k:
                sims = []
                for _ in range(20):
                    pick = rng.permutation(len(x))
                    m = x[pick[:k]].mean(axis=0)
                    sims.append(np.median((x @ (m / max(1e-12, np.linalg.norm(m))))[pick[k:]]))
                out.append((int(pdf.label.iloc[0]), k, float(np.mean(sims))))
        return pd.DataFrame(out, columns=["label", "k", "g"])

    return _vectors(spark, sf).groupBy("label").applyInPandas(run, "label long, k int, g double").groupBy("k").agg(F.avg("g").alias("g"))


query("j07_group_pairs", "SELECT a.label, count(*) AS n, round(sum(list_dot_product(a.vec, b.vec)), 4) AS total FROM @vectors a JOIN @vectors b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label")(lambda spark, sf: _pair_sums(spark, sf))


def _pair_sums(spark, sf):
    """Sums over all pairs of a group from sums over its rows: |sum v|^2 = sum |v|^2 + 2 sum of pairs."""
    v = _vectors(spark, sf)
    sums = v.select("label", F.posexplode("vec").alias("k", "x")).groupBy("label", "k").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    n = v.groupBy("label").agg(F.count("*").alias("m"))
    return sums.groupBy("label").agg(F.round((F.sum(F.col("s") * F.col("s")) - F.sum("q")) / 2, 4).alias("total")).join(n, "label").select("label", (F.col("m") * (F.col("m") - 1) / 2).cast("long").alias("n"), "total")


query("agg23_cohesion_threshold", "SELECT round(1 - median(list_dot_product(a.vec, b.vec)), 8) AS threshold, count(*) AS n FROM @vectors a JOIN @vectors b ON a.label = b.label AND a.vec_id < b.vec_id")(
    lambda spark, sf: evaluate.cohesion_threshold(_vectors(spark, sf)).select(F.round("threshold", 8).alias("threshold"), "n")
)


_NEAREST = "SELECT vec_id, theme, rank FROM (SELECT vec_id, theme, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 10) DESC, theme) AS rank FROM sims) WHERE rank <= 3"


@query("w05_nearest_themes", _BASE + _NEAREST)
def nearest_themes(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("vec_id").orderBy(F.desc(F.round("sim", 10)), "theme")
    return _sims(spark, sf).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("vec_id", "theme", "rank")


@query("w04_strongest_members", _BASE + "SELECT theme, vec_id, rank FROM (SELECT theme, vec_id, row_number() OVER (PARTITION BY theme ORDER BY sim DESC, vec_id) AS rank FROM p) WHERE rank <= 6")
def strongest_members(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("theme").orderBy(F.desc("s"), "vec_id")
    return _placed(spark, sf).withColumn("s", F.round("sim", 4)).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 6").select("theme", "vec_id", "rank")


@query("w07_seed_candidates", _BASE + "SELECT theme, vec_id, rank FROM (SELECT theme, vec_id, row_number() OVER (PARTITION BY theme ORDER BY sim DESC, vec_id) AS rank FROM p WHERE role <> 'seed') WHERE rank <= 4")
def seed_candidates(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("theme").orderBy(F.desc("s"), "vec_id")
    return _placed(spark, sf).where("role <> 'seed'").withColumn("s", F.round("sim", 4)).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 4").select("theme", "vec_id", "rank")


@query("w06_central_members", _BASE + ", g AS (SELECT label, list(x ORDER BY i) AS mean FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(vec) AS x, unnest(range(64)) AS i FROM c) GROUP BY ALL) GROUP BY label) SELECT label, vec_id, rank FROM (SELECT c.label, c.vec_id, row_number() OVER (PARTITION BY c.label ORDER BY round(list_dot_product(c.vec, g.mean), 10) DESC, c.vec_id) AS rank FROM c JOIN g USING (label)) WHERE rank <= 3")
def central_members(spark, sf):
    from pyspark.sql.window import Window

    c = _parts(spark, sf)[0]
    rows = c.join(F.broadcast(vx.mean_by(c, ["label"], "vec")), "label").withColumn("s", F.round(vx.dot(F.col("vec"), F.col("mean")), 10))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("s"), "vec_id")).cast("long")).where("rank <= 3").select("label", "vec_id", "rank")


query("f67_average_linkage", None)(lambda spark, sf: discover.groups(_vectors(spark, sf).select("label", "vec_id", "vec"), 0.9, 2))


@query("agg12_topic_summary", "SELECT count(DISTINCT label) FILTER (WHERE label > 0) AS n_topics, round(avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END), 6) AS outliers, (SELECT round(max(n) / sum(n)::DOUBLE, 6) FROM (SELECT count(*) AS n FROM embeddings WHERE label > 0 GROUP BY label)) AS largest FROM embeddings")
def topic_summary(spark, sf):
    e = table(spark, sf, "embeddings")
    largest = e.where("label > 0").groupBy("label").agg(F.count("*").alias("n")).agg(F.round(F.max("n") / F.sum("n"), 6).alias("largest"))
    return e.agg(F.count_distinct(F.when(F.col("label") > 0, F.col("label"))).alias("n_topics"), F.round(F.avg((F.col("label") == 0).cast("double")), 6).alias("outliers")).crossJoin(largest)


@query("j08_shared_label_classes", None)
def shared_label_classes(spark, sf):
    """Pairs of items with a shared label, counted by class of label sets instead of listed."""
    items = _bcubed_items(spark, sf)
    kinds = items.groupBy(F.array_sort("pred").alias("p")).agg(F.count("*").alias("n")).withColumn("c", F.xxhash64("p"))
    one = kinds.select("c", F.explode("p").alias("label"), "n")
    pairs = one.join(one.select(F.col("c").alias("c2"), "label", F.col("n").alias("n2")), "label").dropDuplicates(["c", "c2"])
    return pairs.groupBy("c").agg(F.max("n").alias("n_items"), F.sum("n2").alias("n_partners"))
