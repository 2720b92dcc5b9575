"""Composed jobs: moves between placements, discovery of themes, tuning, the release check, keywords in order of arrival."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions import text as tx
from ..operators import discover, evaluate, integrity, moves, placement, tune
from ..operators.lineage import parts_for, scratch
from ..streaming.keywords import KeywordLog
from .registry import _doc_labels, query, table
from .vector_queries import _BASE, RULES, _parts

# --- moves ------------------------------------------------------------------------------------

#: A log of renames from the orders: each renames the theme of its customer to another number's.
_LOG = """(SELECT o_orderkey AS "at", 'c' || o_custkey AS old, 'c' || xor(o_custkey, o_orderkey & 255) AS new FROM orders)"""
#: Each entry with the entry that follows it, and the end of its chain.
_CHAINS = f"""
log AS MATERIALIZED (SELECT * FROM {_LOG}),
follow AS MATERIALIZED (SELECT a."at", min(b."at") AS next FROM log a LEFT JOIN log b ON b.old = a.new AND b."at" > a."at" GROUP BY a."at"),
chain AS (SELECT "at", next, "at" AS last FROM follow UNION ALL SELECT c."at", f.next, c.next FROM chain c JOIN follow f ON f."at" = c.next),
final AS MATERIALIZED (SELECT c."at", e.new AS final FROM chain c JOIN log e ON e."at" = c.last WHERE c.next IS NULL)"""


def _log(spark, sf):
    o = table(spark, sf, "orders")
    name = lambda c: F.concat(F.lit("c"), c)
    return o.select(F.col("o_orderkey").alias("at"), name(F.col("o_custkey")).alias("old"), name(F.col("o_custkey").bitwiseXOR(F.col("o_orderkey").bitwiseAND(F.lit(255)))).alias("new"))


@query("j12_rename_history", f"""WITH RECURSIVE {_CHAINS} SELECT log."at", old, new, final FROM log JOIN final USING ("at")""")
def rename_history(spark, sf):
    """Each rename, and the name that its theme bears after all later ones."""
    return moves.replayed(_log(spark, sf))


_OLD = """(SELECT doc_id, doc_id * 7 AS "at", unnest(['c' || (doc_id % 1500), 'c' || (n_chars % 1500)][1:doc_id % 3]) AS name FROM documents)"""
_MOVES = f"""
WITH RECURSIVE {_CHAINS},
recorded AS (SELECT * FROM {_OLD}),
now AS (SELECT r.doc_id, r.name, coalesce(final, r.name) AS current FROM (SELECT doc_id, name, min(log."at") AS next FROM recorded r LEFT JOIN log ON log.old = r.name AND log."at" > r."at" GROUP BY ALL) r LEFT JOIN final ON final."at" = r.next),
o AS (SELECT doc_id, list_sort(list_distinct(list(current))) AS old FROM now GROUP BY doc_id),
s AS (SELECT d.doc_id, source, coalesce(old, []) AS old, n_chars FROM documents d LEFT JOIN o USING (doc_id)),
n AS (SELECT doc_id, source, old, list_sort(CASE n_chars % 6 WHEN 0 THEN old WHEN 1 THEN old[1:1] WHEN 2 THEN [] WHEN 3 THEN list_distinct(list_concat(old, ['t' || n_chars % 5])) ELSE ['t' || n_chars % 7] END) AS new FROM s),
m AS (SELECT *, CASE WHEN old = new THEN CASE WHEN len(old) = 0 THEN 'still none' ELSE 'unchanged' END WHEN len(new) = 0 THEN 'loses all' WHEN len(old) = 0 THEN 'gains'
  WHEN list_has_all(new, old) THEN 'widened' WHEN list_has_all(old, new) THEN 'narrowed' ELSE 'changed' END AS kind FROM n)"""


def _moved(spark, sf):
    """Old themes as recorded at some time and named as they are now, against a new placement."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "source")
    parts = parts_for(spark, d.count())
    names = F.slice(F.array(F.concat(F.lit("c"), F.col("doc_id") % 1500), F.concat(F.lit("c"), F.col("n_chars") % 1500)), F.lit(1), (F.col("doc_id") % 3).cast("int"))
    recorded = d.select("doc_id", (F.col("doc_id") * 7).alias("at"), F.explode(names).alias("name"))
    log = _log(spark, sf)
    every = log.select(F.col("old").alias("name")).union(log.select("new")).union(recorded.select("name"))
    d = d.repartition(parts, "doc_id")
    now = moves.current_names(recorded, log, every).repartition(parts, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_set("current")).alias("themes"))
    named = d.select("doc_id", "n_chars").join(now, "doc_id", "left").withColumn("old", F.coalesce("themes", F.array().cast("array<string>")))
    k, t = F.col("n_chars") % 6, lambda n: F.array(F.concat(F.lit("t"), F.col("n_chars") % n))
    new = F.when(k == 0, F.col("old")).when(k == 1, F.slice("old", 1, 1)).when(k == 2, F.array().cast("array<string>")).when(k == 3, F.array_union("old", t(5))).otherwise(t(7))
    return moves.moves(now, named.select("doc_id", new.alias("themes"))).join(d.select("doc_id", "source"), "doc_id")


@query("job06_moves", _MOVES + " SELECT doc_id, source, array_to_string(old, ',') AS old, array_to_string(new, ',') AS new, kind FROM m")
def moved(spark, sf):
    return _moved(spark, sf).select("doc_id", "source", F.array_join("old", ",").alias("old"), F.array_join("new", ",").alias("new"), "kind")


_ROW = """'{"doc_id":' || doc_id || ',"old":' || to_json(old) || ',"new":' || to_json(new) || ',"kind":"' || kind || '"}'"""


@query("job06_payload", _MOVES + f", b AS (SELECT left(sha256(doc_id::VARCHAR), 3) AS bucket, sha256({_ROW}) AS row FROM m), g AS (SELECT bucket, count(*) AS n, sha256(string_agg(row, '' ORDER BY row)) AS digest FROM b GROUP BY bucket) SELECT sum(n)::BIGINT AS n, sha256(string_agg(digest, '' ORDER BY bucket)) AS digest FROM g")
def payload(spark, sf):
    """The digest by which a list of moves is approved."""
    return moves.payload_digest(_moved(spark, sf), "doc_id", ["doc_id", "old", "new", "kind"])


@query("job06_flow", _MOVES + ", f AS (SELECT unnest(old) AS old, CASE WHEN len(new) = 0 THEN [NULL] ELSE new END AS new FROM m) SELECT old, new, count(*) AS n FROM (SELECT old, unnest(new) AS new FROM f) GROUP BY ALL")
def moved_into(spark, sf):
    return moves.flow(_moved(spark, sf))


@query("job06_by_source", _MOVES + ", r AS (SELECT unnest([source, NULL]) AS source, kind FROM m) SELECT source, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k.replace(' ', '_')}" for k in moves.KINDS) + ", count(*) AS \"all\" FROM r GROUP BY source")
def moved_by_source(spark, sf):
    return moves.by_source(_moved(spark, sf))


# --- discovery, tuning, keywords by arrival ---------------------------------------------------


def _discovered(spark, sf, cut=None):
    """Vectors that no theme takes or whose document is of one source, grouped somewhat more tightly than the seeds of the themes are."""
    centred, seeds, themes = _parts(spark, sf)
    d = table(spark, sf, "documents")
    taken = placement.place(placement.similarities(centred, themes).withColumn("seed", F.lit(False)), RULES).select("vec_id").distinct().withColumn("taken", F.lit(True))
    writings = d.select(F.col("doc_id").alias("vec_id"), "source", "text")
    own = centred.join(writings, "vec_id").join(taken, "vec_id", "left").where("source IN ('src0', 'src1', 'src2') OR taken IS NULL").select("vec_id", "vec")
    if cut is None:
        together = centred.join(seeds, "vec_id").select("vec_id", F.col("theme").alias("label"), "vec")
        cut = 0.8 * evaluate.cohesion_threshold(together).first()["threshold"]
    return discover.proposals(own, writings, _doc_labels(spark, sf).withColumnRenamed("doc_id", "vec_id"), themes, cut, key="vec_id")


@query("job07_discover", None)
def discovered(spark, sf):
    return _discovered(spark, sf)


_TERMS = ("the", "en", "der", "que", "and")
_QUOTES = rf"""
WITH s AS (SELECT doc_id, unnest(range(len(ss))) AS pos, trim(unnest(ss), ' ' || chr(9) || chr(10) || chr(13)) AS sentence FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents)),
u AS (SELECT *, {" + ".join(f"(len(list_filter(ws, lambda w: starts_with(w, '{t}'))) > 0)::INT" for t in _TERMS)} AS used FROM (SELECT *, regexp_extract_all(lower(sentence), '{tx.TOKEN}') AS ws FROM s WHERE sentence <> '' AND length(sentence) <= 400)),
b AS (SELECT doc_id, sentence AS quote, row_number() OVER (PARTITION BY doc_id ORDER BY used DESC, pos) AS r FROM u WHERE used > 0)
SELECT d.doc_id, b.quote FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND r = 1"""
query("f39_evidence", _QUOTES)(lambda spark, sf: table(spark, sf, "documents").select("doc_id", tx.evidence(F.col("text"), F.array(*[F.lit(t) for t in _TERMS])).alias("quote")))


_LIMITS = tune.Limits(coverage=0.6, mean_themes=1.6, share=0.25)
_TUNED = _BASE + """,
g AS (SELECT tau::DOUBLE AS tau, delta::DOUBLE AS delta FROM unnest([0.15, 0.2, 0.25]) a(tau), unnest([0.05, 0.1, 0.15]) b(delta)),
q AS (SELECT tau, delta, vec_id, theme FROM (SELECT *, row_number() OVER (PARTITION BY tau, delta, vec_id ORDER BY sim DESC, theme) AS turn FROM (SELECT vec_id, theme, sim, max(sim) OVER (PARTITION BY vec_id) AS top FROM sims), g WHERE sim >= tau) WHERE turn = 1 OR turn <= 3 AND top - sim <= delta),
i AS (SELECT tau, delta, v.vec_id AS key, list_filter(list(DISTINCT q.theme::VARCHAR), lambda x: x IS NOT NULL) AS pred, ['l' || any_value(v.label), 'k' || any_value(v.vec_id % 3)] AS gold FROM v CROSS JOIN g LEFT JOIN q USING (tau, delta, vec_id) GROUP BY tau, delta, v.vec_id),
pr AS (SELECT a.tau, a.delta, a.key, len(list_intersect(a.pred, b.pred)) AS sp, len(list_intersect(a.gold, b.gold)) AS sg FROM i a JOIN i b ON a.tau = b.tau AND a.delta = b.delta AND (len(list_intersect(a.pred, b.pred)) > 0 OR len(list_intersect(a.gold, b.gold)) > 0)),
bc AS (SELECT i.tau, i.delta, i.key, coalesce(avg(least(sp, sg) / sp::DOUBLE) FILTER (WHERE sp > 0), 1.0) AS p, coalesce(avg(least(sp, sg) / sg::DOUBLE) FILTER (WHERE sg > 0), 1.0) AS r FROM i JOIN pr USING (tau, delta, key) GROUP BY ALL),
f AS (SELECT tau, delta, avg(p) AS precision, avg(r) AS recall, 2 * avg(p) * avg(r) / (avg(p) + avg(r)) AS f FROM bc GROUP BY ALL),
t1 AS (SELECT tau, delta, max(c) AS top FROM (SELECT tau, delta, theme, count(*) AS c FROM q GROUP BY ALL) GROUP BY ALL),
s1 AS (SELECT tau, delta, avg(CASE WHEN len(pred) > 0 THEN 1.0 ELSE 0.0 END) AS coverage, avg(len(pred)) AS mean_themes, count(*) AS n FROM i GROUP BY ALL),
o AS (SELECT tau, delta, coverage, mean_themes, coalesce(top, 0) / n::DOUBLE AS largest_share, precision, recall, f FROM s1 LEFT JOIN t1 USING (tau, delta) LEFT JOIN f USING (tau, delta)),
a AS (SELECT *, coverage >= {l.coverage} AND mean_themes <= {l.mean_themes} AND largest_share <= {l.share} AS admissible FROM o)
SELECT tau, delta, round(coverage, 6) AS coverage, round(mean_themes, 6) AS mean_themes, round(largest_share, 6) AS largest_share, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f, 6) AS f, admissible,
  row_number() OVER (ORDER BY admissible DESC, round(f, 12) DESC, tau DESC, delta) = 1 AS chosen FROM a"""


@query("job03_tune", _TUNED.format(l=_LIMITS))
def tuned(spark, sf):
    """Nine configurations, scored by BCubed, and the one that is taken."""
    centred, _, themes = _parts(spark, sf)
    items = centred.select("vec_id", F.array(F.concat(F.lit("l"), "label"), F.concat(F.lit("k"), F.col("vec_id") % 3)).alias("gold"))
    grid = spark.createDataFrame([(t, d) for t in (0.15, 0.2, 0.25) for d in (0.05, 0.1, 0.15)], "tau double, delta double")
    out = tune.tuned(placement.similarity_lists(centred, themes), items, grid, _LIMITS)
    return out.select("tau", "delta", *[F.round(c, 6).alias(c) for c in ("coverage", "mean_themes", "largest_share", "precision", "recall", "f")], "admissible", "chosen")


@query("job01_keywords_by_arrival", """
WITH c AS (SELECT doc_id, doc_id % 4 AS batch, term, focus FROM @counts), n AS (SELECT doc_id, sum(focus) AS n_focus FROM c GROUP BY doc_id),
b AS (SELECT DISTINCT batch FROM c), t AS (SELECT b.batch, term, sum(focus) AS total FROM c JOIN b ON c.batch <= b.batch GROUP BY b.batch, term), a AS (SELECT batch, sum(total) AS n_all FROM t GROUP BY batch),
l AS (SELECT c.doc_id, c.batch, c.term, focus, total - focus AS reference, n_focus, n_all - n_focus AS n_reference FROM c JOIN t USING (batch, term) JOIN n USING (doc_id) JOIN a USING (batch) WHERE focus >= 2),
s AS (SELECT *, round((focus * 1e6 / n_focus + 1) / (reference * 1e6 / n_reference + 1), 6) AS score FROM l WHERE focus * 1e6 / n_focus > reference * 1e6 / n_reference)
SELECT doc_id, batch, rank, term, score, focus FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 8""")
def keywords_by_arrival(spark, sf):
    """Documents in four batches, each compared with its own batch and those before it."""
    import uuid

    log = KeywordLog(spark, f"{scratch(spark)}/arrival-{uuid.uuid4().hex[:12]}")
    d = table(spark, sf, "documents")
    for number in range(4):
        log.batch(d.where(F.col("doc_id") % 4 == number), number)
    return log.keywords().select("doc_id", F.col("batch").cast("long").alias("batch"), F.col("rank").cast("long").alias("rank"), "term", "score", "focus")


# --- pages ------------------------------------------------------------------------------------

query("f04_markdown", None)(lambda spark, sf: table(spark, sf, "pages").select("page_id", md.markdown(F.col("html")).alias("markdown")))
query("f06_encode_url", "SELECT page_id, regexp_extract(url, '^[^?#]*') || '/%C3%A9%20%20?q=%C5%B1' AS encoded FROM pages")(lambda spark, sf: table(spark, sf, "pages").select("page_id", md.encoded_url(F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.lit("/é %20?q=ű"))).alias("encoded")))


_P = "regexp_replace(regexp_replace(regexp_replace({}, '[?#].*', ''), '^[a-z]+://[^/]*', ''), '/+$', '')"
_INTEGRITY = rf"""
WITH RECURSIVE p AS (SELECT page_id, {_P.format('url')} AS path, html FROM pages),
site AS MATERIALIZED (SELECT path, html FROM p UNION ALL SELECT '', string_agg('<a href="' || path || '/">x</a>', '') FROM p UNION ALL SELECT path || '/old', '(text)[http://x] <h1>none</h1>' FROM p WHERE page_id % 50 = 0),
re AS MATERIALIZED (SELECT '/' || replace(lang, ' ', '') || doc_id AS source, CASE WHEN doc_id % 4 = 0 THEN (SELECT min(path) FROM p) WHEN doc_id % 4 = 1 THEN '/nowhere' ELSE '/' || (SELECT min(lang) FROM documents) || (doc_id - doc_id % 4) END AS target FROM documents),
hop AS (SELECT source, target, 0 AS k FROM re UNION ALL SELECT h.source, r.target, k + 1 FROM hop h JOIN re r ON r.source = h.target WHERE k < 30),
endings AS (SELECT source FROM hop WHERE target IN (SELECT path FROM site)),
alive AS MATERIALIZED (SELECT DISTINCT path FROM (SELECT path FROM site UNION ALL SELECT source FROM endings)),
h AS MATERIALIZED (SELECT path AS at_, unnest(list_distinct(regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1))) AS href FROM site),
l AS MATERIALIZED (SELECT at_, {_P.format('href')} AS path FROM h WHERE starts_with(href, '/') AND NOT starts_with(href, '//')),
d AS (SELECT DISTINCT path FROM l),
reg AS (SELECT DISTINCT source AS path FROM re),
n AS (SELECT DISTINCT trim(regexp_extract(html, '(?is)<h1[^>]*>([^<]*)</h1>', 1)) AS name FROM p WHERE page_id % 2 = 0),
hd AS (SELECT DISTINCT name FROM (SELECT trim(regexp_extract(html, '(?is)<h1[^>]*>([^<]*)</h1>', 1)) AS name FROM site) WHERE name <> ''),
ca AS (SELECT DISTINCT lang AS name FROM documents)
SELECT 'links' AS "check", count(*) AS n_checked, count(*) FILTER (WHERE path NOT IN (SELECT path FROM alive)) AS n_bad, min(path) FILTER (WHERE path NOT IN (SELECT path FROM alive)) AS first_bad FROM d
UNION ALL SELECT 'blind', count(*), (count(*) = 0)::BIGINT, NULL FROM d
UNION ALL SELECT 'registry', count(*), count(*) FILTER (WHERE path NOT IN (SELECT path FROM alive)), min(path) FILTER (WHERE path NOT IN (SELECT path FROM alive)) FROM reg
UNION ALL SELECT 'headings', count(*), count(*) FILTER (WHERE name NOT IN (SELECT name FROM n)), min(name) FILTER (WHERE name NOT IN (SELECT name FROM n)) FROM hd
UNION ALL SELECT 'names', count(*), count(*) FILTER (WHERE name NOT IN (SELECT name FROM n)), min(name) FILTER (WHERE name NOT IN (SELECT name FROM n)) FROM ca
UNION ALL SELECT 'inside_out', count(*), count(*) FILTER (WHERE contains(html, ')[http')), min(path) FILTER (WHERE contains(html, ')[http')) FROM site
UNION ALL SELECT 'twice', count(*), count(*) FILTER (WHERE c > 1), min(path) FILTER (WHERE c > 1) FROM (SELECT path, count(*) AS c FROM site GROUP BY path)
UNION ALL SELECT 'required', 2, (CASE WHEN b = 0 THEN 1 ELSE 0 END + CASE WHEN f = 0 THEN 1 ELSE 0 END)::BIGINT, CASE WHEN b = 0 OR f = 0 THEN '/modszer' END FROM (SELECT count(*) FILTER (WHERE path = '/modszer') AS b, (SELECT count(*) FROM l WHERE at_ = '' AND path = '/modszer') AS f FROM site)"""


@query("job15_integrity", _INTEGRITY)
def integrity_checks(spark, sf):
    """The pages as a site, with a home page that links to all, some pages of faults, and redirects from the documents."""
    p = table(spark, sf, "pages").select("page_id", integrity.path_of(F.col("url")).alias("path"), "html")
    home = p.agg(F.lit("").alias("path"), F.array_join(F.transform(F.collect_list("path"), lambda x: F.concat(F.lit('<a href="'), x, F.lit('/">x</a>'))), "").alias("html"))
    faults = p.where("page_id % 50 = 0").select(F.concat("path", F.lit("/old")).alias("path"), F.lit("(text)[http://x] <h1>none</h1>").alias("html"))
    site = p.select("path", "html").unionByName(home).unionByName(faults)
    d = table(spark, sf, "documents")
    one = d.agg(F.min("lang").alias("least")).crossJoin(p.agg(F.min("path").alias("top")))  # one row
    k = F.col("doc_id") % 4
    target = F.when(k == 0, F.col("top")).when(k == 1, "/nowhere").otherwise(F.concat(F.lit("/"), "least", F.col("doc_id") - k))
    redirects = d.crossJoin(F.broadcast(one)).select(F.concat(F.lit("/"), F.replace("lang", F.lit(" "), F.lit("")), "doc_id").alias("source"), target.alias("target"))
    heading = F.trim(F.regexp_extract("html", integrity.HEADING, 1))
    names = p.where("page_id % 2 = 0").select(heading.alias("name"))
    return integrity.checks(site, redirects, redirects.select(F.col("source").alias("path")), names, d.select(F.lit("x").alias("path"), F.col("lang").alias("name")), "/modszer")
