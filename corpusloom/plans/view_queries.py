"""Joins, aggregations, windows, orders, set operations, hubs, views and integrity checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import discover, hubs, labels
from ..operators.lineage import checkpointed
from .registry import _doc_labels, _tokens, query, sql, table

# --- joins ------------------------------------------------------------------------------------

sql("j01_left_default", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id")
sql("j02_left_keywords", "SELECT o.o_orderkey, count(l.l_orderkey) AS n_lines FROM @orders o LEFT JOIN @lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey")
sql("j03_author_labels", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS has_labels FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id")
sql("j09_left_semi_gold", "SELECT doc_id, lang FROM @documents WHERE doc_id IN (SELECT doc_id FROM @labels WHERE quality = 1)")
sql("j10_left_anti_todo", "SELECT d.doc_id FROM @documents d WHERE NOT EXISTS (SELECT 1 FROM @labels l WHERE l.doc_id = d.doc_id)")


@query("j11_placement_diff", "SELECT doc_id, len(list_filter(n, lambda x: NOT list_contains(o, x)))::BIGINT AS gained, len(list_filter(o, lambda x: NOT list_contains(n, x)))::BIGINT AS lost FROM (SELECT d.doc_id, ['a' || d.n_chars % 3, 'b' || d.n_chars % 5] AS o, ['a' || d.n_chars % 2, 'b' || coalesce(l.quality, 4)] AS n FROM documents d LEFT JOIN labels l USING (doc_id))")
def placement_diff(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    old = F.array(F.concat(F.lit("a"), F.col("n_chars") % 3), F.concat(F.lit("b"), F.col("n_chars") % 5))
    new = F.array(F.concat(F.lit("a"), F.col("n_chars") % 2), F.concat(F.lit("b"), F.coalesce("quality", F.lit(4))))
    return d.select("doc_id", F.size(F.array_except(new, old)).cast("long").alias("gained"), F.size(F.array_except(old, new)).cast("long").alias("lost"))


sql("j13_unusable_seeds", "SELECT s.s_suppkey, 'no nation' AS problem FROM @supplier s WHERE NOT EXISTS (SELECT 1 FROM @nation n WHERE n.n_nationkey = s.s_nationkey) UNION ALL SELECT min(s_suppkey), 'shared nation' FROM @supplier GROUP BY s_nationkey HAVING count(*) > 1")


@query("j14_band_anti", "SELECT DISTINCT day FROM (SELECT CAST(o_orderdate AS DATE) AS day FROM orders) o WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT CAST(ts AS DATE) - 9500 AS moved FROM events) e WHERE moved BETWEEN day - 10 AND day + 10)")
def band_anti(spark, sf):
    """Days of orders without any event, moved by 9,500 days, within ten days: a band join as an equi-join on ten-day buckets."""
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    dates = table(spark, sf, "events").select(F.date_sub(F.to_date("ts"), 9500).alias("at")).distinct()
    bucket = lambda c: F.floor(F.unix_date(c) / 10)
    near = dates.withColumn("b", bucket(F.col("at")))
    wide = days.withColumn("b", F.explode(F.array(bucket(F.col("day")) - 1, bucket(F.col("day")), bucket(F.col("day")) + 1)))
    hit = wide.join(near, "b").where(F.abs(F.datediff("day", "at")) <= 10).select("day").distinct()
    return days.join(hit, "day", "left_anti")


sql("j15_tag_index", "SELECT e.event_id, coalesce(t.n, 0) AS n FROM @events e LEFT JOIN (SELECT user_id, count(*) AS n FROM @events WHERE event_type = 'click' GROUP BY user_id) t ON e.user_id = t.user_id")


@query("j16_unreferenced", r"SELECT p.name FROM (SELECT DISTINCT '/' || term AS name FROM @tokens) p WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT lower(unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) AS name FROM pages) u WHERE u.name = p.name)".replace('\\"', '"'))
def unreferenced(spark, sf):
    """Names that no page mentions: names are extracted once and joined, instead of searched in every page."""
    names = _tokens(spark, sf).select(F.concat(F.lit("/"), "term").alias("name")).distinct()
    used = table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("name")).select(F.lower("name").alias("name")).distinct()
    return names.join(used, "name", "left_anti")


sql("j17_hub_lookup", "SELECT n.n_nationkey, r.r_name FROM @nation n JOIN @region r ON n.n_regionkey = r.r_regionkey")
sql("j18_keyword_entry", "SELECT p.p_brand, count(*) AS n, sum(l.l_quantity) AS quantity FROM @lineitem l JOIN @part p ON l.l_partkey = p.p_partkey GROUP BY p.p_brand")
sql("j19_author_slug", "SELECT c.c_custkey, n.n_name AS author, CASE WHEN c.c_acctbal > 0 THEN lower(n.n_name) END AS slug FROM @customer c LEFT JOIN @nation n ON c.c_nationkey = n.n_nationkey")
sql("j21_manual_override", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 0 THEN 'skip' END, CASE WHEN d.n_chars < 300 THEN 'skip' ELSE 'import' END) AS decision FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id")
sql("j22_referential_integrity", "SELECT 'orders' AS what, count(*) AS n FROM @orders o WHERE NOT EXISTS (SELECT 1 FROM @customer c WHERE c.c_custkey = o.o_custkey) UNION ALL SELECT 'lineitem', count(*) FROM @lineitem l WHERE NOT EXISTS (SELECT 1 FROM @orders o WHERE o.o_orderkey = l.l_orderkey) UNION ALL SELECT 'labels', count(*) FROM @documents d WHERE NOT EXISTS (SELECT 1 FROM @labels l WHERE l.doc_id = d.doc_id) UNION ALL SELECT 'nation', count(*) FROM @nation n WHERE NOT EXISTS (SELECT 1 FROM @region r WHERE r.r_regionkey = n.n_regionkey)")


@query("j23_quote_verified", "SELECT d.doc_id, contains(d.text, q.quote) AS verified FROM documents d JOIN (SELECT doc_id - doc_id % 2 AS doc_id, regexp_extract(text, '^[^.!?]+[.!?]') AS quote FROM documents) q ON d.doc_id = q.doc_id")
def quote_verified(spark, sf):
    """Quotes of each document and of its neighbour, looked up in the document: some are its own and some are not."""
    d = table(spark, sf, "documents")
    quotes = d.select((F.col("doc_id") - F.col("doc_id") % 2).alias("doc_id"), F.regexp_extract("text", r"^[^.!?]+[.!?]", 0).alias("quote"))
    return d.join(quotes, "doc_id").select("doc_id", F.contains("text", "quote").alias("verified"))


# --- labels -----------------------------------------------------------------------------------

_CLEAN = """
WITH r AS (SELECT DISTINCT doc_id, source, CASE lower(label) WHEN 'lang-de' THEN 'lang-en' ELSE lower(label) END AS label FROM @doc_labels),
k AS (SELECT * FROM r WHERE label NOT IN ('toxic', 'year-0')),
e AS (SELECT source, label FROM k GROUP BY source, label HAVING count(*) >= 20)
SELECT k.doc_id, k.source, k.label FROM k JOIN e ON k.source = e.source AND k.label = e.label"""


@query("agg05_clean_labels", _CLEAN)
def clean(spark, sf):
    genres = spark.createDataFrame([("toxic",), ("year-0",)], "label string")
    merges = spark.createDataFrame([("lang-de", "lang-en")], "label string, target string")
    return labels.clean_labels(_doc_labels(spark, sf), genres, merges, 20)


sql("agg06_label_pages", "SELECT label, count(*) AS n FROM @doc_labels GROUP BY label HAVING count(*) >= 3")


@query("agg07_lift", """
WITH o AS (SELECT DISTINCT doc_id, lower(label) AS label FROM @doc_labels), g AS (SELECT doc_id, source AS grp FROM documents),
i AS (SELECT grp, label, count(*) AS in_group FROM o JOIN g USING (doc_id) GROUP BY ALL HAVING count(*) >= 2),
a AS (SELECT label, count(*) AS in_all FROM o GROUP BY label), n AS (SELECT grp, count(*) AS n_group FROM g GROUP BY grp), t AS (SELECT count(DISTINCT doc_id) AS n_all FROM o)
SELECT grp, label, in_group, n_group, in_all, n_all, round((in_group / n_group::DOUBLE) / (in_all / n_all::DOUBLE), 8) AS ratio FROM i JOIN a USING (label) JOIN n USING (grp), t WHERE (in_group / n_group::DOUBLE) / (in_all / n_all::DOUBLE) > 1""")
def label_lift(spark, sf):
    chosen = table(spark, sf, "documents").select("doc_id", F.col("source").alias("grp"))
    return discover.lift(_doc_labels(spark, sf), chosen).select("grp", "label", "in_group", "n_group", "in_all", "n_all", F.round("ratio", 8).alias("ratio"))


sql("agg08_members_per_label", "SELECT label, count(DISTINCT doc_id) AS n FROM @doc_labels GROUP BY label")


@query("agg09_hub_members", "SELECT c_mktsegment AS hub, count(*) AS n, string_agg(c_name, '|' ORDER BY c_acctbal DESC, c_name) AS members FROM customer GROUP BY c_mktsegment")
def hub_members(spark, sf):
    rows = hubs.members(table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "hub"), "hub", ["c_name"], [-F.col("c_acctbal"), F.col("c_name")])
    return rows.select("hub", "n", F.array_join(F.transform("members", lambda m: m["c_name"]), "|").alias("members"))


@query("agg10_day_spine", """
WITH d AS (SELECT CAST(ts AS DATE) AS day FROM events UNION ALL SELECT CAST(o_orderdate AS DATE) + 9500 FROM orders),
b AS (SELECT min(day) AS lo, max(day) AS hi FROM d), s AS (SELECT CAST(unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM b),
c AS (SELECT s.day, count(d.day) AS n FROM s LEFT JOIN d USING (day) GROUP BY s.day)
SELECT day, n, round(100.0 * n / max(n) OVER (), 6) AS share FROM c""")
def day_spine(spark, sf):
    """Counts over the union of two sources, gaps filled, as a share of the largest."""
    e = table(spark, sf, "events").select(F.to_date("ts").alias("day"))
    days = e.unionByName(table(spark, sf, "orders").select(F.date_add(F.to_date("o_orderdate"), 9500).alias("day")))
    counts = days.groupBy("day").agg(F.count("*").alias("n"))
    bounds = counts.agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.max("n").alias("top"))
    spine = bounds.select(F.explode(F.sequence("lo", "hi")).alias("day"), "top")
    return spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(100.0 * F.coalesce("n", F.lit(0)) / F.col("top"), 6).alias("share"))


sql("agg13_label_spread", "SELECT n_labels, count(*) AS n FROM (SELECT d.doc_id, count(l.label) AS n_labels FROM @documents d LEFT JOIN @doc_labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id) t GROUP BY n_labels")


@query("agg24_change_crosstab", "SELECT source, count(*) FILTER (WHERE kind = 'gained') AS gained, count(*) FILTER (WHERE kind = 'lost') AS lost, count(*) FILTER (WHERE kind = 'same') AS same FROM (SELECT coalesce(s, 'total') AS source, kind FROM (SELECT source, CASE WHEN quality IS NULL THEN 'lost' WHEN quality = 1 THEN 'same' ELSE 'gained' END AS kind FROM documents LEFT JOIN labels USING (doc_id)), unnest([source, NULL]) AS t(s)) GROUP BY source")
def crosstab(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    kind = F.when(F.col("quality").isNull(), "lost").when(F.col("quality") == 1, "same").otherwise("gained")
    rows = d.select("source", kind.alias("kind")).rollup("source").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("gained", "lost", "same")])
    return rows.withColumn("source", F.coalesce("source", F.lit("total")))


@query("agg25_flow_matrix", "WITH f AS (SELECT lang AS old, source AS new, count(*) AS n FROM documents GROUP BY ALL) SELECT old, new, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY old ORDER BY n DESC, new) AS rank FROM f) WHERE rank <= 6")
def flow(spark, sf):
    f = table(spark, sf, "documents").groupBy(F.col("lang").alias("old"), F.col("source").alias("new")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("old").orderBy(F.desc("n"), "new")
    return f.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 6")


_SPELL = r"(SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}]+')) AS term FROM documents) GROUP BY term)"


@query("agg27_canonical_forms", rf"SELECT term, first_value(term) OVER (PARTITION BY strip_accents(replace(lower(term), 'ß', 'ss')) ORDER BY NOT regexp_matches(term, '^\p{{Lu}}{{2,}}$'), -n, NOT regexp_matches(term, '^\p{{Ll}}'), term) AS canonical FROM {_SPELL}")
def canonical(spark, sf):
    terms = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("term"))
    return hubs.canonical_forms(terms.groupBy("term").agg(F.count("*").alias("n")))


@query("j20_canonical_join", rf"WITH c AS (SELECT term, n, first_value(term) OVER (PARTITION BY strip_accents(replace(lower(term), 'ß', 'ss')) ORDER BY NOT regexp_matches(term, '^\p{{Lu}}{{2,}}$'), -n, NOT regexp_matches(term, '^\p{{Ll}}'), term) AS canonical FROM {_SPELL}) SELECT canonical, sum(n)::BIGINT AS n, count(*) AS spellings FROM c GROUP BY canonical")
def canonical_join(spark, sf):
    terms = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("term"))
    counts = terms.groupBy("term").agg(F.count("*").alias("n"))
    return counts.join(hubs.canonical_forms(counts), "term").groupBy("canonical").agg(F.sum("n").alias("n"), F.count("*").alias("spellings"))


sql("agg28_duplicates", "SELECT p_name, count(*) AS n, min(p_partkey) AS first_key FROM @part GROUP BY p_name HAVING count(*) > 1")
sql("agg29_counters", "SELECT event_type, count(*) AS n FROM @events GROUP BY event_type")
sql("agg29_top_authors", "SELECT user_id, count(*) AS n FROM @events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 8")
query("agg30_fingerprint", "SELECT source, sha256(string_agg(doc_id::VARCHAR || ':' || sha256(text) || ';', '' ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY source")(
    lambda spark, sf: table(spark, sf, "documents").select("source", "doc_id", F.sha2("text", 256).alias("h")).groupBy("source").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "h"))), lambda x: F.concat(x["doc_id"].cast("string"), F.lit(":"), x["h"], F.lit(";"))), ""), 256).alias("fingerprint"))
)
sql("agg31_gates", "SELECT bool_and(ok) AS passed, count(*) AS n FROM (SELECT avg(value) > 0 AS ok FROM @events GROUP BY event_type) t")
sql("agg32_lengths", "SELECT 'events' AS what, count(*) AS n FROM @events UNION ALL SELECT 'orders', count(*) FROM @orders UNION ALL SELECT 'documents', count(*) FROM @documents")


@query("agg35_class_tfidf", """
WITH c AS (SELECT lang, term, count(*) AS n FROM (SELECT d.lang, t.term FROM @tokens t JOIN documents d USING (doc_id)) GROUP BY ALL), f AS (SELECT term, sum(n) AS f FROM c GROUP BY term), a AS (SELECT avg(s) AS a FROM (SELECT sum(n) AS s FROM c GROUP BY lang)), z AS (SELECT lang, sum(n) AS z FROM c GROUP BY lang),
s AS (SELECT lang, term, round(sqrt(n / z::DOUBLE) * ln(1 + a / f), 8) AS score FROM c JOIN f USING (term) JOIN z USING (lang), a)
SELECT lang, term, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 12""")
def class_tfidf(spark, sf):
    """Terms of a class: damped share in the class times the log of one plus average class size over total count."""
    d = table(spark, sf, "documents")
    # texts meet their languages before they are cut into terms, and the counts, which are read three times, are written once
    rows = d.select("doc_id", "text").join(d.select("doc_id", "lang"), "doc_id").select("lang", F.explode(tx.tokens(F.col("text"))).alias("term"))
    c = checkpointed(rows.groupBy("lang", "term").agg(F.count("*").alias("n")))
    z = c.groupBy("lang").agg(F.sum("n").alias("z"))
    score = F.round(F.sqrt(F.col("n") / F.col("z")) * F.log(1 + F.col("a") / F.col("f")), 8)
    s = c.join(c.groupBy("term").agg(F.sum("n").alias("f")), "term").join(F.broadcast(z.crossJoin(z.agg(F.avg("z").alias("a")))), "lang").withColumn("score", score)
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "term")).cast("long")).where("rank <= 12").select("lang", "term", "score", "rank")


# --- windows, orders, set operations -----------------------------------------------------------

sql("w08_previous_next", "SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_turn, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM @conversations")
sql("j24_stepper", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after_id FROM @events")
query("w09_unique_slugs", "SELECT p_partkey, replace(p_name, ' ', '-') || CASE WHEN r = 1 THEN '' ELSE '-' || r END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)")(
    lambda spark, sf: hubs.unique_slugs(table(spark, sf, "part").withColumn("s", F.replace("p_name", F.lit(" "), F.lit("-"))), "s", ["p_partkey"]).select("p_partkey", F.col("unique_slug").alias("slug"))
)
sql("w10_newest_first", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS BIGINT) AS position FROM @orders")
query("w11_first_seen", "SELECT doc_id, string_agg(term, ' ' ORDER BY pos) AS terms FROM (SELECT doc_id, term, min(pos) AS pos FROM @tokens GROUP BY doc_id, term) GROUP BY doc_id")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.array_join(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))), " ").alias("terms")).where("terms <> ''")
)
query("w03_knn_ranks", "SELECT vec_id, near FROM (SELECT a.vec_id, b.vec_id AS near, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.vec, b.vec), 12) DESC, b.vec_id) AS rank FROM @vectors a JOIN @vectors b ON a.vec_id <> b.vec_id) WHERE rank <= 1")(
    lambda spark, sf: _nearest(spark, sf)
)


def _nearest(spark, sf):
    from ..operators.evaluate import neighbours
    from .registry import _vectors

    return neighbours(_vectors(spark, sf), 1).select("vec_id", "near")


sql("ord01_newest_orders", "SELECT o_orderkey, o_orderdate FROM @orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
sql("ord02_multi_key", "SELECT p_partkey, p_type, p_size, p_name, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_name, p_partkey) AS BIGINT) AS position FROM @part")
sql("lim01_first_twelve", "SELECT event_id, ts FROM @events ORDER BY ts DESC, event_id LIMIT 12")
sql("set01_union_all", "SELECT l_returnflag AS flag, count(*) AS n FROM (SELECT l_returnflag FROM @lineitem UNION ALL SELECT o_orderstatus FROM @orders) t GROUP BY l_returnflag")
sql("set02_right_wins", "SELECT doc_id, mark FROM (SELECT doc_id, mark, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC) AS r FROM (SELECT doc_id, lang AS mark, 0 AS p FROM @documents UNION ALL SELECT doc_id, concat('q', quality), 1 FROM @labels) u) t WHERE r = 1")
sql("set03_array_sets", "SELECT n_regionkey, size(array_except(a, b)) AS only_a, size(array_intersect(a, b)) AS both FROM (SELECT n_regionkey, collect_set(n_nationkey) AS a, collect_set(n_nationkey % 10) AS b FROM @nation GROUP BY n_regionkey) t", "SELECT n_regionkey, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INT AS only_a, len(list_intersect(a, b))::INT AS both FROM (SELECT n_regionkey, list(DISTINCT n_nationkey) AS a, list(DISTINCT n_nationkey % 10) AS b FROM nation GROUP BY n_regionkey) t")
query("set04_registry", "SELECT slug FROM (SELECT DISTINCT source AS slug FROM documents UNION SELECT DISTINCT lang FROM documents)")(lambda spark, sf: hubs.registry_union(table(spark, sf, "documents").select(F.col("source").alias("slug")), table(spark, sf, "documents").select(F.col("lang").alias("slug"))))
sql("set05_distinct_years", "SELECT DISTINCT CAST(year(l_shipdate) AS BIGINT) AS year FROM @lineitem")

# --- views ------------------------------------------------------------------------------------

sql("v01_home", "SELECT c_mktsegment AS pillar, count(*) AS n, count(DISTINCT c_nationkey) AS n_nations FROM @customer GROUP BY c_mktsegment")
sql("v02_archive", "SELECT year, kind, count(*) AS n FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, 'orders' AS kind FROM @orders UNION ALL SELECT CAST(year(l_shipdate) AS BIGINT), 'lines' FROM @lineitem) t GROUP BY year, kind")
sql("v03_term_hub", "SELECT l.label, d.lang, count(*) AS n FROM @doc_labels l JOIN @documents d ON l.doc_id = d.doc_id GROUP BY l.label, d.lang")
sql("v04_media_lists", "SELECT event_type <> 'error' AS available, CAST(year(ts) AS BIGINT) AS year, count(*) AS n, max(event_id) AS last_id FROM @events GROUP BY event_type <> 'error', year(ts)")
sql("v05_month_spine", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, count(*) AS n, sum(count(*)) OVER (PARTITION BY year(o_orderdate)) AS in_year FROM @orders GROUP BY year(o_orderdate), month(o_orderdate)", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, count(*) AS n, (sum(count(*)) OVER (PARTITION BY year(o_orderdate)))::BIGINT AS in_year FROM orders GROUP BY year(o_orderdate), month(o_orderdate)")
sql("v06_feed", "SELECT doc_id, concat('/posts/', doc_id, '/') AS link, substr(text, 1, 155) AS summary FROM @documents WHERE source = 'src0'")
sql("v07_single_margin", "SELECT s.s_suppkey, s.s_name, n.n_name, r.r_name FROM @supplier s LEFT JOIN @nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN @region r ON n.n_regionkey = r.r_regionkey")
sql("v08_shortcode_fallback", "SELECT e.event_id, coalesce(p.p_name, 'missing') AS title FROM @events e LEFT JOIN @part p ON e.event_id = p.p_partkey")
sql("v09_inverted_index", "SELECT label, count(*) AS n, concat('/cimke/', lower(label), '/') AS permalink FROM @doc_labels GROUP BY label")
sql("snk03_member_lines", "SELECT c_nationkey, concat('- ', c_name, ' (', CASE WHEN c_acctbal > 0 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR(12)) ELSE 'null' END, ')') AS line FROM @customer")
query("snk11_json_graph", "SELECT n_nationkey, json_object('type', 'Nation', 'name', n_name, 'region', json_object('key', n_regionkey))::VARCHAR AS doc FROM nation")(
    lambda spark, sf: table(spark, sf, "nation").select("n_nationkey", F.to_json(F.struct(F.lit("Nation").alias("type"), F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("key")).alias("region"))).alias("doc"))
)
sql("snk12_orphan_hubs", "SELECT n.n_nationkey FROM @nation n WHERE NOT EXISTS (SELECT 1 FROM @supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000)")
