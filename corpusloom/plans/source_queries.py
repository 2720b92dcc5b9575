"""Source, sink, driver-job and streaming queries: files are rendered from the tables and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import keyness, placement
from ..sources import feeds, pages, sinks
from ..streaming import incremental
from .registry import _vectors, query, table
from .vector_queries import _BASE, RULES, _parts


def _files(spark, sf):
    """Pages with front matter, one a document, as they would be read from disk."""
    d = table(spark, sf, "documents")
    head = F.concat(F.lit('---\ntitle: "Doc '), "doc_id", F.lit('"\ndate: 20'), F.lpad((10 + F.col("n_chars") % 15).cast("string"), 2, "0"), F.lit("-05-01T10:00:00Z\nregi_cimkek:\n  - \""), "lang", F.lit('"\n  - '), "source", F.lit('\ntags: ["'), "lang", F.lit('", '), "source", F.lit("]\n---\n"))
    return d.select(F.concat(F.lit("content/"), "doc_id", F.lit(".md")).alias("path"), F.concat(head, "text").alias("raw"))


query("src01_front_matter_pages", "SELECT 'content/' || doc_id || '.md' AS doc_id, 'Doc ' || doc_id AS title, (2010 + n_chars % 15)::INT AS year FROM documents")(lambda spark, sf: pages.parse_pages(_files(spark, sf), "archive").select("doc_id", "title", "year"))
query("src04_list_keys", "SELECT 'content/' || doc_id || '.md' AS doc_id, lang || '|' || source AS block_list, lang || '|' || source AS flow_list FROM documents")(
    lambda spark, sf: pages.parse_pages(_files(spark, sf), "archive").select("doc_id", F.array_join(pages.list_items(F.col("front"), "regi_cimkek"), "|").alias("block_list"), F.array_join(pages.list_items(F.col("front"), "tags"), "|").alias("flow_list"))
)
query("src05_author_labels", "SELECT 'content/' || doc_id || '.md' AS doc_id, unnest([lang, source]) AS label FROM documents")(lambda spark, sf: pages.author_labels(pages.parse_pages(_files(spark, sf), "archive")))


@query("src02_yaml_rows", "SELECT 'Order ' || o_orderkey AS title, year(o_orderdate)::INT AS year, 'http://x.example/' || o_orderkey AS url, 'Order ' || o_orderkey || '. ' || o_orderpriority AS text FROM orders")
def yaml_rows(spark, sf):
    """One file a customer, a list of its orders."""
    o = table(spark, sf, "orders")
    block = F.concat(F.lit('  - cim: "Order '), "o_orderkey", F.lit('"\n    datum: '), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('\n    link: "http://x.example/'), "o_orderkey", F.lit('"\n    lead: "'), "o_orderpriority", F.lit('"'))
    files = o.groupBy("o_custkey").agg(F.concat(F.lit("sorok:\n"), F.array_join(F.sort_array(F.collect_list(block)), "\n")).alias("raw"))
    rows = pages.parse_rows(files.select(F.concat(F.lit("data/"), "o_custkey").alias("path"), "raw"), "kereses", "lead")
    return rows.select("title", "year", "url", "text")


query("src03_corpus", "SELECT source, count(*) AS n FROM (SELECT 'archive' AS source FROM documents WHERE trim(text) <> '' UNION ALL SELECT 'bench' FROM benchmark WHERE trim(text) <> '') GROUP BY source")(
    lambda spark, sf: pages.corpus(table(spark, sf, "documents").select(F.lit("archive").alias("source"), "text"), table(spark, sf, "benchmark").select(F.lit("bench").alias("source"), "text")).groupBy("source").agg(F.count("*").alias("n"))
)
query("src16_page_metadata", r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1))::INT AS n_links FROM pages""")(
    lambda spark, sf: feeds.page_metadata(table(spark, sf, "pages")).select("page_id", "title", F.size("links").alias("n_links"))
)


@query("src18_analyser_tokens", "SELECT conv_id, turn - min(turn) OVER (PARTITION BY conv_id) AS turn, role AS form, upper(role) AS lemma, '[/N]' AS xpostag FROM conversations")
def analyser(spark, sf):
    """A reply a conversation, a line a turn."""
    c = table(spark, sf, "conversations")
    line = F.concat("role", F.lit("\t[/N]\t"), F.upper("role"))
    replies = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    tokens = feeds.analyser_tokens(replies.select("conv_id", F.concat(F.lit("form\txpostag\tlemma\n"), "body", F.lit("\n\n")).alias("tsv")), "conv_id")
    return tokens.select("conv_id", F.col("pos").cast("long").alias("turn"), "form", "lemma", "xpostag")


@query("f31_lemmatise", "SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS lemmas FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def lemmatise(spark, sf):
    """Lemmas of the content words of each reply, in order and with their case; here system turns are conjunctions."""
    c = table(spark, sf, "conversations")
    line = F.concat("role", F.when(F.col("role") == "system", "\t[/Cnj]\t").otherwise("\t[/N]\t"), "role")
    replies = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    tokens = feeds.analyser_tokens(replies.select("conv_id", F.concat(F.lit("form\txpostag\tlemma\n"), "body", F.lit("\n\n")).alias("tsv")), "conv_id")
    kept = tokens.where(tx.content_word(F.col("xpostag"))).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lemma"))).alias("ls"))
    return kept.select("conv_id", F.array_join(F.transform("ls", lambda x: x["lemma"]), " ").alias("lemmas"))


query("src20_distinct_links", r"""SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS position FROM (SELECT page_id, link, min(pos) AS pos FROM (SELECT page_id, unnest(l) AS link, unnest(range(len(l))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)) GROUP BY ALL)""")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", F.posexplode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1)))).alias("pos", "link")).select("page_id", "link", (F.col("pos") + 1).cast("long").alias("position"))
)


@query("snk01_front_matter_update", "SELECT 'content/' || doc_id || '.md' AS path, lang AS first_theme, true AS changed, true AS same_body FROM documents")
def front_matter_update(spark, sf):
    """Write two list keys, read them back; the body is the one before."""
    f = _files(spark, sf).join(table(spark, sf, "documents").select(F.concat(F.lit("content/"), "doc_id", F.lit(".md")).alias("path"), "text", F.array("lang", "source").alias("temak"), F.array("source").alias("kulcsszavak")), "path")
    out = sinks.update_front_matter(f)
    front = F.regexp_extract("new_raw", pages.FRONT_MATTER, 1)
    return out.select("path", F.element_at(pages.list_items(front, "temak"), 1).alias("first_theme"), "changed", (F.regexp_replace("new_raw", pages.FRONT_MATTER, "") == F.col("text")).alias("same_body"))


query("snk09_feed", "SELECT '/o/' || o_orderkey AS link, '<item><title>' || o_orderpriority || '</title><link>/o/' || o_orderkey || '</link><description>' || o_orderstatus || '</description></item>' AS item FROM orders ORDER BY o_orderdate DESC, '/o/' || o_orderkey LIMIT 20")(
    lambda spark, sf: sinks.feed_items(table(spark, sf, "orders").select(F.col("o_orderdate").alias("published"), F.concat(F.lit("/o/"), "o_orderkey").alias("link"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("content")), 20)
)
query("snk10_brief", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS n_chars, min(doc_id) AS first_id FROM documents GROUP BY source")(lambda spark, sf: table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.min("doc_id").alias("first_id")))

# --- jobs -------------------------------------------------------------------------------------


@query("job02_export_hubs", None)
def export_hubs(spark, sf):
    """Keywords of all documents, five each, one spelling each, as hubs with their members."""
    from ..operators import hubs

    top = keyness.top_keywords(table(spark, sf, "documents"), 5)
    counts = top.groupBy("term").agg(F.count("*").alias("n"))
    named = top.join(hubs.canonical_forms(counts), "term").select("doc_id", F.col("canonical").alias("term")).distinct()
    return hubs.members(named, "term", ["doc_id"], [F.col("doc_id")]).select("term", "n", F.array_join(F.transform("members", lambda m: m["doc_id"].cast("string")), ",").alias("members"))


_GRID = [(tau, delta) for tau in (0.15, 0.2, 0.25) for delta in (0.05, 0.1, 0.15)]


@query("job03_tuning_grid", _BASE + """,
g AS (SELECT tau::DOUBLE AS tau, delta::DOUBLE AS delta FROM unnest([0.15, 0.2, 0.25]) a(tau), unnest([0.05, 0.1, 0.15]) b(delta)),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tau, delta, vec_id ORDER BY sim DESC, theme) AS turn FROM (SELECT vec_id, theme, sim, max(sim) OVER (PARTITION BY vec_id) AS top FROM sims), g WHERE sim >= tau) WHERE turn = 1 OR turn <= 3 AND top - sim <= delta)
SELECT tau, delta, round(count(DISTINCT vec_id) / (SELECT count(*) FROM v)::DOUBLE, 6) AS coverage, round(count(*) / (SELECT count(*) FROM v)::DOUBLE, 6) AS themes_per_row FROM q GROUP BY tau, delta""")
def tuning_grid(spark, sf):
    """Coverage and themes per writing for every configuration at once: the grid is one more key."""
    c, _, themes = _parts(spark, sf)
    sims = placement.similarities(c, themes).withColumn("seed", F.lit(False))
    grid = spark.createDataFrame(_GRID, "tau double, delta double")
    from pyspark.sql.window import Window

    key = ["tau", "delta", "vec_id"]
    rows = sims.join(F.broadcast(grid))
    own = Window.partitionBy(*key)
    rows = rows.withColumn("rank", F.row_number().over(own.orderBy(F.desc("sim"), "theme"))).withColumn("best", F.max("sim").over(own)).where("sim >= tau")
    rows = rows.withColumn("turn", F.row_number().over(own.orderBy("rank"))).where("turn = 1 OR (turn <= 3 AND best - sim <= delta)")
    n = c.count()
    return rows.groupBy("tau", "delta").agg(F.round(F.count_distinct("vec_id") / F.lit(n), 6).alias("coverage"), F.round(F.count("*") / F.lit(n), 6).alias("themes_per_row"))


query("job13_extend_themes", "SELECT label AS theme, round(max(abs(m - m0)), 8) AS drift, max(abs(m - m0)) < 0.02 AS within FROM (SELECT label, i, avg(x) AS m, avg(x) FILTER (WHERE vec_id % 2 = 0) AS m0 FROM (SELECT vec_id, label, unnest(vec) AS x, unnest(range(64)) AS i FROM @vectors) GROUP BY ALL) GROUP BY label")(
    lambda spark, sf: _extended(_vectors(spark, sf))
)


def _extended(vectors):
    """How far the mean of a theme moves when the seeds with odd numbers join those with even ones."""
    old = vx.mean_by(vectors.where("vec_id % 2 = 0"), ["label"], "vec", "before")
    both = vx.mean_by(vectors, ["label"], "vec").join(old, "label", "left")
    return both.select(F.col("label").alias("theme"), F.round(vx.drift(F.col("mean"), F.col("before")), 8).alias("drift"), (vx.drift(F.col("mean"), F.col("before")) < 0.02).alias("within"))


query("job14_import_manifest", "SELECT doc_id, CASE WHEN length(text) < 100 THEN 'skip' ELSE 'import' END AS decision, lang AS reason FROM documents")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.when(F.length("text") < 100, "skip").otherwise("import").alias("decision"), F.col("lang").alias("reason"))
)

# --- streams ----------------------------------------------------------------------------------


@query("str01_frozen_placement", _BASE + "SELECT vec_id, string_agg(theme, ',' ORDER BY position) AS themes FROM (SELECT vec_id, theme, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, theme) AS position FROM (SELECT * FROM (SELECT *, CASE kind WHEN 'long' THEN 0.2 ELSE 0.15 END + CASE WHEN k >= 7 THEN 0.35 - 0.3 ELSE 0.0 END AS t2, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, theme) AS rk, max(sim) OVER (PARTITION BY vec_id) AS b2 FROM sims) WHERE sim >= t2 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY rk) = 1 OR b2 - sim <= 0.1)) WHERE position <= 3 GROUP BY vec_id")
def frozen_placement(spark, sf):
    """The stateless form that also runs on a stream."""
    c, _, themes = _parts(spark, sf)
    out = incremental.place_stream(c, themes, RULES)
    return out.where(F.size("themes") > 0).select("vec_id", F.array_join(F.transform("themes", lambda t: t.cast("string")), ",").alias("themes"))


query("str02_unseen_texts", "SELECT sha256(text) AS text_sha FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE source = 'src0') GROUP BY text")(
    lambda spark, sf: incremental.unseen(table(spark, sf, "documents"), table(spark, sf, "documents").where("source = 'src0'").select(F.sha2("text", 256).alias("text_sha")).distinct()).select("text_sha")
)
query("str03_visible", "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-20'")(lambda spark, sf: incremental.visible(table(spark, sf, "events"), "ts", F.to_timestamp(F.lit("2024-01-20"))).select("event_id"))
