"""Text, keyword, filter and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions import unicode as un
from ..operators import keyness
from .registry import query, sql, table

# --- counts and keyness -----------------------------------------------------------------------

_LOO = """
WITH c AS (SELECT * FROM @counts), t AS (SELECT term, sum(focus) AS total FROM c GROUP BY term),
n AS (SELECT doc_id, sum(focus) AS n_focus FROM c GROUP BY doc_id), a AS (SELECT sum(focus) AS n_all FROM c),
l AS (SELECT c.doc_id, c.term, focus::BIGINT AS focus, (total - focus)::BIGINT AS reference, n_focus::BIGINT AS n_focus, (n_all - n_focus)::BIGINT AS n_reference FROM c JOIN t USING (term) JOIN n USING (doc_id) CROSS JOIN a)"""
_KEYNESS = _LOO + """,
s AS (SELECT *, (focus * 1e6 / n_focus + 1) / (reference * 1e6 / n_reference + 1) AS score, log2((focus / n_focus::DOUBLE) / (CASE WHEN reference = 0 THEN 0.5 ELSE reference::DOUBLE END / n_reference)) AS effect_size
  FROM l WHERE focus >= 2 AND focus * 1e6 / n_focus > reference * 1e6 / n_reference),
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, term) AS rank, term, round(score, 6) AS score, round(effect_size, 6) AS effect_size, focus FROM s)"""

sql("agg01_corpus_totals", "SELECT term, CAST(sum(focus) AS BIGINT) AS n FROM @counts GROUP BY term")
sql("agg02_doc_counts", "SELECT doc_id, term, focus FROM @counts")
query("agg03_leave_one_out", _LOO + " SELECT * FROM l")(lambda spark, sf: keyness.leave_one_out(table(spark, sf, "documents")))


def _top(spark, sf, top=8):
    rows = keyness.scored(keyness.leave_one_out(table(spark, sf, "documents"), least=2))
    rows = rows.withColumn("score", F.round("score", 6)).withColumn("effect_size", F.round("effect_size", 6))
    place = Window.partitionBy("doc_id").orderBy(F.desc("score"), "term")
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top).select("doc_id", F.col("rank").cast("long"), "term", "score", "effect_size", "focus")


query("agg04_keyness_top8", _KEYNESS + " SELECT * FROM k WHERE rank <= 8")(_top)

_VETO = "('the', 'of', 'and', 'de', 'la', 'en', 'der', 'die')"


@query("fil16_veto_after_cut", _KEYNESS + f" SELECT doc_id, rank, term FROM k WHERE rank <= 5 AND term NOT IN {_VETO}")
def veto_after_cut(spark, sf):
    """Vetoed keywords go after the cut at five, with nothing moving up."""
    top = _top(spark, sf, 5)
    veto = spark.createDataFrame([(w,) for w in ("the", "of", "and", "de", "la", "en", "der", "die")], "term string")
    return top.join(F.broadcast(veto), "term", "left_anti").select("doc_id", "rank", "term")


# --- filters ----------------------------------------------------------------------------------

sql("fil01_section", "SELECT doc_id, source, n_chars FROM @documents WHERE source = 'src1'")
sql("fil02_partition_by_flag", "SELECT event_type = 'error' AS lost, count(*) AS n, min(event_id) AS first_id FROM @events GROUP BY event_type = 'error'")
sql("fil03_by_year", "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n FROM @orders GROUP BY year(o_orderdate)")
sql("fil04_nonempty_not_future", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year FROM @orders WHERE trim(o_orderpriority) <> '' AND (o_orderdate IS NULL OR year(o_orderdate) <= 1998)")
sql("fil05_scheduled_visibility", "SELECT event_id, user_id FROM @events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' AND event_type <> 'error'")
sql("fil06_dated", "SELECT count(*) AS n, CAST(min(year(o_orderdate)) AS BIGINT) AS first_year, CAST(max(year(o_orderdate)) AS BIGINT) AS last_year FROM @orders WHERE year(o_orderdate) > 1970")
sql("fil07_length_class", "SELECT doc_id, word_count, CASE WHEN word_count >= 80 THEN 'long' ELSE 'short' END AS length_class FROM @sized")
sql("fil08_fittable", "SELECT doc_id, source IN ('src0', 'src1', 'src2') AND word_count >= 80 AS fittable FROM @sized")


@query("fil09_content_word", "SELECT event_id, tag, tag IN ('[/N][Ine]', '[/V][Pst.Def.3Sg]', '[/Adj]') AS content, tag IN ('[/N][Ine]', '[/V][Pst.Def.3Sg]', '[/Adj]', '[/N|Pro|(Post)][Nom]') AS with_pronouns FROM (SELECT event_id, (['[/N][Ine]', '[/V][Pst.Def.3Sg]', '[/Det|Art.Def]', '[Punct]', '[/N|Pro|(Post)][Nom]', '[/Adj]'])[1 + event_id % 6] AS tag FROM events)")
def content_word(spark, sf):
    tags = F.array(*[F.lit(t) for t in ("[/N][Ine]", "[/V][Pst.Def.3Sg]", "[/Det|Art.Def]", "[Punct]", "[/N|Pro|(Post)][Nom]", "[/Adj]")])
    e = table(spark, sf, "events").select("event_id", F.get(tags, (F.col("event_id") % 6).cast("int")).alias("tag"))
    return e.select("event_id", "tag", tx.content_word(F.col("tag"), False).alias("content"), tx.content_word(F.col("tag"), True).alias("with_pronouns"))


_RAW = r"(SELECT DISTINCT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS term FROM documents)"


def _raw_terms(spark, sf):
    return table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("term")).distinct()


query("fil10_wordlike", rf"SELECT term, regexp_matches(term, '{tx.WORDLIKE}') AS wordlike FROM {_RAW}")(lambda spark, sf: _raw_terms(spark, sf).select("term", F.col("term").rlike(tx.WORDLIKE).alias("wordlike")))

#: An own short list: frequent function words by language group.
STOPWORDS = {"en": "the of and to in that is it for with as on be by this are or from an at was".split(), "de": "der die und das in den von zu mit ist nicht ein eine für auf".split(), "fr": "de la le les des et en un une que qui dans pour sur".split(), "es": "de la el los las y en que un una por con del se no".split()}
_STOP = "(" + ", ".join(f"'{w}'" for w in sorted({w for ws in STOPWORDS.values() for w in ws})) + ")"


def stopword_frame(spark, groups=("en", "de", "fr", "es")):
    """The words of the chosen groups: a dimension of a few dozen rows."""
    return spark.createDataFrame(sorted({(w,) for g in groups for w in STOPWORDS[g]}), "term string")


@query("fil11_stopwords", f"SELECT doc_id, count(*) AS n_kept, count(DISTINCT term) AS n_terms FROM @tokens WHERE term NOT IN {_STOP} GROUP BY doc_id")
def drop_stopwords(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
    return rows.join(F.broadcast(stopword_frame(spark)), "term", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n_kept"), F.count_distinct("term").alias("n_terms"))


#: Words that may hold hyphens, as a lemmatiser gives them.
_LEMMA = r"[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*"


def _normal_sql(lemma: str) -> str:
    """SQL for normalise_lemma of a lemma with one hyphen at most."""
    low = r"[\x00-\x40\x5B-\x7F]*"
    ended = rf"'(?s)^([\x00-\x7F]+|.*[\p{{Lu}}\p{{Nd}}].*)-(?:{'|'.join(un.HYPHEN_SUFFIXES)}){{1,2}}$'"
    bare = rf"CASE WHEN regexp_matches({lemma}, {ended}) AND NOT regexp_matches({lemma}, '(?s)^{low}[a-z]{low}-on$') THEN regexp_extract({lemma}, {ended}, 1) ELSE {lemma} END"
    short = ", ".join(f"'{w}'" for w in un.SHORT_WORDS)
    return rf"(SELECT CASE WHEN b = '' OR length(b) <= 2 AND regexp_matches(b, '^[\x00-\x40\x5B-\x7F]+$') AND regexp_matches(b, '[a-z]') AND b NOT IN ({short}) THEN NULL ELSE b END FROM (SELECT {bare} AS b))"


@query("fil12_keyword_lemmas", rf"""
WITH l AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS lemma FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_LEMMA}') AS w FROM documents)),
n AS (SELECT doc_id, pos, {_normal_sql("lemma")} AS lemma FROM l)
SELECT doc_id, string_agg(lemma, ' ' ORDER BY pos) AS lemmas FROM n WHERE lemma NOT IN {_STOP} AND regexp_matches(lemma, '{tx.WORDLIKE}') GROUP BY doc_id""")
def keyword_lemmas(spark, sf):
    """Normalise, drop stopwords, keep what looks like a word; order and repeats stay. All of it within a row's array: nothing is shuffled, and only words with a hyphen are searched for endings."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(_LEMMA), F.lit(0))
    stop = sorted({w for ws in STOPWORDS.values() for w in ws})
    normal = F.transform(words, lambda w: F.when(F.contains(w, F.lit("-")) | (F.length(w) <= 2), un.normalise_lemma(w)).otherwise(w))
    kept = F.filter(normal, lambda w: w.isNotNull() & w.rlike(tx.WORDLIKE) & ~w.isin(stop))
    return table(spark, sf, "documents").select("doc_id", kept.alias("ls")).where(F.size("ls") > 0).select("doc_id", F.array_join("ls", " ").alias("lemmas"))


sql("fil13_subjectless", "SELECT doc_id, max(CASE WHEN lower(label) IN ('toxic', 'year-0') THEN 1 ELSE 0 END) = 1 AS subjectless FROM @doc_labels GROUP BY doc_id")
query("fil14_byline", r"SELECT doc_id, regexp_matches(substr(text, 1, 300), '(?i)\b(the|von|par|por)\s+[\p{L}]+') AS byline FROM documents")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 300).rlike(r"(?i)\b(the|von|par|por)\s+[\p{L}]+").alias("byline"))
)
sql("fil15_skip_reasons", "SELECT CASE WHEN event_type = 'error' THEN 'not a post' WHEN value < 10 THEN 'not live' WHEN user_id % 7 = 0 THEN 'other author' ELSE 'kept' END AS reason, count(*) AS n FROM @events GROUP BY 1")
sql("fil17_discovery_candidates", "SELECT doc_id FROM @sized WHERE source = 'src3' OR (source IN ('src0', 'src1') AND word_count >= 80 AND lang = 'en')")
sql("fil18_state_filters", "SELECT o_orderstatus AS state, count(*) AS n FROM @orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderstatus")
sql("fil19_tag_with_own_page", "SELECT n_nationkey, n_name FROM @nation WHERE n_nationkey IN (SELECT c_nationkey FROM @customer WHERE c_acctbal > 9000)")
sql("prj01_tagged_union", "SELECT FALSE AS external, 'orders' AS kind, o_orderkey AS id, CAST(NULL AS VARCHAR(10)) AS link FROM @orders UNION ALL SELECT TRUE, 'events', event_id, event_type FROM @events")
sql("prj02_coalesce_chain", "SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' END, CASE WHEN l.quality = 0 THEN 'poor' END, d.lang) AS mark FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id")
sql("prj03_stable_key", "SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN concat('page-', doc_id) ELSE coalesce(CASE WHEN n_chars % 3 = 0 THEN concat('row-', n_chars) END, concat('file:', doc_id)) END AS doc_key FROM @documents")

# --- scalar functions -------------------------------------------------------------------------

_MD = r"(SELECT doc_id, '# ' || substr(text, 1, 80) || E'\n\n> [link](http://a.b/' || doc_id || ') and <b>bold</b> . ' || '![pic](x.png) **' || substr(text, 81) || E'**\n```\ncode\n```\nfile%20name ' || doc_id || '.jpg end' AS md FROM documents)"


def _markdown(spark, sf):
    """Whole texts as a page: a heading, a link, and all the rest between markers."""
    n = F.col("doc_id").cast("string")
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("# "), F.substring("text", 1, 80), F.lit("\n\n> [link](http://a.b/"), n, F.lit(") and <b>bold</b> . ![pic](x.png) **"), F.substr(F.col("text"), F.lit(81)), F.lit("**\n```\ncode\n```\nfile%20name "), n, F.lit(".jpg end")).alias("md"))


_STRIP = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
 md, '(?s)```.*?```', ' ', 'g'), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<[^>]+>', ' ', 'g'),
 '(?i)\S*%[0-9A-Fa-f]{2}\S*|\S+\.(?:jpg|jpeg|png|gif|webp|svg|pdf)\b', ' ', 'g'), '(?m)^[ \t]{0,3}(?:[#>]+|[-+*])[ \t]+', '', 'g'), '[*]+', '', 'g'), '\s+', ' ', 'g'), '\s+([,.;:!?…])', '\1', 'g'))"""
query("f01_strip_markup", f"SELECT doc_id, {_STRIP} AS plain FROM {_MD}")(lambda spark, sf: _markdown(spark, sf).select("doc_id", tx.strip_markup(F.col("md")).alias("plain")))
sql("f02_word_count", "SELECT doc_id, word_count FROM @sized")
query("f03_strip_html", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages")(lambda spark, sf: table(spark, sf, "pages").select("page_id", tx.strip_html(F.col("html")).alias("plain")))


@query("f05_url_policy", r"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://([^/?#]*\.)?example\.com') THEN 'local' WHEN regexp_matches(url, 'ads|casino') THEN 'dead' WHEN starts_with(url, 'http://') THEN 'lost' ELSE 'keep' END AS policy, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages")
def url_policy(spark, sf):
    host = F.parse_url(F.col("url"), F.lit("HOST"))
    policy = F.when((host == "example.com") | F.endswith(host, F.lit(".example.com")), "local").when(F.col("url").rlike("ads|casino"), "dead").when(F.startswith(F.col("url"), F.lit("http://")), "lost").otherwise("keep")
    return table(spark, sf, "pages").select("page_id", policy.alias("policy"), host.alias("host"))


@query("f07_markdown_qa", "SELECT doc_id, (len(string_split(md, '```')) - 1) % 2 = 1 AS odd_fences, len(list_filter(string_split(md, chr(10) || chr(10)), lambda p: (len(string_split(p, '**')) - 1) % 2 = 1)) > 0 AS odd_emphasis FROM " + _MD)
def markdown_qa(spark, sf):
    odd = tx.odd_markers(F.col("md"))
    return _markdown(spark, sf).select("doc_id", odd["fences"].alias("odd_fences"), odd["emphasis"].alias("odd_emphasis"))


_IMPORT_SLUG = "regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
query("f08_import_slug", f"SELECT doc_id, CASE WHEN s = '' THEN 'bejegyzes' WHEN length(s) <= 70 THEN s WHEN contains(substr(s, 1, 70), '-') THEN regexp_replace(substr(s, 1, 70), '-[^-]*$', '') ELSE substr(s, 1, 70) END AS slug FROM (SELECT doc_id, {_IMPORT_SLUG} AS s FROM documents)")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", tx.import_slug(F.col("text")).alias("slug"))
)
query("f09_hub_slug", r"SELECT term, regexp_replace(regexp_replace(strip_accents(replace(lower(term), 'ß', 'ss')), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM " + _RAW)(lambda spark, sf: _raw_terms(spark, sf).select("term", tx.hub_slug(un.fold("term")).alias("slug")))
query("f10_term_directory", r"SELECT doc_id, regexp_replace(lower(trim(text)), '\s+', '-', 'g') AS directory FROM documents")(lambda spark, sf: table(spark, sf, "documents").select("doc_id", tx.term_directory(F.col("text")).alias("directory")))
query("f11_nfkc", None)(lambda spark, sf: _raw_terms(spark, sf).select("term", un.nfkc("term").alias("composed")))
query("f12_fold", "SELECT term, strip_accents(replace(lower(term), 'ß', 'ss')) AS folded FROM " + _RAW)(lambda spark, sf: _raw_terms(spark, sf).select("term", un.fold("term").alias("folded")))
query("f13_acronym", r"SELECT name, regexp_matches(regexp_replace(name, '[^\p{L}]', '', 'g'), '^\p{Lu}{2,}$') AS acronym FROM (SELECT DISTINCT unnest([o_orderpriority, lower(o_orderpriority), o_orderstatus]) AS name FROM orders)")(
    lambda spark, sf: table(spark, sf, "orders").select(F.explode(F.array("o_orderpriority", F.lower("o_orderpriority"), "o_orderstatus")).alias("name")).distinct().select("name", tx.is_acronym(F.col("name")).alias("acronym"))
)
#: Words as they are, and with quotes, a blank and a backslash put to them.
_SCALARS = r"""(SELECT DISTINCT unnest([term, term || '"', ' ' || term, term || '\' || term, chr(39) || term || chr(39)]) AS value FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS term FROM documents))"""


@query("f14_yaml_quote", rf"""SELECT value, CASE WHEN value <> '' AND NOT regexp_matches(value, '[:#\[\]{{}},&*!|>%@`"'']') AND trim(value) = value THEN value ELSE q END AS quoted, q AS always, value AS back
FROM (SELECT value, '"' || replace(replace(value, '\', '\\'), '"', '\"') || '"' AS q FROM {_SCALARS})""")
def yaml_scalars(spark, sf):
    """Words as scalars of YAML and back, with quotes, backslashes and blanks put to them."""
    term = F.col("term")
    forms = F.array(term, F.concat(term, F.lit('"')), F.concat(F.lit(" "), term), F.concat(term, F.lit("\\"), term), F.concat(F.lit("'"), term, F.lit("'")))
    rows = _raw_terms(spark, sf).select(F.explode(forms).alias("value")).distinct()
    rows = rows.withColumn("quoted", tx.yaml_quote(F.col("value"))).withColumn("always", tx.yaml_quote(F.col("value"), always=True))
    return rows.withColumn("back", tx.yaml_unquote(F.when(F.startswith("quoted", F.lit('"')), F.col("quoted")).otherwise(F.col("always"))))


sql("f15_split_labels", "SELECT o_orderkey, part FROM (SELECT o_orderkey, explode(split(concat(o_orderpriority, '��', o_orderstatus), '�+')) AS part FROM @orders) WHERE part <> ''", "SELECT o_orderkey, part FROM (SELECT o_orderkey, unnest([o_orderpriority, o_orderstatus]) AS part FROM @orders) WHERE part <> ''")


@query("f16_strip_widget", r"SELECT page_id, CASE WHEN len(regexp_extract_all(html, '<nav>')) = len(regexp_extract_all(html, '</nav>')) THEN regexp_replace(html, '(?s)<nav>.*?</nav>', '', 'g') ELSE html END AS kept FROM pages")
def strip_widget(spark, sf):
    """A block goes where its markers balance; an unbalanced page stays as it is."""
    balanced = F.regexp_count("html", F.lit("<nav>")) == F.regexp_count("html", F.lit("</nav>"))
    return table(spark, sf, "pages").select("page_id", F.when(balanced, F.regexp_replace("html", r"(?s)<nav>.*?</nav>", "")).otherwise(F.col("html")).alias("kept"))


def _vote_sql() -> str:
    hits = ", ".join(f"count(*) FILTER (WHERE term IN ({', '.join(repr(w) for w in ws)})) AS {g}" for g, ws in STOPWORDS.items())
    return f"WITH h AS (SELECT doc_id, {hits} FROM @tokens GROUP BY doc_id) SELECT doc_id, CASE WHEN greatest(en, de, fr, es) < 3 THEN 'unknown' WHEN en * 5 >= 6 * greatest(de, fr, es) THEN 'en' WHEN de * 5 >= 6 * greatest(en, fr, es) THEN 'de' WHEN fr * 5 >= 6 * greatest(en, de, es) THEN 'fr' WHEN es * 5 >= 6 * greatest(en, de, fr) THEN 'es' ELSE 'unknown' END AS vote FROM h"


@query("f17_language_vote", _vote_sql())
def language_vote(spark, sf):
    """Stopword hits by language; a vote needs three hits and a margin of one fifth."""
    words = table(spark, sf, "documents").select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
    h = words.groupBy("doc_id").agg(*[F.count_if(F.col("term").isin(ws)).alias(g) for g, ws in STOPWORDS.items()])
    vote = F.when(F.greatest(*STOPWORDS) < 3, "unknown")
    for g in STOPWORDS:
        vote = vote.when(F.col(g) * 5 >= 6 * F.greatest(*[o for o in STOPWORDS if o != g]), g)
    return h.select("doc_id", vote.otherwise("unknown").alias("vote"))


sql("f18_language_by_url", "SELECT page_id, CASE WHEN url LIKE '%/de/%' THEN 'de' WHEN url LIKE '%/fr/%' THEN 'fr' WHEN url LIKE '%/es/%' THEN 'es' ELSE 'en' END AS lang, (html LIKE '%lang=_en_%') <> (url LIKE '%/en/%') AS disagrees FROM @pages")
query("f19_truncate_lead", r"SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE regexp_replace(substr(text, 1, 300), ' [^ ]*$', '') || '…' END AS lead FROM documents")(lambda spark, sf: table(spark, sf, "documents").select("doc_id", tx.truncate_words(F.col("text")).alias("lead")))
query("f20_first_sentence", "SELECT doc_id, substr(regexp_extract(text, '^[^.!?]+[.!?]'), 1, 180) AS first_sentence FROM documents")(lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.substring(tx.first_sentence(F.col("text")), 1, 180).alias("first_sentence")))
sql("f21_url_and_format", "SELECT n_nationkey, concat('/tag/', replace(lower(n_name), '_', '-'), '/') AS permalink, lpad(CAST(n_nationkey AS VARCHAR(9)), 3, '0') AS padded, n_name LIKE 'NATION%' AS prefixed FROM @nation")


_CHUNKS = r"SELECT doc_id, k AS chunk, len(w[k * 80 + 1 : k * 80 + 80])::BIGINT AS n_words, array_to_string(w[k * 80 + 1 : k * 80 + 80], ' ') AS chunk_text FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents), unnest(range(CAST(ceil(len(w) / 80.0) AS BIGINT))) AS t(k)"


@query("f22_chunk_words", _CHUNKS)
def chunk_words(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(tx.chunk_texts(F.col("text"), 80)).alias("chunk", "piece"))
    ws = F.regexp_extract_all("piece", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size(ws).cast("long").alias("n_words"), F.array_join(ws, " ").alias("chunk_text"))


def _pieces_sql(most: int) -> str:
    """Lines added to the last piece while it holds them, as one string with chr(1) between pieces."""
    last = "regexp_extract(s, '[^\\x01]*$')"
    return rf"""
WITH p AS (SELECT doc_id, CASE WHEN length(text) <= {most} THEN [text] ELSE list_filter(string_split(list_reduce(string_split(text, chr(10)),
  lambda s, l: CASE WHEN {last} = '' THEN s || l WHEN length({last}) + 1 + length(l) > {most} THEN s || chr(1) || l ELSE s || chr(10) || l END), chr(1)), lambda x: x <> '') END AS ps FROM documents)
SELECT doc_id, unnest(range(len(ps)))::INT AS pos, unnest(ps) AS piece FROM p"""


query("f23_pieces", _pieces_sql(600))(lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.posexplode(tx.paragraph_pieces(F.col("text"), 600)).alias("pos", "piece")))
query("f24_prefix", f"SELECT doc_id, chunk, 'passage: ' || chunk_text AS prefixed FROM ({_CHUNKS})")(lambda spark, sf: chunk_words(spark, sf).select("doc_id", F.col("chunk"), F.concat(F.lit("passage: "), "chunk_text").alias("prefixed")))
#: Sentences by a mark put after each end, as RE2 has no lookbehind.
_SENTENCES = r"(SELECT doc_id, unnest(range(len(ss)))::INT AS pos, unnest(ss) AS sentence FROM (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text), '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss FROM documents))"
query("f25_sentences", f"SELECT * FROM {_SENTENCES}")(lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence")))
@query("f26_matches_lemma", """
WITH t AS (SELECT DISTINCT term FROM @tokens), l AS (SELECT substr(term, 1, 5) AS p, count(*) AS n, min(term) AS lo, max(term) AS hi FROM t GROUP BY 1),
f AS (SELECT term, substr(term, 1, k) AS p FROM t, unnest(range(1, least(length(term), 5) + 1)) AS u(k))
SELECT term, CAST(sum(n) AS BIGINT) AS n_lemmas, min(lo) AS first_lemma, max(hi) AS last_lemma FROM f JOIN l USING (p) GROUP BY term""")
def matches_lemma(spark, sf):
    """Each term as a form: how many terms are a lemma that it matches, the first and the last of them.

    Lemmas of one prefix match the same forms, so they are counted as one class; no pair is written out. A lemma's key is its first
    five letters, or all of it; a form has a key for each of its prefixes up to five letters.
    """
    terms = table(spark, sf, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("term")).distinct()
    classes = terms.groupBy(F.substring("term", 1, 5).alias("p")).agg(F.count("*").alias("n"), F.min("term").alias("lo"), F.max("term").alias("hi"))
    prefixes = F.transform(F.sequence(F.lit(1), F.length("head")), lambda n: F.substr(F.col("head"), F.lit(1), n))
    forms = classes.select(F.col("p").alias("head")).select("head", F.explode(prefixes).alias("p"))
    found = forms.join(classes, "p").groupBy("head").agg(F.sum("n").alias("n_lemmas"), F.min("lo").alias("first_lemma"), F.max("hi").alias("last_lemma"))
    return terms.withColumn("head", F.substring("term", 1, 5)).join(found, "head").select("term", "n_lemmas", "first_lemma", "last_lemma")


_EVIDENCE = ("the", "of", "que", "der", "las")


def _scored_sentences(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))
    ws = tx.tokens(F.col("sentence"))
    rows = rows.withColumn("ws", F.array_distinct(ws))
    # a term counts once, if any word of the sentence is a form of it

    def has_form_of(lemma: str):
        return F.exists("ws", lambda w: tx.matches_lemma(w, F.lit(lemma)))

    return rows.withColumn("score", sum(has_form_of(t).cast("int") for t in _EVIDENCE))


_TOLD = "(SELECT doc_id, pos, sentence, (" + " + ".join(f"(len(list_filter(ws, lambda w: starts_with(w, '{t[:5]}'))) > 0)::INT" for t in _EVIDENCE) + f")::INT AS score FROM (SELECT *, regexp_extract_all(lower(sentence), '{tx.TOKEN}') AS ws FROM {_SENTENCES}))"
query("f27_sentence_terms", f"SELECT doc_id, pos, score FROM {_TOLD}")(lambda spark, sf: _scored_sentences(spark, sf).select("doc_id", "pos", "score"))


@query("f38_evidence_quote", f"SELECT doc_id, sentence, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS r FROM {_TOLD} WHERE length(sentence) <= 260 AND score > 0) WHERE r = 1")
def evidence_quote(spark, sf):
    """The sentence of 260 characters at most with most distinct terms; the earliest of equals."""
    rows = _scored_sentences(spark, sf).where("length(sentence) <= 260 AND score > 0")
    best = rows.groupBy("doc_id").agg(F.max_by(F.struct("sentence", "score", "pos"), F.struct("score", -F.col("pos"))).alias("b"))
    return best.select("doc_id", "b.sentence", "b.score", "b.pos")


sql("f28_parse_tag", r"SELECT event_id, element_at(split(regexp_extract(tag, r'^\[/?([^\]]*)\]', 1), '[|]'), 1) AS pos FROM (SELECT event_id, concat('[/', CASE WHEN event_id % 2 = 0 THEN 'N|Pro' ELSE 'V' END, '][Nom]') AS tag FROM @events)", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'N' ELSE 'V' END AS pos FROM @events")


_ENDINGS = ("eket", "ban", "on", "nek", "teszt", "hez")


@query("f30_normalise_lemma", rf"""
WITH f AS (SELECT DISTINCT unnest([term, 'X' || term || '-' || e, term || '-' || e]) AS lemma FROM (SELECT term, (['{"', '".join(_ENDINGS)}'])[1 + length(term) % {len(_ENDINGS)}] AS e FROM (SELECT DISTINCT term FROM @tokens)))
SELECT lemma, {_normal_sql("lemma")} AS clean FROM f""")
def normalised(spark, sf):
    """Every term of the documents as a lemma, and with an ending behind a hyphen, as it stands and with a capital."""
    terms = table(spark, sf, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("term")).distinct()
    ending = F.get(F.array(*[F.lit(e) for e in _ENDINGS]), F.length("term") % len(_ENDINGS))
    lemmas = terms.select(F.explode(F.array("term", F.concat(F.lit("X"), "term", F.lit("-"), ending), F.concat("term", F.lit("-"), ending))).alias("lemma")).distinct()
    return lemmas.withColumn("clean", un.normalise_lemma(F.col("lemma")))


query("f32_hash_split", "SELECT doc_id, CASE WHEN ('0x' || right(sha1(doc_id::VARCHAR), 1))::INT % 2 = 0 THEN 'dev' ELSE 'test' END AS part FROM documents")(lambda spark, sf: table(spark, sf, "documents").select("doc_id", tx.split_of(F.col("doc_id").cast("string")).alias("part")))
sql("f33_hashes", "SELECT doc_id, sha2(text, 256) AS sha256, md5(text) AS md5 FROM @documents", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM @documents")
sql("f40_dates", "SELECT event_id, CAST(year(ts) AS BIGINT) AS y, date_format(ts, 'yyyy.MM.dd') AS shown, CAST(date_add(CAST(ts AS DATE), 10) AS STRING) AS later, CAST(date_trunc('WEEK', ts) AS DATE) AS week FROM @events", "SELECT event_id, CAST(year(ts) AS BIGINT) AS y, strftime(ts, '%Y.%m.%d') AS shown, strftime(ts::DATE + 10, '%Y-%m-%d') AS later, date_trunc('week', ts)::DATE AS week FROM @events")
sql("f41_timestamps", "SELECT event_id, date_format(to_timestamp(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), 'yyyy-MM-dd HH:mm:ss'), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS iso FROM @events", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM @events")
sql("f42_math", "SELECT event_id, value + 1 AS plus, value * 2 AS twice, event_id % 7 AS rest, sqrt(abs(value)) AS root, bround(value * 10, 0) AS even FROM @events", "SELECT event_id, value + 1 AS plus, value * 2 AS twice, event_id % 7 AS rest, sqrt(abs(value)) AS root, round_even(value * 10, 0) AS even FROM @events")
sql("f43_arrays", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names, size(collect_list(n_name)) AS n, array_contains(collect_list(n_nationkey), 3) AS has_3 FROM @nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names, len(list(n_name))::INT AS n, list_contains(list(n_nationkey), 3) AS has_3 FROM @nation GROUP BY n_regionkey")
sql("f44_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM @events", "SELECT event_id, (props::JSON->>'$.k')::INT AS k FROM @events")
