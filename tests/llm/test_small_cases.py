"""Every operator on nulls, empty and long texts, ties, repeats, empty tables and extra columns; brute force on random documents."""

import hashlib
import pathlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, exact_dedup, html_extract, line_dedup, mixing, ngram_join, quality_rules, substring_dedup, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, sha string, size int, keep_id string"


def table(spark, rows):
    """rows of (doc_id, text, source); further columns clash with names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", 7, "z") for i, t, s in rows], SCHEMA).repartition(3)


def random_rows(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 60))] for _ in range(25)]
    rows = []
    for i in range(n):
        ws = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(ws))
            ws[k : k + 1] = rng.choice([[], [rng.choice(words)], [ws[k], rng.choice(words)]]) or [rng.choice(words)]
        for k in range(0, len(ws), 12):
            ws[k] = "\n" + ws[k]
        rows.append((i, " ".join(ws), rng.choice(["a", "b", "c"])))
    odd = [None, "", "   \n\t ", "one", "A b  C d", "é ñ ß 漢字   x", "tok " * 3000, "same line of five words\nsame line of five words"]
    return rows + [(n + k, t, None if k % 2 else "a") for k, t in enumerate(odd)]


@pytest.fixture(scope="module")
def rows():
    return random_rows(5)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, []).limit(0)


def words(t):
    return WORD.findall(t or "")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_exact_dedup(docs, rows, none):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, slice_rows=50).collect()}
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    for i, t, _ in rows:
        g = groups[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(g), len(g), i == max(g), sha(t or ""))
    assert len(got) == len(rows)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_quality_rules(docs, rows, none):
    got = {r.doc_id: r for r in quality_rules.ledger(docs).collect()}
    for i, t, _ in rows:
        ws = words(t)
        grams = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
        n = Counter(grams)
        cover = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(ws), sum(map(len, ws)), len(cover), len(lines) - len(set(lines)))
        assert bool(r.fail_bits & 1) == (len(ws) < 50)
    assert quality_rules.ledger(none).count() == 0
    rule = {r.rule: r for r in quality_rules.ablation(quality_rules.ledger(docs)).collect()}
    assert rule["few_words"].n_fails == sum(len(words(t)) < 50 for _, t, _ in rows)


def test_ablation_query_and_sql(spark, docs, rows, tmp_path):
    """Counts by rule against the ledger's own columns read one by one, and the SQL on the same rows."""
    import duckdb

    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.rule: (r.n_fails, r.n_alone, r.n, r.n_rejected) for r in quality_rules.ablation_quality_rules(spark, str(tmp_path)).collect()}
    fails = []
    for _, t, _ in rows:
        n, chars, symbols, lines, dup, repeat = quality_rules.measure(t)
        checks = {"few_words": n < 50, "repeated_words": 2 * repeat > n, "symbols": 10 * symbols > n, "repeated_lines": lines >= 4 and 2 * dup > lines, "short_words": chars < 2 * n, "long_words": chars > 20 * n}
        fails.append({r for r, bad in checks.items() if bad})
    rejected = sum(map(bool, fails))
    assert got == {r: (sum(r in f for f in fails), sum(f == {r} for f in fails), len(rows), rejected) for r in checks}
    assert got["few_words"][1] > 0 and got["repeated_words"][1] > 0
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {r[0]: tuple(r[1:]) for r in con.sql(quality_rules.ABLATION_ORACLE).fetchall()} == got


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * (10 if i % 2 else 30), "en") for i in range(40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(40)], "doc_id long, toxic int")
    taken = toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic", "lang", 5, 20, (0, 1, 3))
    assert 0 < len(taken) <= 10 and all(i % 2 and t == "x" * 10 for _, i, t, _, _ in taken)
    assert len(toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic", "lang", 5, 30, (0, 1, 3))) == 10


def test_mixing(docs, rows, none):
    got = mixing.mix(docs, part_rows=20).collect()
    size = {s: sum(len(words(t)) for _, t, x in rows if x == s) for s in ("a", "b", "c", None)}
    goal = mixing.targets(size)
    taken = Counter()
    for r in got:
        assert r.taken <= 2 * r["size"] and r.source_size == size[r.source]
        assert abs(r.target - goal[r.source]) < 1e-6
        taken[r.source] += r.taken
    for s, n in goal.items():
        assert abs(taken[s] - n) <= max(2, 0.02 * n), (s, taken[s], n)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7), part_rows=20).collect()), key=str)
    assert mixing.mix(none).count() == 0
    again = Counter(r.doc_id for r in mixing.mixed_rows(docs).collect())
    assert all(n <= 2 for n in again.values())


def test_targets_reshare():
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == {"a": 200.0, "b": pytest.approx(250 / 3), None: pytest.approx(500 / 3)}
    assert mixing.targets({"a": 0}) == {"a": 0.0} and mixing.targets({}) == {}


def jaccard_brute(rows, need=80):
    sets = {}
    for i, t, _ in rows:
        ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= need * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_classes(spark, seed, none):
    rows = random_rows(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(table(spark, rows)).collect()}
    assert got == jaccard_brute(rows)
    assert ngram_join.jaccard_classes(none).count() == 0


def test_jaccard_without_rounds(spark):
    """All links of several classes come from the exhaustive step."""
    rows = random_rows(9)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(table(spark, rows), rounds=0).collect()}
    assert got == jaccard_brute(rows)


def test_line_dedup(spark, docs, rows, none):
    lines = [(i, k, frozenset(words(x))) for i, t, _ in rows for k, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    gone = {(b[0], b[1]) for k, b in enumerate(lines) for a in lines[:k] if 100 * len(a[2] & b[2]) >= 80 * len(a[2] | b[2])}
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    for i, t, _ in rows:
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert got[i].text == want
    assert line_dedup.line_dedup(none).count() == 0


def test_line_dedup_query_takes_short_lines(spark, tmp_path):
    """The query and the pipeline leave no repeat behind for being short."""
    import corpus_pipeline

    rng = random.Random(11)
    rows = [(i, "\n".join(" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 7))) for _ in range(6)), "a") for i in range(60)]
    rows += [(60, "ha ha ha ha ha ha\nzz", "a"), (61, "zz\nha ha\n\n \nnew", "a"), (62, "p q r s\np q r s t\nt p q r", "a"), (63, "new\n", "a"), (64, None, "a")]
    lines = [(i, k, frozenset(words(x))) for i, t, _ in rows for k, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    gone = {(b[0], b[1]) for k, b in enumerate(lines) for a in lines[:k] if 100 * len(a[2] & b[2]) >= 80 * len(a[2] | b[2])}
    want = {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone) for i, t, _ in rows}
    assert want[61] == "\n \nnew" and want[62] == "p q r s" and want[63] == ""
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_removed, r.text_sha256) for r in line_dedup.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (sum(g[0] == i for g in gone), sha(x)) for i, x in want.items()}
    kept = {r.doc_id: r.text for r in corpus_pipeline.without_repeated_lines(spark, table(spark, rows), str(tmp_path)).collect()}
    assert kept == {i: x if t is not None else None for (i, t, _), x in zip(rows, want.values()) if words(x) or not any(g[0] == i for g in gone)}


def test_line_dedup_asks_again(docs, rows, monkeypatch):
    """Lines that the few offers do not resolve are compared with all candidates."""
    want = {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()}
    monkeypatch.setattr(line_dedup, "OFFERS", 1)
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()} == want


def test_repeated_ids(spark):
    twice = table(spark, [(1, "a b c d e f", "a"), (1, "a b c d e f", "a"), (1, "g h i j k l", "a"), (2, "a b c d e f", "a"), (None, "a b c d e f", "a")])
    assert line_dedup.line_dedup(twice).count() == 5
    assert ngram_join.jaccard_classes(twice).count() == 5
    assert exact_dedup.exact_dedup(twice).count() == 5
    assert substring_dedup.substring_dedup(twice).count() == 5
    assert mixing.mix(twice).count() == 5


def test_substring_dedup(docs, rows, none):
    n = 13
    first = {}
    for i, t, _ in rows:
        ws = words(t)
        for k in range(len(ws) - n + 1):
            g = tuple(ws[k : k + n])
            first[g] = min(first.get(g, i), i)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    for i, t, _ in rows:
        ws = words(t)
        gone = {k + j for k in range(len(ws) - n + 1) if first[tuple(ws[k : k + n])] < i for j in range(n)}
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone))
    assert substring_dedup.substring_dedup(none).count() == 0


def test_substring_dedup_frequent_anchors(docs, rows, monkeypatch):
    want = {tuple(r) for r in substring_dedup.substring_dedup(docs).collect()}
    monkeypatch.setattr(substring_dedup, "ANCHOR_SEGMENTS", 1)
    assert {tuple(r) for r in substring_dedup.substring_dedup(docs).collect()} == want


def test_bpe_round_trip(spark, docs, rows, none):
    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    gold = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for kw in ({}, {"chunk": 200, "overlap": 60}, {"chunk": 200, "overlap": 60, "long_chars": 300}):
        got = {r.doc_id: list(r.ids) for r in bpe.bpe(docs, ranks, public_tokenizers.PATTERN, **kw).collect()}
        assert got == {i: gold.encode_ordinary(t or "") for i, t, _ in rows}
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    assert all(codec.decode(codec.encode(t)) == (t or "").encode() for _, t, _ in rows)
    assert bpe.bpe(none, ranks, public_tokenizers.PATTERN, mode="digest").count() == 0


def test_bpe_chunks_anywhere():
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    whole, cut = bpe.Codec(ranks, public_tokenizers.PATTERN), bpe.Codec(ranks, public_tokenizers.PATTERN, chunk=120, overlap=50)
    rng = random.Random(3)
    parts = ["a", " ", "  ", "\n", "'re", "é", "12", "?!", " " * 9, "<|endoftext|>", "\t", "z" * 150]
    for _ in range(200):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 200)))
        assert cut.pretokens(text) == whole.pretokens(text)


def test_toxicity(spark, none):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join([rng.choice(words) for _ in range(40)] + (["vile" + rng.choice("abc")] * 2 if i % 5 == 0 else [])), "a") for i in range(900)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, model).collect()}
    import zlib

    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i] == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    odd = table(spark, [(1, None, "a"), (2, "", "a"), (2, "x " * 50_000, None)])
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(odd, model).collect())
    assert toxicity.toxicity(none, model).count() == 0
    assert toxicity.fit(docs, labels.where("toxic = 0")) == 0.0


def test_toxicity_learns_from_rows_beyond_the_sample(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    # one kind of toxic text is in short texts, the other only in those that are too long for the sample
    rows = [(i, " ".join([rng.choice(words) for _ in range(40 if i % 2 else 90)] + (["vile" if i % 2 else "grim"] * 2 if i % 4 < 2 else [])), "a") for i in range(1200)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 < 2)) for i, _, _ in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, toxicity.fit(docs, labels, sample=100, sample_chars=200)).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i] == (i % 4 < 2) for i in held) >= 0.95 * len(held)


def test_toxicity_shuffles_labelled_texts_only_and_leaves_no_table(spark):
    docs = table(spark, [(i, "t" * (i % 7) if i % 11 else None, "a") for i in range(4000)])
    labels = spark.createDataFrame([(i, int(i % 40 == 0)) for i in range(0, 5000, 20)], "doc_id int, toxic int")
    folds = {i for i in range(0, 4000, 20) if zlib.crc32(str(i).encode()) % 4 in (0, 1, 3)}
    rows = docs.select(F.col("doc_id").alias("id"), "text", "lang")
    taken = [r.id for r in toxicity._candidates(rows, toxicity._pool(labels, "doc_id", "toxic", (0, 1, 3)), (0, 1, 3)).collect()]
    assert folds <= set(taken) and len(taken) < len(folds) + 40
    got = toxicity.labelled(docs, labels, "doc_id", "text", "toxic", "lang", (0, 1, 3)).collect()
    assert {(r.id, r.y) for r in got} == {(i, int(i % 40 == 0)) for i in folds} and len(got) == len(folds)
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("*/*/*.parquet"))
    toxicity.fit(docs, labels, sample=20)
    assert set(shared.glob("*/*/*.parquet")) == before


def test_toxicity_weights_as_one_matrix():
    model, other = toxicity.Model(64, 16, 12, 3), toxicity.Model(64, 16, 12, 4)
    other.load(model.flat())
    texts = [["a", "b", "c"], [], ["d"] * 9]
    assert (model.logits(texts) == other.logits(texts)).all() and (other.flat() == model.flat()).all()


PAGE = "<html><head><title>no</title><script>var a='<p>no</p>'</script></head><body><header class=site-header><p>no</p></header><nav><ul><li><a href=/>no</a></ul></nav><div class='cookie-banner'>no, no.</div><article><h1>Big &amp; small</h1><p>First  one\n here.<p>Second <b>one</b>.</p><div class=ad>no</div><form><label>no</label></form></article><aside class=sidebar><p>no</p></aside><section id=comments><h3>no</h3><p>no no.</p></section><footer>no</footer>"


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (2, None, None, 2), (3, "u", "", 3), (3, "u", "<p", 3), (4, "u", "<article>" + "<p>long text here." * 5000, 4)], "page_id long, url string, html string, text int")
    got = [r for r in html_extract.extract(pages).collect()]
    text = {r.page_id: r.text for r in got}
    assert text[1] == "Big & small\nFirst one here.\nSecond one."
    assert text[2] == "" and len(got) == 5 and text[4].count("\n") == 4999
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_held_out():
    pages = html_extract.training_set(html_extract.labelled_pages(150, 77))
    field = html_extract.trained_field()
    wrong = sum(sum(a != b for a, b in zip(field.viterbi(field.scores(field.ids(x))), y)) for x, y in pages)
    assert wrong <= 0.01 * sum(len(y) for _, y in pages)


def test_url_filter(spark):
    urls = [None, "", "no-scheme", "http://A.Net", "https://x.NET/a?b", "http://example.net/en/1", "http://www.example.net/en/2#x", "http://s.example.com/de/3", "http://q.org/fr/x", "http://notnet/a", "http://q.org/fr", "http://h.com//a//b/c/d/e/f"]
    pages = spark.createDataFrame([(k, u, "host") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.net", "", None, "allow") and got[4] == ("x.net", "/a", "net/", "block")
    assert got[5][2:] == ("example.net/en/", "allow") and got[6][2:] == ("example.net/en/", "allow")
    assert got[7][2:] == ("example.com/de/", "block") and got[8][2:] == ("org/fr/", "allow")
    assert got[9][2:] == (None, "allow") and got[10][2] is None
    assert url_filter.url_filter(pages.limit(0)).count() == 0


def test_url_templates_reject(spark):
    """Urls of a host whose like templates are blocked go too, where the evidence is enough."""
    pages = spark.createDataFrame([(k, f"http://h.com/s{k}/x{j}") for k in range(40) for j in range(3)], "page_id long, url string")
    # 40 first segments are one wildcard; of its labelled urls all, or three quarters, are blocked
    for allowed, verdict in ((0, "block"), (8, "allow")):
        rules = [(f"h.com/s{k}/", "allow" if k < allowed else "block") for k in range(32)]
        got = url_filter.url_filter(pages, rules=rules).where("rule IS NULL").select("verdict").distinct().collect()
        assert [r.verdict for r in got] == [verdict]


def test_url_labels_pool_up_the_tree(spark):
    """A template without labels has its first segment's purity, and that one its host's."""
    urls = [f"http://h.com/bad/{k}" for k in range(30)] + [f"http://h.com/good/{k}" for k in range(10)] + ["http://h.com/other", "http://h.com/bad/x/y", "http://new.org/other"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for rules, host in (([("h.com/bad/1", "block"), ("h.com/bad/2", "block")], (22 + 1) / (22 + 2)), ([("h.com/bad/1", "block"), ("h.com/bad/2", "block"), ("h.com/good/", "allow")], (22 + 1) / (32 + 2))):
        got = {r.page_id: r for r in url_filter.url_filter(pages, rules=rules).collect()}
        first = (22 + 2 * host) / (22 + 2)
        assert got[40].purity == host and got[40].verdict == ("block" if host >= 0.9 else "allow")
        assert got[41].purity == (0 + 2 * first) / 2 and got[41].verdict == "block"
        assert got[5].purity == (22 + 2 * first) / (22 + 2) and got[5].rule is None and got[5].verdict == "block"
        assert got[42].purity == 0.5 and got[42].verdict == "allow"


def test_fm_index():
    import numpy as np

    from corpusloom.llm.fm_index import FMIndex

    rng = np.random.default_rng(0)
    text = rng.integers(1, 6, 400)
    text[[50, 120, 399]] = 0
    index = FMIndex(text, 8)
    query = rng.integers(1, 7, 300)
    for n in (1, 3, 8):
        got = index.matching(query, n)
        want = [sum((text[k : k + n] == query[s : s + n]).all() for k in range(len(text) - n + 1)) for s in range(len(query) - n + 1)]
        assert got.tolist() == want


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<article><p>one</p><svg width=1 /><p>two</p></article>", ["one", "two"]),
        ("<article><p>one</p><iframe src=x><p>two</p></article>", ["one", "two"]),
        ("<p>a < b &lt; c</p><script>x<y</script><p>d</p>", ["a < b < c", "d"]),
        ("<p title='a>b'>q</p><object>zz</object>r", ["q", "r"]),
        ("<p>x</p><script>never ends <p>y</p>", ["x"]),
        ("<p>x<!-- <p>y</p> -->z</p>", ["xz"]),
    ],
)
def test_markup(page, texts):
    assert [b.text for b in html_extract.leaf_blocks(page)] == texts


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<!", "<!--", "<script ", "<iframe>", "<svg>", '<a ">" ', "<div>x", "</p>"])
def test_markup_is_linear(piece):
    """A megabyte of what never ends takes seconds."""
    import time

    began = time.perf_counter()
    html_extract.leaf_blocks(piece * (1_000_000 // len(piece)) + "'>")
    assert time.perf_counter() - began < 30


def test_viterbi_and_sums_against_all_labellings():
    """The best labelling, label probabilities, expected moves and the sum over all labellings, by enumeration of short chains."""
    import itertools

    rng = np.random.default_rng(5)
    for n in (1, 2, 6):
        field = html_extract.Field({})
        field.step, s = rng.normal(size=(2, 2)), rng.normal(size=(n, 2))
        paths = np.array(list(itertools.product((0, 1), repeat=n)))
        score = np.array([sum(s[k, y[k]] for k in range(n)) + sum(field.step[y[k], y[k + 1]] for k in range(n - 1)) for y in paths])
        assert list(paths[int(np.argmax(score))]) == field.viterbi(s)
        p, moves, z = field.marginals(s)
        share = np.exp(score) / np.exp(score).sum()
        assert z == pytest.approx(np.log(np.exp(score).sum()))
        assert p[:, 1] == pytest.approx((share[:, None] * paths).sum(axis=0))
        want = np.zeros((2, 2))
        for y, w in zip(paths, share):
            for k in range(n - 1):
                want[y[k], y[k + 1]] += w
        assert moves == pytest.approx(want)


def test_rows_with_helper_names(spark):
    """Columns that are called like helper columns come back as they were."""
    names = ["number", "key", "hash", "owner", "row", "lines", "name", "copies", "copy", "_key", "_lines"]
    rows = [(str(k), "a b c d e f\ng h" if k < 3 else None, "s", *(f"{c}{k}" for c in names)) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string, " + ", ".join(f"`{c}` string" for c in names))
    out = line_dedup.line_dedup(docs).collect()
    assert {(r.doc_id, r.text) for r in out} == {("0", "a b c d e f\ng h"), ("1", ""), ("2", ""), ("3", None), ("4", None)}
    assert {tuple(r[c] for c in names) for r in out} == {x[3:] for x in rows}
    again = mixing.mixed_rows(docs)
    assert again.columns == docs.columns and {tuple(r[c] for c in names) for r in again.collect()} <= {x[3:] for x in rows}


def test_ids_of_other_types(spark):
    """Ids are ordered as their type orders them."""
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [("b", passage + " tail"), ("a10", "head " + passage), ("a9", None), (None, passage)]
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept) for r in out} == {("a10", 21, 0, "head " + passage), ("b", 21, 20, "tail"), ("a9", 0, 0, ""), (None, 20, 0, passage)}
