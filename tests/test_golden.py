"""Worked examples as data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import unicode as un
from corpusloom.functions import vectors as vx
from corpusloom.operators import evaluate, gate, hubs, keyness, labels, placement
from corpusloom.operators.discover import average_linkage


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, plain",
    [
        ("Lásd [ezt](http://a.b) és <b>ezt</b>.", "Lásd ezt és ezt."),
        ("## **Hírek** a hétről", "Hírek a hétről"),
        ("Kép: %25255BUNSET%25255D.jpg itt.", "Kép: itt."),
        ("Szöveg\n\n```\nkód\n```\n\nmég szöveg", "Szöveg még szöveg"),
    ],
)
def test_strip_markup(spark, raw, plain):
    assert one(spark, tx.strip_markup(F.col("t")), t=raw) == plain


def test_wordlike(spark):
    good = ["nyelv", "R", "nyest.hu", "scikit-learn"]
    bad = ["„", "�", ":D", "-", "10%", "", "tanul/tanul", "valós****_idejű", "we'd"]
    rows = spark.createDataFrame([(w,) for w in good + bad], "w string").select("w", F.col("w").rlike(tx.WORDLIKE).alias("ok")).collect()
    assert {r.w for r in rows if r.ok} == set(good)


def test_content_word(spark):
    tags = {"[/N][Ine]": True, "[/V][Pst.Def.3Sg]": True, "[/Det|Art.Def]": False, "[Punct]": False, "[/N|Pro|(Post)][Nom]": False}
    for tag, want in tags.items():
        assert one(spark, tx.content_word(F.col("t"), False), t=tag) is want
    assert one(spark, tx.content_word(F.col("t"), True), t="[/N|Pro|(Post)][Nom]") is True


def test_normalise_lemma(spark):
    clean = lambda xs: [r.x for r in spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x string").orderBy("k").select(un.normalise_lemma(F.col("x")).alias("x")).collect()]
    got = clean(("LLM-ek", "Facebook-on", "API-hoz", "LLM-eket", "API-kban", "GPU-knak", "Turing-teszt", "hands-on", "e-könyv", "bu", "vi", "to", "ad", "R", "év"))
    assert got == ["LLM", "Facebook", "API", "LLM", "API", "GPU", "Turing-teszt", "hands-on", "e-könyv", None, None, None, "ad", "R", "év"]
    assert clean([x for x in got if x]) == [x for x in got if x]
    # cases of our own: endings upon endings, no stem, other scripts, nothing
    assert clean(["GPU-k-nak", "-ben", "őz-ben", "Őz-ben", "x2-t", "a-b-c", "work-on", "Work-on", "", None, "a1", "12", "é"]) == ["GPU", "-ben", "őz-ben", "Őz", None, "a-b-c", "work-on", "Work", None, None, None, "12", "é"]


def test_slugs(spark):
    assert one(spark, tx.hub_slug(F.col("t")), t="gepi tanulas") == "gepi-tanulas"
    assert one(spark, tx.hub_slug(F.col("t")), t="nyest.hu") == "nyest-hu"
    assert one(spark, tx.term_directory(F.col("t")), t="gépi tanulás") == "gépi-tanulás"
    assert one(spark, tx.import_slug(F.col("t")), t="!!!") == "bejegyzes"
    rows = spark.createDataFrame([("difﬁcult",), ("Médium",)], "t string").select(un.nfkc("t").alias("n"), un.fold("t").alias("f")).collect()
    assert rows[0].n == "difficult" and rows[1].f == "medium"


def test_chunks(spark):
    ws = F.split(F.col("t"), " ")
    text = " ".join(["a"] * 200)
    assert [len(c) for c in one(spark, tx.chunks(ws, 80), t=text)] == [80, 80, 40]
    assert [len(c.split()) for c in one(spark, tx.chunk_texts(F.col("t"), 80), t="\t" + text + "\n")] == [80, 80, 40]
    assert one(spark, tx.chunk_texts(F.col("t"), 80), t=" ") == []


def test_matches_lemma(spark):
    for surface, lemma, want in (("metaforákról", "metafora", True), ("nyelvészetben", "nyelv", True), ("adatbázisról", "adat", True), ("nyelvtan", "gép", False), ("Gépi", "gépi", True)):
        assert one(spark, tx.matches_lemma(F.col("s"), F.col("l")), s=surface, l=lemma) is want


def test_keyness(spark):
    docs = [(1, "metafora " * 4 + "nyelv " * 3), (2, "kutya " * 30 + "nyelv " * 20), (3, "ház " * 30 + "nyelv " * 20)]
    top = keyness.top_keywords(spark.createDataFrame(docs, "doc_id int, text string")).where("doc_id = 1 AND rank = 1").first()
    assert (top.term, top.focus) == ("metafora", 4)
    assert keyness.top_keywords(spark.createDataFrame([(1, "egy rövid szöveg"), (2, "más")], "doc_id int, text string")).count() == 0


def test_canonical_forms(spark):
    counts = spark.createDataFrame([("NLP", 13), ("nlp", 1), ("Magyar", 2), ("magyar", 13), ("Media", 2), ("média", 2), ("llm", 5), ("LLM", 1)], "term string, n int")
    got = {r.term: r.canonical for r in hubs.canonical_forms(counts).collect()}
    assert got == {"NLP": "NLP", "nlp": "NLP", "Magyar": "magyar", "magyar": "magyar", "Media": "média", "média": "média", "llm": "LLM", "LLM": "LLM"}


def test_clean_labels(spark):
    rows = spark.createDataFrame([("a", "x", "NLP"), ("a", "x", "ajánló"), ("b", "x", "nyelvtechnológia"), ("c", "x", "egyszeri")], "doc_id string, source string, label string")
    genres, merges = spark.createDataFrame([("ajánló",)], "label string"), spark.createDataFrame([("nlp", "nyelvtechnológia")], "label string, target string")
    assert {(r.doc_id, r.label) for r in labels.clean_labels(rows, genres, merges, 2).collect()} == {("a", "nyelvtechnológia"), ("b", "nyelvtechnológia")}


def test_vectors(spark):
    v = F.array(*[F.lit(float(x)) for x in (3, 4)])
    z = F.array(F.lit(0.0), F.lit(0.0))
    row = spark.range(1).select(vx.unit(v).alias("u"), vx.unit(z).alias("z"), vx.mixture(F.array(F.lit(0.3), F.lit(0.3), F.lit(0.15))).alias("m")).first()
    assert row.u == pytest.approx([0.6, 0.8]) and row.z == [0.0, 0.0] and row.m == pytest.approx([0.4, 0.4, 0.2])


def test_thresholds():
    rules = placement.Rules(tau={"long": 0.2}, g={3: 0.2, 5: 0.3, 8: 0.35})
    assert rules.threshold(3, "long") == pytest.approx(0.2) and rules.threshold(8, "long") == pytest.approx(0.25)
    assert placement.Rules(tau={"long": 0.2}, g={3: 0.2, 5: 0.3, 8: 0.35}, one_sided=False).threshold(3, "long") == pytest.approx(0.1)


@pytest.mark.parametrize("sims, seed, want", [([0.9, 0.2], None, [0]), ([0.7, 0.65], None, [0, 1]), ([0.7, 0.55], None, [0]), ([-1.0, -1.0], None, []), ([-1.0, -1.0], 1, [1])])
def test_place(spark, sims, seed, want):
    rules = placement.Rules(tau={"long": 0.5}, delta=0.1)
    rows = spark.createDataFrame([(1, "long", t, 5, s, t == seed) for t, s in enumerate(sims)], "vec_id int, kind string, theme int, k int, sim double, seed boolean")
    assert [r.theme for r in placement.place(rows, rules).orderBy("position").collect()] == want


def test_primary_needs_no_delta(spark):
    """The first theme over its own threshold is taken even if a better one misses its higher bar."""
    rules = placement.Rules(tau={"long": 0.5}, g={5: 0.3, 8: 0.35}, delta=0.0)
    rows = spark.createDataFrame([(1, "long", 0, 8, 0.52, False), (1, "long", 1, 5, 0.50, False)], "vec_id int, kind string, theme int, k int, sim double, seed boolean")
    assert [r.theme for r in placement.place(rows, rules).collect()] == [1]


def test_bcubed(spark):
    items = spark.createDataFrame([("a", ["X"], ["p"]), ("b", ["X"], ["q"]), ("c", ["Y"], ["q"])], "key string, pred array<string>, gold array<string>")
    r = evaluate.bcubed(items).first()
    assert (round(r.precision, 4), round(r.recall, 4), r.n) == (0.6667, 0.6667, 3)


def test_bcubed_matrix(spark):
    import random

    rng = random.Random(4)
    items = [(str(k), rng.sample("ABCD", rng.randint(0, 3)), rng.sample("pqrst", rng.randint(0, 3))) for k in range(40)]
    gold = [i for i in items if i[2]]

    def side(a, b):
        total = 0.0
        for x in gold:
            vals = [min(len(set(x[a]) & set(y[a])), len(set(x[b]) & set(y[b]))) / len(set(x[a]) & set(y[a])) for y in gold if set(x[a]) & set(y[a])]
            total += sum(vals) / len(vals) if vals else 1.0
        return total / len(gold)

    r = evaluate.bcubed(spark.createDataFrame(items, "key string, pred array<string>, gold array<string>")).first()
    assert (r.precision, r.recall, r.n) == (pytest.approx(side(1, 2)), pytest.approx(side(2, 1)), len(gold))


def test_paired_bootstrap(spark):
    """Against drawing the items themselves, pair by pair."""
    rng = np.random.default_rng(3)
    pick = lambda names, most: sorted({names[k] for k in rng.integers(0, len(names), rng.integers(0, most + 1))})
    rows = [(pick("xyz", 2), pick("vw", 1), pick("pqr", 2)) for _ in range(60)]
    scored = [r for r in rows if r[2]]

    def f(drawn, side):
        totals = []
        for num, den in ((side, 2), (2, side)):
            values = []
            for i in drawn:
                met = []
                for j in drawn:
                    one = lambda c: len(set(scored[i][c]) & set(scored[j][c])) or int(i == j and c != 2 and not scored[i][c])  # noqa: B023, E731
                    if one(num):
                        met.append(min(one(num), one(den)) / one(num))
                values.append(np.mean(met))
            totals.append(np.mean(values))
        return 2 * totals[0] * totals[1] / sum(totals)

    def delta(drawn):
        return f(drawn, 1) - f(drawn, 0)

    got = evaluate.paired_bootstrap(spark.createDataFrame(rows, "a array<string>, b array<string>, gold array<string>")).first()
    draws = [delta(rng.integers(0, len(scored), len(scored))) for _ in range(150)]
    low, high = np.percentile(draws, [2.5, 97.5])
    assert got.n == len(scored) and got.delta == pytest.approx(delta(range(len(scored))))
    assert got.low == pytest.approx(low, abs=0.04) and got.high == pytest.approx(high, abs=0.04) and got.low < got.high
    same = spark.createDataFrame([(["x"], ["x"], ["p"]), ([], [], ["q"])], "a array<string>, b array<string>, gold array<string>")
    assert evaluate.paired_bootstrap(same).first()[:3] == (0.0, 0.0, 0.0)
    assert evaluate.paired_bootstrap(same.limit(0)).count() == 0


def test_bootstrap():
    assert evaluate.bootstrap([0.2, 0.4], [0.3, 0.5]) == (pytest.approx(0.1), pytest.approx(0.1), pytest.approx(0.1))


def test_cohesion_and_neighbours(spark):
    rows = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 1, [0.8, 0.6])], "vec_id int, label int, vec array<double>")
    assert evaluate.cohesion_threshold(rows).first().threshold == pytest.approx(0.2)
    four = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.0, 1.0]), (3, 2, [0.1, 0.9])], "vec_id int, label int, vec array<double>")
    assert tuple(evaluate.knn_agreement(four, 1).first()) == (1.0, 4)


def test_linkage():
    import numpy as np

    x = np.array([[1, 0, 0], [0.99, 0.1, 0], [0.98, 0.15, 0], [0, 1, 0], [0, 0.99, 0.1]], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert average_linkage(x.copy(), 0.1, 3) == [[0, 1, 2]] and average_linkage(x.copy(), 0.1, 2) == [[0, 1, 2], [3, 4]]


def test_pieces(spark):
    cut = lambda t, n: one(spark, tx.paragraph_pieces(F.col("t"), n), t=t)
    assert cut("aaa\nbbb\nccc", 7) == ["aaa\nbbb", "ccc"]
    assert cut("aaa", 7) == ["aaa"] and cut("a" * 9, 7) == ["a" * 9] and cut("\n\naaaa\nbbbb", 7) == ["aaaa", "bbbb"]
    text = "\n".join("x" * k for k in range(1, 40))
    assert "\n".join(cut(text, 50)) == text and max(map(len, cut(text, 50))) <= 50


def test_gate(spark):
    """Themes that equal the labels pass against one theme for all; one theme for all does not."""
    rows = [([f"t{k % 8}"], ["all"], [f"l{k % 8}"]) for k in range(80)]
    items = spark.createDataFrame(rows, "new array<string>, base array<string>, gold array<string>")
    good = gate.gate(items, [], resamples=200).first()
    assert good.passed and good.f_new == pytest.approx(1) and (good.coverage, good.mean_themes, good.largest_share) == (1.0, 1.0, 0.125)
    bad = gate.gate(items.select(F.col("base").alias("new"), F.col("new").alias("base"), "gold"), [], resamples=200).first()
    assert not bad.passed and not bad.better and not bad.wide and bad.delta < 0


def test_import_slug_folds_every_accent(spark):
    from pyspark.sql import functions as F

    from corpusloom.functions import text as tx

    cases = {"Čeština šála": "cestina-sala", "Őszi TŰZ": "oszi-tuz", "été": "ete", "ﬁn ½": "fin-1-2", "İstanbul": "istanbul", "½": "1-2", "": "bejegyzes", "Smørrebrød": "sm-rrebr-d", "ế": "e", "ａｂ１": "ab1"}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", tx.import_slug(F.col("s")).alias("slug")).collect()
    assert {r.s: r.slug for r in rows} == cases
