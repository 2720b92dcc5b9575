"""Composed jobs against brute force: moves, discovery, tuning, keywords in order of arrival."""

import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import discover, moves, tune
from corpusloom.operators.lineage import parts_for
from corpusloom.streaming.keywords import KeywordLog

LOG = [(1, "a", "b"), (2, "b", "c"), (3, "x", "x"), (4, "c", "a"), (5, "y", "z"), (6, "a", "d"), (8, "x", "y"), (9, "d", "e")]


def replay(name, at):
    for t, old, new in LOG:
        if (at is None or t > at) and old == name:
            name = new
    return name


def test_renames_are_replayed_by_time(spark):
    log = spark.createDataFrame(LOG, "at long, old string, new string").repartition(3)
    assert {(r.at, r.old, r.new): r.final for r in moves.replayed(log).collect()} == {x: replay(x[2], x[0]) for x in LOG}
    asked = [(n, t) for n in "abcdexyzq" for t in (None, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 99)]
    recorded = spark.createDataFrame(asked, "name string, at long")
    got = {(r.name, r.at): r.current for r in moves.current_names(recorded, log).collect()}
    assert got == {x: replay(*x) for x in asked}
    assert got["a", None] == "e" and got["a", 5] == "e" and got["x", 3] == "y" and got["x", None] == "y"


def test_a_name_of_many_renames_is_cut_into_blocks(spark):
    rng = random.Random(7)
    log = [(t, rng.choice("aaaab"), "c") for t in rng.sample(range(1000), 300)]
    asked = [(n, t) for n in ("a", "b", "c", None) for t in [None, -1, 2000, *rng.sample(range(1000), 40), *(t for t, _, _ in log[:20])]]
    asked = list(dict.fromkeys(asked))
    points = spark.createDataFrame(asked, "name string, at long")
    frame = spark.createDataFrame(log, "at long, old string, new string")
    want = {(n, t): min((x for x, old, _ in log if old == n and (t is None or x > t)), default=None) for n, t in asked}
    for most in (10, 60, 10_000):
        assert {(r.name, r.at): r.next for r in moves._followed(points, frame, most).collect()} == want


def test_parts_of_a_replay_grow_with_the_log(spark):
    assert [parts_for(spark, n) for n in (0, 9_999, 20_000, 1_000_000, 50_000_000)] == [1, 1, 2, 4, 200]
    # no rename has a next one, so no part may be where all of these meet
    log = spark.range(40_000).select(F.col("id").alias("at"), F.concat(F.lit("a"), "id").alias("old"), F.concat(F.lit("b"), "id").alias("new"))
    sizes = [r["count"] for r in moves.replayed(log).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 15_000


def test_unknown_names_abort(spark):
    log = spark.createDataFrame(LOG, "at long, old string, new string")
    registry = spark.createDataFrame([("e",), ("y",)], "name string")
    known = spark.createDataFrame([("a", None), ("x", 0)], "name string, at long")
    assert {r.current for r in moves.current_names(known, log, registry).collect()} == {"e", "y"}
    with pytest.raises(Exception, match="no such name: q"):
        moves.current_names(spark.createDataFrame([("q", 1)], "name string, at long"), log, registry).collect()
    none = log.limit(0)
    assert moves.replayed(none).count() == 0 and moves.current_names(known, none).where("current = name").count() == 2


def test_kinds_and_payload(spark):
    sets = {1: (["a"], ["a"]), 2: ([], []), 3: (["a"], []), 4: ([], ["a"]), 5: (["a"], ["b", "a", "a"]), 6: (["a", "b"], ["b"]), 7: (["a"], ["b"])}
    old = spark.createDataFrame([(k, o) for k, (o, _) in sets.items() if k != 4], "doc_id long, themes array<string>")
    new = spark.createDataFrame([(k, n) for k, (_, n) in sets.items() if k != 3], "doc_id long, themes array<string>")
    got = moves.moves(old, new)
    assert {r.doc_id: r.kind for r in got.collect()} == dict(zip(range(1, 8), ("unchanged", "still none", "loses all", "gains", "widened", "narrowed", "changed"), strict=True))
    assert {(r.old, r.new): r.n for r in moves.flow(got).collect()} == {("a", "a"): 2, ("a", "b"): 3, ("a", None): 1, ("b", "b"): 1}
    one, two = (moves.payload_digest(got.repartition(n), "doc_id", ["doc_id", "old", "new", "kind"], 1).first() for n in (1, 5))
    rows = {r.doc_id: json.dumps({"doc_id": r.doc_id, "old": r.old, "new": r.new, "kind": r.kind}, separators=(",", ":")) for r in got.collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    buckets = {}
    for k, row in rows.items():
        buckets.setdefault(sha(str(k))[:1], []).append(sha(row))
    assert tuple(one) == tuple(two) == (7, sha("".join(sha("".join(sorted(buckets[b]))) for b in sorted(buckets))))


def evidence(text, terms, most):
    best = None
    for s in re.split(r"(?<=[.!?])\s+", text):
        s = s.strip()
        if s and len(s) <= most:
            ws = re.findall(r"\w+", s.lower())
            used = sum(any(w.startswith(t.lower()) for w in ws) for t in terms)
            if used and (best is None or used > best[0]):
                best = used, s
    return best[1] if best else None


@pytest.mark.parametrize("text", ["Bevezető mondat. A metaforák és az agy kapcsolata izgalmas! Vége.", "Agy… agy metafora. Metafora agy!", "", "x" * 500 + " agy. Agy.", "nincs."])
def test_evidence(spark, text):
    rows = spark.createDataFrame([(text, ["metafora", "Agy", "agy"])], "t string, w array<string>")
    assert rows.select(tx.evidence(F.col("t"), F.col("w")).alias("x")).first().x == evidence(text, ["metafora", "Agy", "agy"], 400)


def test_proposals_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = np.eye(4, 8)
    words = random.Random(5)
    x, texts, labels = [], {}, []
    for k in range(60):
        topic = k % 5  # the fifth is noise
        v = (centres[topic] if topic < 4 else np.zeros(8)) + rng.normal(0, 0.25 if topic < 4 else 1.0, 8)
        x.append(v / np.linalg.norm(v))
        texts[k] = " ".join(words.choice([f"topic{topic}", f"topic{topic}", f"sub{topic}{k % 3}", "the", "of", f"w{words.randint(0, 20)}"]) + words.choice(["", "", "."]) for _ in range(40))
        labels += [(k, f"L{topic}"), (k, "all"), (k, f"M{k % 7}")]
    x = np.array(x)
    themes = [(t, [float(a) for a in v]) for t, v in enumerate(np.eye(3, 8))]
    candidates = spark.createDataFrame([(k, [float(a) for a in x[k]]) for k in range(60) if k % 10 != 9], "doc_id long, vec array<double>")
    got = {}
    for r in discover.proposals(candidates, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label string"), spark.createDataFrame(themes, "theme long, vec array<double>"), 0.3).collect():
        got.setdefault((r.grp, r.part), {})[r.rank] = r
    own = [k for k in range(60) if k % 10 != 9]
    groups = [[own[i] for i in g] for g in discover.average_linkage(x[own], 0.3)]
    assert len(groups) >= 4 and {g for g, _ in got} == set(range(len(groups)))
    counts = {k: Counter(re.findall(r"\w+", t.lower())) for k, t in texts.items()}
    total = sum(counts.values(), Counter())
    n_all = sum(total.values())
    for g, members in enumerate(groups):
        centre = x[members].mean(axis=0)
        order = sorted(members, key=lambda k: (-round(float(x[k] @ centre), 12), k))
        assert [int(got[g, "member"][r].name) for r in range(1, len(members) + 1)] == order
        inside = sum((counts[k] for k in members), Counter())
        n = sum(inside.values())
        rate = {t: (c * 1e6 / n, (total[t] - c) * 1e6 / (n_all - n)) for t, c in inside.items() if c >= 2}
        best = sorted((t for t, (f, r) in rate.items() if f > r), key=lambda t: (-round((rate[t][0] + 1) / (rate[t][1] + 1), 9), t))[:40]
        used = {t: sum(t in counts[k] for k in members) for t in best}
        terms = [t for t in best if used[t] >= 2][:8]
        found = got.get((g, "term"), {})
        assert [(found[r].name, found[r].n) for r in sorted(found)] == [(t, used[t]) for t in terms]
        share = Counter(lab.lower() for k, lab in labels if k in members)
        pool = Counter(lab.lower() for _, lab in labels)
        over = sorted((-round(c / len(members) / (pool[lab] / 60), 9), -c, lab) for lab, c in share.items() if c >= 2 and c / len(members) > pool[lab] / 60)[:6]
        found = got.get((g, "label"), {})
        assert [found[r].name for r in sorted(found)] == [o[2] for o in over]
        sims = [(-round(float(np.array(v) @ centre / np.linalg.norm(centre)), 10), t) for t, v in themes]
        assert [int(got[g, "theme"][r].name) for r in (1, 2, 3)] == [t for _, t in sorted(sims)]
        assert [(int(got[g, "seed"][r].name), got[g, "seed"][r].quote) for r in (1, 2, 3)] == [(k, evidence(texts[k], terms, 400)) for k in order[:3]]


def test_tuning_falls_back_where_nothing_is_admissible(spark):
    sims = spark.createDataFrame([(k, t, s) for k in range(12) for t, s in (("p", 0.1 + k / 20), ("q", 0.5 - k / 30))], "vec_id long, theme string, sim double")
    items = spark.createDataFrame([(k, ["a" if k < 6 else "b"] if k != 5 else []) for k in range(12)], "vec_id long, gold array<string>")
    grid = spark.createDataFrame([(t, d) for t in (0.2, 0.4, 0.9) for d in (0.0, 0.3)], "tau double, delta double")
    loose = tune.tuned(sims, items, grid, tune.Limits(0.9, 1.2, 0.8)).collect()
    strict = tune.tuned(sims, items, grid, tune.Limits(1.1, 0.0, 0.0)).collect()
    assert 0 < sum(r.admissible for r in loose) < 6 and not any(r.admissible for r in strict)
    for rows in (loose, strict):
        (chosen,) = [r for r in rows if r.chosen]
        pool = [r for r in rows if r.admissible] or rows
        assert (chosen.tau, chosen.delta) == max(((round(r.f, 12), r.tau, -r.delta) for r in pool))[1:2] + (-max((round(r.f, 12), r.tau, -r.delta) for r in pool)[2],)
    assert next(r for r in loose if r.tau == 0.9).coverage == 0.0


def keywords(docs, upto, own):
    counts = {k: Counter(re.findall(r"\w+", docs[k].lower())) for k in upto}
    total = sum(counts.values(), Counter())
    n_all, out = sum(total.values()), set()
    for k in own:
        n = sum(counts[k].values())
        s = {t: round((c * 1e6 / n + 1) / ((total[t] - c) * 1e6 / (n_all - n) + 1), 6) for t, c in counts[k].items() if c >= 2 and n_all > n and c / n > (total[t] - c) / (n_all - n)}
        out |= {(k, r + 1, t, s[t]) for r, t in enumerate(sorted(s, key=lambda t: (-s[t], t))[:8])}
    return out


def test_stopped_and_resumed_stream_equals_one_run(spark, tmp_path):
    rng = random.Random(8)
    docs = {k: " ".join(rng.choice([f"w{k % 7}", f"v{rng.randint(0, 9)}", "the", "and"]) for _ in range(60)) for k in range(24)}
    schema = "doc_id long, text string"

    def file(number, ids):
        spark.createDataFrame([(k, docs[k]) for k in ids], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={number}")

    def run(name):
        log = KeywordLog(spark, f"{tmp_path}/{name}/log")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        log.start(stream, f"{tmp_path}/{name}/checkpoint").awaitTermination(120)
        return log

    file(0, range(8))
    file(1, range(8, 16))
    first = {tuple(r) for r in run("a").keywords().collect()}
    file(2, [*range(16, 24), 3, 4])  # two writings come again
    log = run("a")
    got = {tuple(r) for r in log.keywords().collect()}
    assert first < got  # what was there has not moved
    batches = {}
    for r in got:
        batches.setdefault(r[5], set()).add(r[0])
    want, upto = set(), []
    for ids in (range(8), range(8, 16), range(16, 24)):
        upto += ids
        want |= keywords(docs, upto, ids)
    assert {(r[0], r[1], r[2], r[3]) for r in got} == want
    # a batch that ran before and is run again, as after a failure, changes nothing
    log.batch(spark.createDataFrame([(k, docs[k]) for k in [*range(16, 24), 3, 4]], schema), 2)
    assert {tuple(r) for r in log.keywords().collect()} == got


def test_gate_knows_posts_and_classes(spark):
    from corpusloom.operators import gate

    posts = spark.createDataFrame([(1, ["a"], ["a"]), (2, [], ["a"]), (3, None, ["a"]), (4, ["b"], ["a"]), (5, ["a", "x"], ["a"])], "key int, new array<string>, expected array<string>")
    assert {r.key: r.ok for r in gate.named_posts(posts, ["x"]).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False}
    items = spark.createDataFrame([([f"t{k % 5}"], ["z"] if k % 2 else ["y"], [f"g{k % 5}"]) for k in range(60)], "new array<string>, base array<string>, gold array<string>")
    pages = spark.createDataFrame([([f"t{k % 5}"] if k < 8 else [],) for k in range(10)], "new array<string>")
    judge = lambda **how: gate.gate(items, [], resamples=100, **how).first()
    assert judge().passed and judge(pages=pages, posts=posts.where("key < 4"), forbidden=["x"]).passed
    assert not judge(pages=pages.where("size(new) = 0")).passed
    r = judge(posts=posts, forbidden=["x"])
    assert (r.n_posts, r.bad_posts, r.known, r.better, r.passed) == (5, 2, False, True, False)


def test_integrity_of_a_small_site(spark):
    from corpusloom.operators import integrity

    pages = spark.createDataFrame(
        [("", '<a href="/a/">x</a> <a href=/old?q=1#f>y</a> <A HREF="/dead">n</a> <a href="//else.where/x">z</a> <a href="/m">m</a><h1>Home</h1>'), ("/a", "<h1> A </h1>"), ("/a", "(t)[http://x]"), ("/m", "<h1>Old name</h1><a href='/round'>r</a>")],
        "path string, html string",
    )
    redirects = spark.createDataFrame([("/old", "/older"), ("/older", "/oldest"), ("/oldest", "/a"), ("/round", "/round2"), ("/round2", "/round"), ("/lost", "/nowhere")], "source string, target string")
    assert {(r.source, r.target) for r in integrity.redirected(redirects).collect()} == {("/old", "/a"), ("/older", "/a"), ("/oldest", "/a"), ("/lost", "/nowhere")}
    names = spark.createDataFrame([("Home",), ("A",)], "name string")
    registry = spark.createDataFrame([("/old",), ("/a",), ("/lost",), ("/round",)], "path string")
    carried = spark.createDataFrame([("/a", "A"), ("/m", "B")], "path string, name string")
    got = {r.check: (r.n_checked, r.n_bad, r.first_bad) for r in integrity.checks(pages, redirects, registry, names, carried, "/m").collect()}
    # an upper-case tag is no link here: what renders the pages writes lower case
    assert got == {"links": (4, 1, "/round"), "blind": (4, 0, None), "registry": (4, 2, "/lost"), "headings": (3, 1, "Old name"), "names": (2, 1, "B"), "inside_out": (4, 1, "/a"), "twice": (3, 1, "/a"), "required": (2, 0, None)}
    none = integrity.checks(pages.limit(0), redirects.limit(0), registry, names, carried, "/m")
    assert {r.check: r.n_bad for r in none.collect()} == {"links": 0, "blind": 1, "registry": 4, "headings": 0, "names": 1, "inside_out": 0, "twice": 0, "required": 2}


def test_tuning_counts_classes_and_takes_lists(spark):
    rng = random.Random(5)
    sims = [(k, [(f"t{t}", float(rng.choice([0.0, 0.2, 0.25, 0.4, 0.9]))) for t in range(5)]) for k in range(80)]
    lists = spark.createDataFrame(sims, "vec_id long, sims array<struct<theme: string, sim: double>>")
    rows = lists.select("vec_id", F.inline("sims"))
    items = spark.createDataFrame([(k, [f"l{k % 4}", f"k{k % 3}"]) for k in range(85)], "vec_id long, gold array<string>")
    grid = spark.createDataFrame([(t, d) for t in (0.2, 0.3) for d in (0.0, 0.5)], "tau double, delta double")
    want = {}
    for tau in (0.2, 0.3):
        for delta in (0.0, 0.5):
            preds = {k: set() for k in range(85)}
            for k, ts in sims:
                top = sorted((-s, t) for t, s in ts if s >= tau)[:3]
                preds[k] = {t for i, (s, t) in enumerate(top) if i == 0 or s - top[0][0] <= delta}
            want[tau, delta] = (sum(map(bool, preds.values())) / 85, sum(map(len, preds.values())) / 85, Counter(t for p in preds.values() for t in p).most_common(1)[0][1] / 85)
    by_list, by_row = (tune.tuned(x, items, grid).collect() for x in (lists, rows))
    got = {(r.tau, r.delta): (r.coverage, r.mean_themes, r.largest_share) for r in by_list}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert {(r.tau, r.delta): round(r.f, 12) for r in by_list} == {(r.tau, r.delta): round(r.f, 12) for r in by_row}
