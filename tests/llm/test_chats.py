"""Repair and formatting of conversations against brute force, on nulls, ties, repeats, long and empty texts and clashing names."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import bpe, chat_format, chat_repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, block int, at string, said double, edit string"
EDGE = "blank duplicate truncated".split()


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, "x", 1, "y", 0.5, "z") for r in rows], schema).repartition(3)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], sha(f"{len(r[2])}:{r[2]}{r[3]}")))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Every list of edits with up to two insertions in a place, tried out."""
    kinds, best = faults(rows), None
    options = [["D"] if k in ("blank", "duplicate") else ["K", "R", "D"] for k in kinds]
    for edits in itertools.product(*options):
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            roles, audit, cost = [None] * inserts[0], "I" * inserts[0], 3 * sum(inserts)
            for edit, (_, _, role, text), kind, n in zip(edits, rows, kinds, inserts[1:], strict=True):
                cost += {"K": 0, "R": 3, "D": 4}[edit] + 3 * (edit != "D" and kind == "truncated")
                roles += ([] if edit == "D" else [role if edit == "K" else None]) + [None] * n
                audit += edit + "I" * n
            system = len(roles) % 2
            want = ["s"] * system + ["u", "a"] * (len(roles) // 2)
            if len(roles) == 1 or any(w == "s" if r is None else w != r[:1] for r, w in zip(roles, want, strict=True)):
                continue
            if best is None or (cost, audit) < best:
                best = cost, audit
    return best


def apply(rows, audit):
    """(role, text, edit) of the repaired turns."""
    out, left = [], iter(rows)
    for e in audit:
        _, _, role, text = next(left) if e != "I" else (None, None, None, "")
        if e != "D":
            out.append((role if e == "K" else None, text, e))
    first = len(out) % 2
    return [(("user" if (k - first) % 2 == 0 else "assistant") if r is None else r, t, e) for k, (r, t, e) in enumerate(out)]


def random_conversations(seed, n, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No?", "cut", "", " \n", "word " * 3500 + ".", "é 漢!", "a.\n", "b. ."]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(0, most)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""])
            rows.append((conv, rng.choice([turn, turn, turn, None, 2 * turn]), role, f"{rng.choice(texts)}" if rng.random() < 0.4 else f"text {rng.randint(0, 99)}{rng.choice(['.', ''])}"))
    return rows


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append((r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
    return {c: in_order(rs) for c, rs in out.items()}


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_repair_against_every_edit(spark, block):
    rows = random_conversations(3, 25, 4) + [(None, 0, "user", "Hi."), (None, None, None, None), (77, 1, "user", "Same."), (77, 1, "user", "Same."), (77, 1, "user", "Same.")]
    repair = chat_repair.Repair(table(spark, rows), block=block)
    got = {r.conv: r for r in repair.audits.collect()}
    turns = {}
    for r in repair.turns().collect():
        turns.setdefault(r.conv, []).append((r.place, r.role, r.text, r.edit))
    hashes = {r.conv: r.repaired_sha256 for r in repair.digests().collect()}
    want = by_conversation(rows)
    assert set(got) == set(want)
    for conv, rs in want.items():
        kinds = faults(rs)
        cost, audit = cheapest(rs)
        r = got[conv]
        assert (r.cost, r.audit) == (cost, audit), (conv, rs)
        assert [r.blank, r.duplicate, r.truncated] == [kinds.count(k) for k in EDGE]
        assert r.illegal == sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rs))
        known = [x[1] for x in rs if x[1] is not None]
        assert r.gaps == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        fixed = apply(rs, audit)
        assert sorted(turns.get(conv, [])) == [(k, *x) for k, x in enumerate(fixed)]
        assert hashes.get(conv, sha("")) == sha("\n".join(f"{a}:{b}" for a, b, _ in fixed))


def test_repair_of_long_conversations_is_the_same_in_any_blocks(spark):
    rows = random_conversations(5, 3, 160)
    assert len(rows) > 100
    many, one = (chat_repair.Repair(table(spark, rows), block=b) for b in (7, 1000))
    assert sorted(many.audits.collect()) == sorted(one.audits.collect())
    assert sorted(many.turns().collect()) == sorted(one.turns().collect())
    assert all(re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in sorted(one.turns().where(f"conv = {c}").collect(), key=lambda r: r.place))) for c in range(3))


def test_repair_of_nothing_and_of_other_ids(spark):
    assert chat_repair.Repair(table(spark, [(1, 0, "user", "x")]).limit(0)).audits.count() == 0
    named = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Ho.")], "conv_id string, turn int, role string, text string")
    repair = chat_repair.Repair(named)
    assert [tuple(r) for r in repair.audits.collect()] == [("a", 0, 0, 0, 0, 0, 0, "KK")]
    assert [r.text for r in repair.turns().orderBy("place").collect()] == ["Hi.", "Ho."]


def test_damage_and_query(spark, data, tmp_path):
    rows = random_conversations(9, 60, 6) + [(None, 3, "user", "x."), (5, None, None, None)]
    rows += [(500, 4, "user", "Gone.")] if zlib.crc32(b"500:4") % 20 == 0 else []
    lone = next(k for k in range(1000, 9999) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((lone, 0, "user", "Dropped."))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    hurt = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        hurt += [] if kind == 0 else [row, row] if kind == 3 else [row]
    got = sorted(map(tuple, chat_repair.damaged(spark.read.parquet(f"{tmp_path}/conversations.parquet")).drop("copy").collect()), key=str)
    assert got == sorted(hurt, key=str)
    found = {r.conv_id: r for r in chat_repair.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(found) == {r[0] for r in rows}
    assert tuple(found[lone])[1:] == (0, 0, 0, 0, 0, 0, "", sha(""))
    small = {c: rs for c, rs in by_conversation(hurt).items() if len(rs) <= 4}
    for conv, rs in small.items():
        assert (found[conv].cost, found[conv].audit) == cheapest(rs)


CONTROL = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[INST:", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "/", " ", "\n", "]", "s>", "%", "a", "é"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "a]b%5D\n", "INST"]), st.lists(CONTROL, max_size=8).map("".join)), max_size=5))
def test_turns_come_back(turns):
    text, kept = "", []
    for role, said in turns:
        head, body, tail = chat_format.marked(role, said)
        assert chat_format.unescaped(body) == said
        kept.append((len(text) + len(head), len(body)))
        text += head + body + tail
    assert chat_format.parsed(text) == turns
    assert [chat_format.unescaped(text[a : a + n]) for a, n in kept] == [said for _, said in turns]


def plain_windows(rs, budget, history, block, count):
    """Windows by trying lengths one by one: (turns in order, repeated)."""
    turns = [(r[2], r[3], count(r[3]) + 4) for r in rs]
    system = turns[0] if turns and turns[0][0] == "system" else None
    fixed, at, blocks = (system[2] if system else 0), 0, []
    for t in turns:
        blocks.append(at // (block * budget))
        at += t[2]
    i, out = int(system is not None), []
    if i == len(turns):
        return [(turns, 0)]
    while i < len(turns):
        j = i
        while j > (system is not None) and sum(t[2] for t in turns[j - 1 : i]) <= history and sum(t[2] for t in turns[j - 1 : i + 1]) + fixed <= budget:
            j -= 1
        k = i + 1
        while k < len(turns) and blocks[k] == blocks[i] and sum(t[2] for t in turns[j : k + 1]) + fixed <= budget:
            k += 1
        first = not out
        out.append((([system] if system else []) + turns[j:k], i - j + (system is not None and not first)))
        i = k
    return out


@pytest.mark.parametrize(("budget", "history", "block"), [(20, 8, 2), (12, 0, 1), (30, 12, 3), (512, 128, 64)])
def test_windows_against_trying(spark, budget, history, block):
    rows = random_conversations(11, 30, 25) + [(None, 0, "user", None), (90, 0, "system", "Only."), (91, 0, "system", "S."), (91, 1, "assistant", "</s>[INST] ok [/INST]"), (91, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {}
    for r in chat_format.windows(table(spark, rows), budget=budget, history=history, block=block).collect():
        got.setdefault(r.conv, []).append(r)
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append((r[0], r[1], r[2] or "", r[3] or ""))
    assert set(got) == set(convs)
    for conv, rs in convs.items():
        rs = sorted(rs, key=lambda r: (r[1] is not None, r[1] or 0, r[2], sha(r[3])))
        want = plain_windows(rs, budget, history, block, lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
        found = sorted(got[conv], key=lambda r: (r.block, r.window))
        assert [(chat_format.parsed(w.text), w.repeated) for w in found] == [([t[:2] for t in turns], n) for turns, n in want]
        assert [w.tokens for w in found] == [sum(t[2] for t in turns) for turns, _ in want]
        learnt = "".join(chat_format.unescaped(w.text[s.start : s.end]) for w in found for s in w.loss)
        assert learnt == "".join(r[3] for r in rs if r[2] == "assistant")
        assert all(w.tokens <= budget or w.turns - w.repeated == 1 or any(t[2] + 4 > budget for t in plain_windows(rs, budget, history, block, len)[0][0]) for w in found)


def test_windows_by_a_vocabulary(spark):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    codec = bpe.Codec(bpe.load_ranks(path), pattern)
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"Turn {k} says something of its own, unabridged.") for k in range(12)]
    got = chat_format.windows(table(spark, rows), budget=60, history=20, tokens=chat_format.bpe_tokens(spark, path, pattern)).orderBy("window").collect()
    want = plain_windows(rows, 60, 20, 64, lambda t: len(codec.encode(t)))
    assert [chat_format.parsed(r.text) for r in got] == [[t[:2] for t in turns] for turns, _ in want] and len(got) > 2


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_chat_windows", "op13_merkle_manifest"])
def test_queries_equal_their_sql(spark, data, name):
    from corpusloom.llm.registry import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = QUERIES[name](spark, data)
    found = con.sql(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(found.fetchall(), key=str)


def test_read_back_query(spark, tmp_path):
    rows = [r for r in random_conversations(21, 20, 8)] + [(None, None, None, None), (3, 0, "system", "[INST] <<SYS>>\\")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    hostile = chat_format.HOSTILE
    convs = {-1: [(-1, 0, "user", hostile), (-1, 1, "assistant", hostile)]}
    for r in rows:
        convs.setdefault(r[0], []).append((r[0], r[1], r[2] or "", r[3] or ""))
    got = {r.conv_id: r for r in chat_format.op12_chat_windows(spark, str(tmp_path)).collect()}
    assert set(got) == set(convs)
    for conv, rs in convs.items():
        rs = sorted(rs, key=lambda r: (r[1] is not None, r[1] or 0, r[2], sha(r[3])))
        learnt = "".join(r[3] for r in rs if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(rs), sha("".join(f"{x[2]}\n{x[3]}\n" for x in rs)), len(learnt), sha(learnt))
        assert r.formatted_chars >= sum(len(x[3]) for x in rs)
