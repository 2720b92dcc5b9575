"""Text functions on long input and on odd characters."""

import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.sources import pages, sinks


def one(spark, column, t):
    return spark.createDataFrame([(t,)], "t string").select(column.alias("x")).first().x


def put(spark, text, key, values):
    rows = spark.createDataFrame([(text, values)], "t string, v array<string>")
    return rows.select(sinks.with_list_key(F.col("t"), key, F.col("v")).alias("x")).first().x


def test_list_of_100_000_items_is_replaced_and_read(spark):
    items = [f'  - "item {k}"' for k in range(100_000)]
    text = "\n".join(["---", "title: A", "temak:", *items, "last: 1", "---", "body", ""])
    began = time.monotonic()
    assert put(spark, text, "temak", ["x"]) == '---\ntitle: A\nlast: 1\ntemak:\n  - "x"\n---\nbody\n'
    assert put(spark, text, "other", ["x"]) == text.replace("last: 1\n", 'last: 1\nother:\n  - "x"\n')
    front = F.regexp_extract("t", pages.FRONT_MATTER, 1)
    assert len(one(spark, pages.list_items(front, "temak"), text)) == 100_000
    flow = "---\ntags: [" + ", ".join(f'"a, {k}"' for k in range(20_000)) + ", b]\n---\n"
    found = one(spark, pages.list_items(front, "tags"), flow)
    assert (found[0], found[19_999], found[20_000]) == ("a, 0", "a, 19999", "b")
    assert time.monotonic() - began < 60


@pytest.mark.parametrize("word", ["x" * 1_000_000, "<" * 300_000, "[" * 300_000, "![" * 200_000, "a.jpg" * 100_000, "%4" * 300_000], ids=lambda w: w[:3])
def test_markup_of_one_long_word(spark, word):
    began = time.monotonic()
    got = one(spark, tx.strip_markup(F.col("t")), f"before {word} after")
    assert got.startswith("before") and got.endswith("after")
    assert time.monotonic() - began < 20


def test_junk_words(spark):
    cases = {"see a%20b now": "see now", "pic.jpg) x": ") x", "(pic.JPG x": "x", "a.jpgs b": "a.jpgs b", ".png b": ".png b", "u.png,v.gif! w": "! w", "x y.pdf z": "x z"}
    assert {t: one(spark, tx.strip_markup(F.col("t")), t) for t in cases} == cases


def test_pieces_of_200_000_lines(spark):
    lines = [f"line {k}" * (1 + k % 3) for k in range(200_000)]
    began = time.monotonic()
    got = one(spark, tx.paragraph_pieces(F.col("t"), 6000), "\n".join(lines))
    assert "\n".join(got) == "\n".join(lines) and max(map(len, got)) <= 6000 and min(map(len, got[:-1])) > 5900
    assert time.monotonic() - began < 20


def plain_pieces(text, most):
    if len(text) <= most:
        return [text]
    out, last = [], ""
    for line in text.split("\n"):
        if not last:
            last = line
        elif len(last) + 1 + len(line) > most:
            out.append(last)
            last = line
        else:
            last += "\n" + line
    return out + [last] * (last != "")


@pytest.mark.parametrize("text", ["", "\n\n\n\n\n\n\n", "a" * 30, "a\n\n\nbbbbbbbbbb\n\n\n", "\n\nab\ncd\n\n\n\nef\ngh", "1234567\n1\n1234567\n\n12345678\r\n1"])
def test_pieces_against_adding_lines(spark, text):
    for most in (1, 3, 5, 9):
        assert one(spark, tx.paragraph_pieces(F.col("t"), most), text) == plain_pieces(text, most)


def test_slug_keeps_every_letter(spark):
    assert one(spark, tx.import_slug(F.col("t")), "eﬃcient ½ œuvre Øre Őrült") == "efficient-1-2-uvre-re-orult"


def test_yaml_scalars(spark):
    cases = {'a"b': '"a\\"b"', "a\\b": "a\\b", 'a\\"b': '"a\\\\\\"b"', " a": '" a"', "": '""', "gépi tanulás: bevezetés": '"gépi tanulás: bevezetés"', "nyelv": "nyelv", "x`": '"x`"', "a ": '"a "'}
    assert {t: one(spark, tx.yaml_quote(F.col("t")), t) for t in cases} == cases
    for t in [*cases, "it's", "\\", '\\"', "\\\\n"]:
        assert one(spark, tx.yaml_unquote(tx.yaml_quote(F.col("t"), always=True)), t) == t
    assert one(spark, tx.yaml_unquote(F.col("t")), " 'it''s' ") == "it's"
