"""HTML to Markdown on worked cases, on the pages and on a large page."""

import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import markdown as md

CASES = {
    "<p>One <b>two</b> <i>three</i></p><p>four</p>": "One **two** *three*\n\nfour\n",
    "<h1>Title</h1><h6>Small</h6>": "## Title\n\n###### Small\n",
    "<ul><li>a<li>b<ol><li>c</li></ol></li></ul>": "- a\n\n- b\n\n1. c\n",
    "<b>bold <div>goes on</div> here</b> after": "**bold**\n\n**goes on**\n\n**here** after\n",
    "a<b> padded </b>b <b> - </b> c<b></b>": "a **padded** b  -  c\n",
    "<b>x</b><b>y</b> <b><i>z</i></b>": "**xy** ***z***\n",
    '<a href="/u">see <b>this</b></a> <b><a href="v">all</a></b>': "[see **this**](/u) **[all](v)**\n",
    '<img src="http://i0.wp.com/a.org/p.jpg?w=3" alt="a]b"><img src="https://img.zemanta.com/x.png">': "![a\\]b](https://a.org/p.jpg)\n",
    "<blockquote>one<br>two<p>three</p></blockquote>four": "> one  \n> two\n\n> three\n\nfour\n",
    "<pre>a &lt; b<div>``` x</div><br>c\n</pre>": "````\na < b``` x\nc\n````\n",
    '<iframe src="https://www.youtube.com/embed/q"></iframe><iframe src="http://z.org"></iframe>': "[YouTube](https://www.youtube.com/embed/q)\n\n[Beágyazott tartalom](http://z.org)\n",
    '<script src="https://gist.github.com/u/1.js">x</script><style>p{}</style><form>in</form>out': "[GitHub Gist](https://gist.github.com/u/1)\n\nout\n",
    "<table><tr><td><b>x</b> &amp; y</td></tr></table>z": "<table><tr><td><b>x</b> & y</td></tr></table>\n\nz\n",
    "a \n  b<hr>c&nbsp;d": "a b\n\n---\n\nc\xa0d\n",
    "<meta charset=x><link rel=y><p>kept</p>": "kept\n",
    "": "\n",
    "<p> </p><li></li>": "-\n",
    "<p>x</b></p></ul></blockquote>": "x\n",
}


@pytest.mark.parametrize("html", CASES)
def test_worked_cases(html):
    assert md.to_markdown(html) == CASES[html]


def test_large_and_odd_pages():
    began = time.monotonic()
    page = "<div><p>word <b>bold</b> <a href='x'>y</a></p><ul><li>i</li></ul>" * 15_000
    assert md.to_markdown(page).count("**bold**") == 15_000
    for odd in ("<b>" * 100_000 + "x", "<" * 300_000, "<div>" * 100_000 + "x", "&" * 300_000, "<a href=x>" * 30_000 + "y"):
        md.to_markdown(odd)
    assert time.monotonic() - began < 60


def test_pages(spark, data):
    rows = spark.read.parquet(f"{data}/pages.parquet").select("html", md.markdown(F.col("html")).alias("m"), md.markdown(F.lit(None).cast("string")).alias("none")).collect()
    assert rows and all(r.m == md.to_markdown(r.html) and r.none is None and "<script" not in r.m for r in rows)


def test_urls(spark):
    cases = {"http://é.hu/á b?q=ű#f": "http://xn--9ca.hu/%C3%A1%20b?q=%C5%B1#f", "/a%20b": "/a%20b", "x": "x", "http://[bad": "http://[bad"}
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", md.encoded_url(F.col("u")).alias("e")).collect()
    assert {r.u: r.e for r in rows} == cases
