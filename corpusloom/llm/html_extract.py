"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes a sequence of leaf blocks: runs of text between the starts and ends of block elements,
each with the tags, class and id words of its ancestors. The field has two labels, main text and
boilerplate; its weights are trained by gradient steps on the log likelihood of labelled pages, with
forward-backward sums, and a page is decoded by Viterbi. The labelled pages come from `labelled_pages`,
which writes pages of many layouts along with the label of each block it writes.

Scale: one narrow pass over url and html; the model is a few hundred numbers, trained on a fixed
number of pages whatever the input, and broadcast. Whole pages are read and nothing is shuffled.
"""

from __future__ import annotations

import functools
import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read

#: Fixed values of the HTML standard, as far as they matter here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = ("script", "style", "title", "noscript", "template", "iframe", "svg", "textarea", "object")
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("button label legend option select td th tr tbody thead tfoot head html body".split())
IMPLIED_END = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: Open elements that count as ancestors; text inside deeper ones counts to the last of these.
DEPTH = 512
#: What a tag has up to its end; a > inside quotes does not end it.
_REST = re.compile(r"(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+>")
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in SKIPPED}
#: Elements whose text is code; without an end tag they go on to the end of the page.
_CODE = ("script", "style")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements that say most about what they hold.
SECTIONS = frozenset("article main nav aside header footer form figure table ul ol section dialog".split())
CUES = frozenset("cookie cookies privacy newsletter subscribe login copyright rights reserved comments comment reply share advertisement sponsored menu search related".split())


def markup(page: str):
    """(start, end, tag, whether an end tag, attributes) of each piece of markup; tag is None for what is to be skipped.

    An element of SKIPPED is skipped with its content; one that stands for itself (<svg/>) or never ends
    only as a tag, code apart. A < that begins no markup is text. Time is linear in the page, whatever it
    holds: what is not found once is not looked for again, and tags whose quotes do not close end at
    the next > once such scans have read the page some times over.
    """
    at, missing, room = 0, set(), 8 * len(page) + 65_536
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, None, False, ""
            at = end
            continue
        name = _NAME.match(page, at)
        if name is None:
            odd = page[at + 1 : at + 2] in ("!", "?", "/") and ">" not in missing
            end = page.find(">", at) + 1 if odd else 0
            if end:
                yield at, end, None, False, ""
            elif odd:
                missing.add(">")
            at = end or at + 1
            continue
        if ">" in missing:
            return
        rest = _REST.match(page, name.end()) if room > 0 else None
        if rest is None:
            room -= len(page) - at
        end = rest.end() if rest else page.find(">", name.end()) + 1
        if not end:
            missing.add(">")
            return
        tag, attrs, closing = name[1].lower(), page[name.end() : end - 1], page[at + 1] == "/"
        if tag in _END and not closing and not (tag == "svg" and attrs.endswith("/")):
            close = None if tag in missing else _END[tag].search(page, end)
            if close is None:
                missing.add(tag)
            if close or tag in _CODE:
                end = close.end() if close else len(page)
            yield at, end, None, False, ""
        else:
            yield at, end, None if tag in _END else tag, closing, attrs
        at = end


class Block:
    __slots__ = ("tags", "names", "text", "linked")

    def __init__(self, tags, names, text, linked):
        self.tags, self.names, self.text, self.linked = tags, names, text, linked


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks with text, in page order; broken markup never raises."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0
    path: tuple | None = None  # tags and names of the open elements, until one opens or ends

    def flush():
        nonlocal linked, path
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                if path is None:
                    path = tuple(t for t, _ in stack), tuple(n for _, ns in stack for n in ns)
                out.append(Block(*path, text, linked))
            parts.clear()
        linked = 0

    def close(names: frozenset | tuple, within: tuple = ()):
        """Pop up to the innermost of names, unless an element of within comes first."""
        nonlocal path
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                path = None
                return
            if stack[k][0] in within:
                return

    at, page = 0, page or ""
    links = 0
    for start, end, tag, closing, attrs in markup(page):
        if start > at:
            parts.append(page[at:start])
            if links:
                linked += start - at
        at = end
        if tag is None:
            continue
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
            continue
        if closing:
            if tag in BLOCKS:
                flush()
            if tag == "a":
                links = max(0, links - 1)
            if tag == "p" or tag not in ("body", "html"):
                close((tag,), () if tag in ("article", "main", "nav", "aside", "footer", "header", "form", "table", "div", "section") else ("table", "article", "nav", "footer"))
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSES_P:
                close(("p",), ("table", "button", "article", "section", "div", "li", "td"))
            if tag in IMPLIED_END:
                names, within = IMPLIED_END[tag]
                close(tuple(names.split()), within)
        if tag in VOID or attrs.endswith("/"):
            continue
        names = tuple(w.lower() for x in _NAMES.findall(attrs) for w in _WORD.findall(next((y for y in x if y), ""))) if "=" in attrs else ()
        if len(stack) < DEPTH:
            stack.append((tag, names))
            path = None
        if tag == "a":
            links += 1
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


@functools.lru_cache(maxsize=20_000)
def _structure(tags: tuple[str, ...], names: tuple[str, ...]) -> tuple[str, ...]:
    inside = [t for t in tags if t in SECTIONS]
    block = next((t for t in reversed(tags) if t in BLOCKS), "none")
    near = inside[-1] if inside else "none"
    out = {f"tag={block}", f"near={near}", f"tag,near={block},{near}", f"last={tags[-1] if tags else 'none'}"}
    out |= {f"in={t}" for t in inside} | {f"name={n}" for n in names} | {f"stem={n[:4]}" for n in names if len(n) > 4}
    out.add("core" if "article" in inside or "main" in inside else "no core")
    if not names:
        out.add("no names")
    return tuple(sorted(out))


def features(blocks: list[Block]) -> list[tuple[str, ...]]:
    out = []
    for k, b in enumerate(blocks):
        words = b.text.split(" ", 41)
        n = len(words)
        size = "1" if n < 3 else "3" if n < 6 else "6" if n < 13 else "13" if n < 31 else "31"
        share = b.linked / max(1, len(b.text))
        f = [f"size={size}", f"links={'none' if share == 0 else 'some' if share < 0.5 else 'most'}", "stop" if b.text[-1] in ".!?…" else "no stop"]
        if "©" in b.text:
            f.append("sign")
        f += [f"cue={w}" for w in {x.lower().strip(".,:!") for x in words[:12]} & CUES]
        f.append("first" if k == 0 else "last" if k == len(blocks) - 1 else "middle")
        out.append((*_structure(b.tags, b.names), *f))
    return out


class Field:
    """Weights of a two-label linear-chain field."""

    def __init__(self, index: dict[str, int]):
        self.index = index
        self.state = np.zeros((len(index), 2))
        self.step = np.zeros((2, 2))
        self.ends = np.zeros((2, 2))  # label of the first, of the last block

    def ids(self, feats) -> list[list[int]]:
        return [[i for f in fs if (i := self.index.get(f)) is not None] for fs in feats]

    def scores(self, ids) -> np.ndarray:
        s = np.array([self.state[i].sum(axis=0) for i in ids])
        s[0] += self.ends[0]
        s[-1] += self.ends[1]
        return s

    def viterbi(self, s: np.ndarray) -> list[int]:
        back = []
        a, b = s[0]
        t = self.step.tolist()
        for x, y in s[1:].tolist():
            to0, to1 = (a + t[0][0], b + t[1][0]), (a + t[0][1], b + t[1][1])
            back.append((int(to0[1] > to0[0]), int(to1[1] >= to1[0])))
            a, b = max(to0) + x, max(to1) + y
        label = int(b > a)
        out = [label]
        for p in reversed(back):
            label = p[label]
            out.append(label)
        return out[::-1]

    def marginals(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Label probabilities, expected transitions, log of the sum over all labellings."""
        n = len(s)
        f, g = np.zeros((n, 2)), np.zeros((n, 2))
        f[0] = s[0]
        for k in range(1, n):
            f[k] = s[k] + np.logaddexp(f[k - 1, 0] + self.step[0], f[k - 1, 1] + self.step[1])
        for k in range(n - 2, -1, -1):
            x = s[k + 1] + g[k + 1]
            g[k] = np.logaddexp(self.step[:, 0] + x[0], self.step[:, 1] + x[1])
        z = float(np.logaddexp(*f[-1]))
        moves = np.zeros((2, 2))
        for k in range(1, n):
            moves += np.exp(f[k - 1][:, None] + self.step + (s[k] + g[k])[None] - z)
        return np.exp(f + g - z), moves, z


def train(pages: list[tuple[list, list[int]]], epochs: int = 12, rate: float = 0.3, l2: float = 1e-4, seed: int = 3) -> Field:
    """Stochastic gradient (AdaGrad) on the conditional log likelihood; pages: (features, labels)."""
    names = sorted({f for feats, _ in pages for fs in feats for f in fs})
    field = Field({f: k for k, f in enumerate(names)})
    data = [(field.ids(feats), np.array(labels)) for feats, labels in pages if labels]
    sums = [np.full(x.shape, 1e-6) for x in (field.state, field.step, field.ends)]
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(data)
        for ids, y in data:
            p, moves, _ = field.marginals(field.scores(ids))
            d = -p
            d[np.arange(len(y)), y] += 1
            rows = sorted({i for fs in ids for i in fs})
            at = {i: k for k, i in enumerate(rows)}
            gs = np.zeros((len(rows), 2))
            for fs, x in zip(ids, d):
                for i in fs:
                    gs[at[i]] += x
            gs -= l2 * field.state[rows]
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:-1], y[1:]), 1)
            for value, total, g, pick in ((field.state, sums[0], gs, rows), (field.step, sums[1], seen - moves, slice(None)), (field.ends, sums[2], np.stack([d[0], d[-1]]), slice(None))):
                total[pick] += g * g
                value[pick] += rate * g / np.sqrt(total[pick])
    return field


# --- Labelled pages ---------------------------------------------------------------------------

_SYLLABLES = "an the re ion ver ti sche au que ment el la do mi ra os ción ung en ich tre pa ło ku ta ri".split()
_MAIN = ("content", "main-content", "post", "entry-content", "story", "article-body", "post-body", "text", "page-content", "articleText", "prose")
_WRAP = ("container", "wrapper", "page", "row", "layout", "site", "inner", "col")
_BOILER = {
    "nav": ("menu", "navbar", "main-menu", "breadcrumbs", "topnav", "site-navigation", "mobileMenu", "toc-nav"),
    "header": ("header", "site-header", "masthead", "topbar", "banner", "page-header"),
    "footer": ("footer", "site-footer", "bottom", "copyright", "legal", "colophon"),
    "aside": ("sidebar", "side", "widget", "related", "recommended", "right-rail", "more-stories", "popular", "trending"),
    "ad": ("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "banner-ad", "adsbygoogle", "sponsor", "advertorial"),
    "notice": ("cookie", "cookie-banner", "consent", "notice", "gdpr", "alert", "newsletter", "subscribe", "popup", "modal", "paywall", "message", "disclaimer", "announcement"),
    "form": ("search", "login", "signup", "contact-form", "subscribe-form"),
    "comments": ("comments", "comment", "comment-list", "reader-comments", "discussion", "replies", "disqus", "responses", "respond"),
    "share": ("share", "social", "sharing", "tags", "pagination", "follow", "author-box", "meta-links"),
}
_BOILER_WORDS = ("Home", "About", "Contact", "Log in", "Subscribe", "Share", "We use cookies to improve this site.", "Accept all cookies", "Advertisement", "Sponsored", "All rights reserved.", "Privacy policy", "Reply", "Comments", "Related stories", "Read more", "Search", "Follow us", "© 2020")


def labelled_pages(count: int = 700, seed: int = 11) -> list[tuple[str, list[tuple[str, int]]]]:
    """Pages of many layouts with (text, label) of every block; label 1 is main text."""
    rng = random.Random(seed)

    def word() -> str:
        return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))

    def prose(low: int, high: int) -> str:
        out = []
        for _ in range(rng.randint(low, high)):
            ws = [word() for _ in range(rng.randint(3, 16))]
            out.append(" ".join(ws).capitalize() + rng.choice(".....!?"))
        return " ".join(out)

    def page() -> tuple[str, list[tuple[str, int]]]:
        out, gold = [], []

        def put(text: str, label: int, before: str = "", after: str = "") -> None:
            out.append(before + html.escape(text, quote=False) + after)
            gold.append((" ".join(text.split()), label))

        def boiler(kind: str, inner: bool = False) -> None:
            name = rng.choice(_BOILER[kind])
            own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section", "notice": "div", "ad": "div", "share": "div"}[kind]
            tag = rng.choice([own, own, "div", "section" if kind != "form" else "form"])
            attr = "" if tag == own and tag not in ("div", "section") and rng.random() < 0.5 else f' {rng.choice(["class", "class", "id"])}="{name if rng.random() < 0.6 else name + " " + rng.choice(("x1", "box", "top", "js-on"))}"'
            out.append(f"<{tag}{attr}>")
            if kind == "comments":
                if rng.random() < 0.6:
                    put(rng.choice(("Comments", "Reader comments", word())), 0, "<h3>", "</h3>")
                for _ in range(rng.randint(1, 5)):
                    style = rng.random()
                    if style < 0.4:
                        put(prose(1, 3), 0, '<div class="comment"><p>', "</p></div>")
                    elif style < 0.7:
                        put(prose(1, 4), 0, "<li><p>", "</p></li>")
                    else:
                        put(prose(1, 2), 0, "<p>", "</p>")
            elif kind == "form":
                put(rng.choice(("Search", "E-mail", word())), 0, "<label>", "</label><input type=text>")
                put(rng.choice(("Go", "Send", "Log in")), 0, "<button>", "</button>")
            elif kind in ("nav", "share") or (kind in ("footer", "aside", "header") and rng.random() < 0.5):
                out.append("<ul>")
                for _ in range(rng.randint(2, 7)):
                    put(rng.choice((word(), word() + " " + word(), rng.choice(_BOILER_WORDS))), 0, '<li><a href="/x">', "</a></li>" if rng.random() < 0.9 else "</a>")
                out.append("</ul>")
            else:
                for _ in range(rng.randint(1, 2)):
                    text = rng.choice((prose(1, 3), prose(1, 1), rng.choice(_BOILER_WORDS), "© " + word() + ".com · " + prose(1, 1)))
                    p = rng.random()
                    put(text, 0, "<p>" if p < 0.4 else "<h4>" if p < 0.5 else "<div>", "</p>" if p < 0.4 else "</h4>" if p < 0.5 else "</div>")
            out.append(f"</{tag}>")

        out.append("<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>")
        wraps = rng.sample(_WRAP, rng.randint(0, 2))
        out += [f'<div class="{w}">' for w in wraps]
        for kind in rng.sample(("nav", "header", "ad", "notice", "form", "aside"), rng.randint(1, 4)):
            boiler(kind)
        shell = rng.choice(("article", "article", "article", "main", "div", "div", "both", "section"))
        name = f' class="{rng.choice(_MAIN)}"' if shell in ("div", "section") or rng.random() < 0.4 else ""
        opens = {"both": f"<main><article{name}>"}.get(shell, f"<{shell}{name}>")
        out.append(opens)
        head = rng.random()
        title = " ".join(word() for _ in range(rng.randint(2, 9)))
        if head < 0.7:
            put(title, 1, "<h1>", "</h1>")
        elif head < 0.85:
            put(title, 1, "<header><h1>", "</h1></header>")
        for k in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.62:
                put(prose(1, 7), 1, "<p>", "</p>" if rng.random() < 0.85 else "")
            elif kind < 0.70:
                put(prose(1, 1), 1, "<p><b>", "<br>")
            elif kind < 0.76:
                put(" ".join(word() for _ in range(rng.randint(1, 6))), 1, f"<h{rng.randint(2, 4)}>", "</h2>")
                out[-1] = out[-1].replace("</h2>", f"</h{out[-1][2]}>")
            elif kind < 0.81:
                out.append("<ul>")
                for _ in range(rng.randint(2, 4)):
                    put(prose(1, 1), 1, "<li>", "</li>")
                out.append("</ul>")
            elif kind < 0.85:
                put(prose(1, 3), 1, "<blockquote>", "</blockquote>")
            elif kind < 0.88:
                put(" ".join(word() for _ in range(rng.randint(1, 3))), 1, "<p>", "</p>")
            elif kind < 0.91:
                put(prose(1, 2), 1, "<div>", "</div>")
            elif kind < 0.93:
                put(prose(1, 1), 1, "<table><tr><td>", "</td></tr></table>")
            elif k:
                boiler(rng.choice(("ad", "share", "notice", "aside", "ad", "form")))
        if rng.random() < 0.15:
            boiler("comments")
        out.append({"both": "</article></main>"}.get(shell, f"</{shell}>"))
        for kind in rng.sample(("comments", "aside", "share", "ad", "footer", "form", "notice", "nav"), rng.randint(1, 4)):
            boiler(kind)
        out += ["</div>"] * len(wraps)
        if rng.random() < 0.9:
            out.append("</body></html>")
        return "".join(out), gold

    return [page() for _ in range(count)]


def training_set(pages) -> list[tuple[list, list[int]]]:
    """Features and labels of labelled pages; a page whose blocks are not those that were written is an error."""
    out = []
    for source, gold in pages:
        blocks = leaf_blocks(source)
        if [b.text for b in blocks] != [t for t, _ in gold]:
            raise ValueError("a labelled page does not parse into its blocks")
        out.append((features(blocks), [y for _, y in gold]))
    return out


@functools.lru_cache(maxsize=1)
def trained_field() -> Field:
    return train(training_set(labelled_pages()))


def main_text(page: str | None, field: Field) -> str:
    """Blocks that Viterbi labels main text, joined by newlines; empty for null, for pages without text."""
    blocks = leaf_blocks(page)
    if not blocks:
        return ""
    labels = field.viterbi(field.scores(field.ids(features(blocks))))
    return "\n".join(b.text for b, y in zip(blocks, labels) if y)


def _extract(shared):
    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), shared.value) for x in batch.column(0)]
            yield pa.record_batch([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[1:], "text", "n_chars"])

    return run


def extract(pages: DataFrame, field: Field | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text, n_chars.

    Null and empty html and pages without main text give an empty text. Ids and pages may repeat;
    other columns are not looked at; an empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field or trained_field())
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col))
    return pages.select(html_col, id_col, url_col).mapInArrow(_extract(shared), f"{kinds}, text string, n_chars long")


def op1_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
