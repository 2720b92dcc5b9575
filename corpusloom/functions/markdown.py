"""HTML to Markdown: a transducer whose text carries its emphasis, so that markers are written only when a block is complete."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import groupby
from urllib.parse import quote, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What each tag is.
EMPHASIS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = {"p", "div", "ul", "ol", "li", "blockquote", "pre", "section", "article", "figure", "figcaption", "hr", "center", *HEADINGS}
CLOSING = {"li", "p", "div", "figcaption", "center", *HEADINGS}
DROPPED = {"script", "style", "noscript", "meta", "link", "form", "button"}
VOID = {"meta", "link"}
KEPT_AS_HTML = {"table", "thead", "tbody", "tr", "td", "th", "sup", "sub", "abbr"}
EMBEDS = {"youtube.com": "YouTube", "youtu.be": "YouTube", "youtube-nocookie.com": "YouTube", "player.vimeo.com": "Vimeo", "vimeo.com": "Vimeo", "gist.github.com": "GitHub Gist", "slideshare.net": "SlideShare", "scribd.com": "Scribd", "docs.google.com": "Google Docs"}
EMBEDDED = "Beágyazott tartalom"
DEAD_HOSTS = ("img.zemanta.com", "www.zemanta.com", "i.zemanta.com")
PROXY = re.compile(r"^https?://i[0-9]\.wp\.com/([^?]+)")
NO_WORDS = " \t\n\r-–—·•:;,.|/"


def resolve(url: str) -> str | None:
    """Where a picture is to be found: behind its proxy, null where its host is gone."""
    if not url or url.startswith(("data:", "#", "mailto:", "javascript:")):
        return url
    url = "https:" + url if url.startswith("//") else url
    if m := PROXY.match(url):
        url = f"https://{m[1]}"
    host = (re.match(r"https?://([^/]+)", url) or [url, ""])[1].lower()
    return None if any(h in host for h in DEAD_HOSTS) else url


def encode(url: str) -> str:
    """A URL in ASCII: the host by IDNA, the rest by percent signs; what is encoded stays."""
    p = urlsplit(url)
    host = p.netloc if p.netloc.isascii() else p.netloc.encode("idna").decode("ascii")
    return urlunsplit((p.scheme, host, quote(p.path, safe="/%:@!$&'()*+,;=~"), quote(p.query, safe="/%:@!$&'()*+,;=?~"), p.fragment))


def emphasised(runs: list[tuple[str, tuple[str, ...]]]) -> str:
    """Runs of (text, marks, the outermost first) with their markers. White space stays outside of a marker, and what has no words gets none."""
    out = []
    for mark, part in groupby(runs, key=lambda r: r[1][:1]):
        if not mark:
            out += [text for text, _ in part]
            continue
        inner = emphasised([(text, tuple(m for m in marks if m != mark[0])) for text, marks in part])
        core = inner.strip()
        if core.strip(NO_WORDS):
            at = inner.index(core)
            inner = inner[:at] + mark[0] + core + mark[0] + inner[at + len(core) :]
        out.append(inner)
    return "".join(out)


class Transducer(HTMLParser):
    """Start and end tags and text in, blocks of Markdown out.

    Inline text is held as runs with the marks that are open then, and written when its block ends; marks
    that are open still go on in the next block. Lists, quotes, code, tables and dropped parts are
    states of their own.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.runs, self.marks, self.lead = [], [], [], ""
        self.lists, self.quotes, self.raw, self.dropped = [], 0, 0, 0
        self.code, self.link = None, None

    def put(self, text: str) -> None:
        self.runs.append((text, tuple(dict.fromkeys(self.marks))))

    def end_block(self) -> None:
        if self.link is not None:
            self.end_link()
        text = (self.lead + emphasised(self.runs)).strip()
        self.runs, self.lead = [], ""
        if re.sub(r"[*`\s]", "", text):
            self.blocks.append("\n".join("> " + x for x in text.split("\n")) if self.quotes else text)

    def end_link(self) -> None:
        href, at = self.link
        inner, self.link = self.runs[at:], None
        outer = tuple(m for m in dict.fromkeys(self.marks) if all(m in marks for _, marks in inner))
        text = emphasised([(t, tuple(m for m in marks if m not in outer)) for t, marks in inner])
        self.runs[at:] = [(f"[{text}]({href})", outer)]

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if self.code is not None:
            if tag == "br":
                self.code.append("\n")
        elif self.raw:
            self.put(self.get_starttag_text() or "")
            self.raw += tag in KEPT_AS_HTML
        elif tag in DROPPED:
            if tag == "script" and "gist.github.com" in a.get("src", ""):
                self.end_block()
                self.blocks.append(f"[GitHub Gist]({a['src'].rsplit('.js', 1)[0]})")
            self.dropped += tag not in VOID
        elif self.dropped:
            pass
        elif tag in ("iframe", "embed", "object"):
            if src := a.get("src") or a.get("data"):
                self.end_block()
                self.blocks.append(f"[{next((v for k, v in EMBEDS.items() if k in src), EMBEDDED)}]({src})")
        elif tag == "br":
            self.put("  \n")
        elif tag == "img":
            src = resolve(a.get("src", ""))
            if src is not None:
                self.put("![" + a.get("alt", "").replace("]", "\\]") + f"]({src})")
        elif tag == "a":
            if self.link is not None:
                self.end_link()
            self.link = a.get("href", ""), len(self.runs)
        elif tag in EMPHASIS:
            self.marks.append(EMPHASIS[tag])
        elif tag in KEPT_AS_HTML:
            self.end_block()
            self.raw = 1
            self.put(self.get_starttag_text() or "")
        elif tag in BLOCKS:
            self.end_block()
            if tag == "pre":
                self.code = []
            elif tag == "hr":
                self.blocks.append("---")
            elif tag == "blockquote":
                self.quotes += 1
            elif tag in ("ul", "ol"):
                self.lists.append(tag)
            elif tag == "li":
                self.lead = "1. " if self.lists[-1:] == ["ol"] else "- "
            elif tag in HEADINGS:  # a page's title is its own first heading
                self.lead = "#" * min(6, int(tag[1]) + 1) + " "

    def handle_endtag(self, tag):
        if self.code is not None:
            if tag == "pre":
                text, self.code = "".join(self.code).strip("\n"), None
                fence = "`" * max([3, *(len(m) + 1 for m in re.findall("`+", text))])
                if text.strip():
                    self.blocks.append(f"{fence}\n{text}\n{fence}")
        elif self.raw:
            self.put(f"</{tag}>")
            self.raw -= tag in KEPT_AS_HTML
            if not self.raw:
                self.end_block()
        elif tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
        elif self.dropped:
            pass
        elif tag == "a":
            if self.link is not None:
                self.end_link()
        elif tag in EMPHASIS:
            if EMPHASIS[tag] in self.marks:
                del self.marks[len(self.marks) - 1 - self.marks[::-1].index(EMPHASIS[tag])]
        elif tag in CLOSING or tag in ("blockquote", "ul", "ol"):
            self.end_block()
            if tag == "blockquote":
                self.quotes = max(0, self.quotes - 1)
            elif tag in ("ul", "ol"):
                del self.lists[-1:]

    def handle_data(self, data):
        if self.dropped and self.code is None and not self.raw:
            return
        if self.code is not None:
            self.code.append(data)
        elif self.raw:
            self.put(data)
        else:
            text = re.sub(r"  +", " ", re.sub(r"[ \t\r\f\v]*\n[ \t\r\f\v]*", " ", data))
            if text.strip() or self.runs and not self.runs[-1][0].endswith(("\n", " ")):
                self.put(text)

    def markdown(self) -> str:
        self.end_block()
        text = re.sub(r"\n{3,}", "\n\n", "\n\n".join(self.blocks))
        return re.sub(r"[ \t]+\n", lambda m: "  \n" if m[0].startswith("  ") else "\n", text).strip() + "\n"


def to_markdown(html: str) -> str:
    parser = Transducer()
    parser.feed(html)
    parser.close()
    return parser.markdown()


def markdown(html: Column) -> Column:
    """Paragraphs, headings (one level down), lists, quotes, emphasis, links, pictures and code as Markdown; tables stay HTML, embeds become links, scripts and forms go. Null stays null."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(to_markdown, na_action="ignore")

    return F.pandas_udf(run, T.StringType())(html)


def encoded_url(url: Column) -> Column:
    """A URL in ASCII. Null stays null, and what is no URL stays as it is."""

    def one(u: str) -> str:
        try:
            return encode(u)
        except ValueError:
            return u

    def run(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    return F.pandas_udf(run, T.StringType())(url)
