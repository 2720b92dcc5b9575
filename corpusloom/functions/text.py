"""Text functions: Column in, Column out, inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import unicode as un

#: Unicode words; DuckDB and Java agree on this pattern, while they differ on \w.
TOKEN = r"[\p{L}\p{N}_]+"
WORDLIKE = r"^\p{L}[\p{L}\p{N}.\-]*$"
MIN_FIT_WORDS = 80

# What Markdown and leftover URLs look like.
CODE_FENCE = r"(?s)```.*?```"
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
LINK = r"\[([^\]]*)\]\([^)]*\)"
TAG = r"<[^>]+>"
URL_JUNK = r"(?i)\S*%[0-9A-Fa-f]{2}\S*|\S+\.(?:jpg|jpeg|png|gif|webp|svg|pdf)\b"
LINE_MARKER = r"(?m)^[ \t]{0,3}(?:[#>]+|[-+*])[ \t]+"


#: Words of junk, tried once each and not from every letter of a word.
_JUNK_WORDS = r"(?U)(?i)(?<!\S)(?:" + URL_JUNK.removeprefix("(?i)") + ")"


def _replaced_up_to(text: Column, last: str, pattern: str, to: str) -> Column:
    """The pattern replaced in what stands before the last `last`, with which every match ends: openings that nothing closes are not searched from."""

    def replaced(t):
        rest = F.length(F.substring_index(t, last, -1))
        return F.concat(F.regexp_replace(F.left(t, F.length(t) - rest), pattern, to), F.right(t, rest))

    # one name for the text, or each step would hold the steps before it several times over
    return F.element_at(F.transform(F.array(text), lambda t: replaced(t)), 1)


def strip_markup(text: Column) -> Column:
    """Markdown -> plain prose; the order of the steps matters."""
    text = F.regexp_replace(text, CODE_FENCE, " ")
    for end, pattern, to in ((")", IMAGE, " "), (")", LINK, "$1"), (">", TAG, " ")):
        text = _replaced_up_to(text, end, pattern, to)
    for pattern, to in ((_JUNK_WORDS, " "), (LINE_MARKER, ""), (r"[*]+", ""), (r"(?U)\s+", " "), (r"(?U)\s+([,.;:!?…])", "$1")):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Words by Unicode white space, without empty ones."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit("")))).cast("long")


def length_class(n_words: Column) -> Column:
    return F.when(n_words >= MIN_FIT_WORDS, "long").otherwise("short")


def strip_html(text: Column) -> Column:
    return F.trim(F.regexp_replace(_replaced_up_to(text, ">", TAG, " "), r"(?U)\s+", " "))


def import_slug(text: Column, most: int = 70) -> Column:
    """ASCII slug without accents, cut at a hyphen within `most` characters; a fixed word where nothing is left.

    Characters that decompose to several (ligatures, fractions) keep all their letters and digits.
    """
    slug = F.regexp_replace(F.regexp_replace(F.lower(un.decomposed(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    head = F.substring(slug, 1, most)
    cut = F.when(F.length(slug) <= most, slug).otherwise(F.when(F.contains(head, F.lit("-")), F.regexp_replace(head, r"-[^-]*$", "")).otherwise(head))
    return F.when(cut == "", "bejegyzes").otherwise(cut)


def hub_slug(folded: Column) -> Column:
    """Slug of a term that is folded already: letters and digits stay, everything else is one hyphen."""
    return F.regexp_replace(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def term_directory(term: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(term)), r"(?U)\s+", "-")


def is_acronym(term: Column) -> Column:
    letters = F.regexp_replace(term, r"[^\p{L}]", "")
    return (F.length(letters) >= 2) & letters.rlike(r"^\p{Lu}+$")


def split_of(key: Column) -> Column:
    """dev or test by the parity of the last byte of SHA-1."""
    return F.when(F.conv(F.right(F.sha1(key), F.lit(1)), 16, 10).cast("int") % 2 == 0, "dev").otherwise("test")


def truncate_words(text: Column, most: int = 300) -> Column:
    """At most `most` characters, cut at a word boundary and closed with an ellipsis."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most), r" [^ ]*$", ""), F.lit("…")))


def first_sentence(text: Column) -> Column:
    return F.regexp_extract(text, r"^[^.!?]+[.!?]", 0)


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?<=[.!?…])\s+"), lambda s: s != "")


def chunks(ws: Column, size: int) -> Column:
    """An array of words in runs of `size`."""
    n = F.ceil(F.size(ws) / F.lit(size)).cast("int")
    return F.when(F.size(ws) == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(ws, i * size + 1, size)))


def chunk_texts(text: Column, size: int) -> Column:
    """A text in runs of `size` words, as they stand in it: one pass, as opposed to slices of an array of words."""
    word, space = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
    return F.regexp_extract_all(text, F.lit(rf"(?:{word}++{space}*+){{1,{size}}}"), F.lit(0))


def paragraph_pieces(text: Column, most: int = 6000) -> Column:
    """A text in pieces of whole paragraphs (lines), of at most `most` characters unless one paragraph alone is longer. A piece does not begin with an empty line."""
    whole_lines = rf"(?s)[^\n].{{0,{most - 1}}}(?=\n|\z)|[^\n]++"
    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(whole_lines), F.lit(0)))


def matches_lemma(surface: Column, lemma: Column, least: int = 5) -> Column:
    """Does a surface form begin as the lemma does: with all of it, or with its first letters?"""
    return F.startswith(F.lower(surface), F.substring(F.lower(lemma), 1, least))


def evidence(text: Column, terms: Column, most: int = 400) -> Column:
    """The sentence of `most` characters at most in which most of the terms (an array) begin a word; the earliest of equals, null where no term does."""

    def told(sentence, place):
        ws = tokens(sentence)
        used = F.size(F.filter(terms, lambda t: F.exists(ws, lambda w: F.startswith(w, F.lower(t)))))
        return F.struct(used.alias("used"), (-place).alias("place"), sentence.alias("sentence"))

    parts = F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), lambda x: F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")), lambda x: (x != "") & (F.length(x) <= most))
    best = F.array_max(F.transform(parts, told))
    return F.when(best["used"] > 0, best["sentence"])


def odd_markers(body: Column) -> Column:
    """struct(fences, emphasis): an odd number of code fences, a paragraph with an odd number of **."""
    fences = (F.size(F.split(body, "```")) - 1) % 2 == 1
    emphasis = F.exists(F.split(body, "\n\n"), lambda p: (F.size(F.split(p, r"\*\*")) - 1) % 2 == 1)
    return F.struct(fences.alias("fences"), emphasis.alias("emphasis"))


#: Fixed value: characters with which a YAML scalar needs quotes.
YAML_SPECIAL = ":#[]{},&*!|>%@`\"'"


def yaml_quote(value: Column, always: bool = False) -> Column:
    """A scalar of YAML: as it is where nothing in it needs quotes (and they aren't asked for), else in double quotes."""
    special = "[" + "".join("\\" + c for c in YAML_SPECIAL) + "]"
    quoted = F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    plain = (value != "") & ~value.rlike(special) & ~value.rlike(r"(?U)\A\s|\s\z")
    return quoted if always else F.when(plain, value).otherwise(quoted)


def yaml_unquote(value: Column) -> Column:
    """One pair of quotes off, and what they escape as it was."""
    bare = F.btrim(value, F.lit(" \t\n\r\x0b\x0c"))
    inner = F.substring(bare, F.lit(2), F.length(bare) - 2)
    double = F.regexp_replace(inner, r'\\([\\"])', "$1")
    quoted = lambda q: (F.length(bare) >= 2) & F.startswith(bare, F.lit(q)) & F.endswith(bare, F.lit(q))
    return F.when(quoted('"'), double).when(quoted("'"), F.replace(inner, F.lit("''"), F.lit("'"))).otherwise(bare)


def content_word(xpostag: Column, pronouns: bool = True) -> Column:
    """Is the first bracket group of a tag noun, verb, adjective or adverb (and, on request, no pronoun)?"""
    group = F.split(F.regexp_extract(xpostag, r"^\[/?([^\]]*)\]", 1), r"\|")
    content = F.get(group, F.lit(0)).isin("N", "V", "Adj", "Adv")
    return content & F.lit(pronouns) | content & ~F.exists(group, lambda x: F.regexp_replace(x, r"[()]", "").isin("Pro"))
