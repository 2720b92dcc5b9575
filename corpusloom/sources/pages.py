"""Markdown pages with front matter, lists in YAML, registries: read as text, parsed by column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

FRONT_MATTER = r"(?s)\A---\n(.*?)\n---\n"
#: Sources whose pages can be fitted; rows of lists never are.
PAGE_SOURCES = ("archive", "posts")


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """path, raw: whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def scalar(front: Column, key: str) -> Column:
    """A one-line value of a key, without its quotes; null where the key is absent."""
    pattern = rf'(?m)^{key}:[ \t]*"?(.*?)"?[ \t]*$'
    return F.when(front.rlike(pattern), F.regexp_extract(front, pattern, 1))


def list_items(front: Column, key: str) -> Column:
    """The items of a list key, in block or in flow form; an empty array where the key is absent."""
    flow = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*\[(.*)\][ \t]*$", 1)
    block = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*\n((?:[ \t]++- [^\n]*+(?:\n|\z))*+)", 1)
    items = F.when(flow != "", F.transform(F.regexp_extract_all(flow, F.lit(r'(?:"(?:[^"\\]++|\\.)*+"|[^,"]++|")++'), F.lit(0)), lambda x: F.trim(x))).otherwise(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]+- (.*)$"), F.lit(1)))
    return F.filter(F.transform(items, tx.yaml_unquote), lambda x: x != "")


def parse_pages(files: DataFrame, source: str) -> DataFrame:
    """files(path, raw) -> the document columns and the front matter; files without front matter and empty texts go."""
    front = F.regexp_extract("raw", FRONT_MATTER, 1)
    rows = files.where(F.col("raw").rlike(FRONT_MATTER) & ~F.col("path").rlike(r"_index\.md$")).withColumn("front", front)
    body = tx.strip_markup(F.regexp_replace("raw", FRONT_MATTER, ""))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    year = F.expr("try_cast(substring(_date, 1, 4) AS int)")
    rows = rows.withColumn("_date", scalar(F.col("front"), "date")).withColumn("text", body).withColumn("_words", tx.word_count(F.col("text")))
    out = rows.select(F.col("path").alias("doc_id"), F.coalesce(scalar(F.col("front"), "title"), stem).alias("title"), "text", F.lit(source).alias("source"), year.alias("year"), (F.lit(source in PAGE_SOURCES) & (F.col("_words") >= tx.MIN_FIT_WORDS)).alias("fittable"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("key"), "front")
    return out.where("text <> ''")


def parse_rows(files: DataFrame, source: str, key: str) -> DataFrame:
    """files(path, raw) of YAML lists -> one document a block that has a title; text is title and body."""
    blocks = files.select("path", F.posexplode(F.split("raw", r"\n(?=  - |- )")).alias("pos", "block"))
    field = lambda name: scalar(F.regexp_replace(F.col("block"), r"(?m)^(?:  )?(?:- |  )", ""), name)
    rows = blocks.withColumn("title", field("cim")).where("title IS NOT NULL AND title <> ''")
    year = F.expr("try_cast(substring(_year, 1, 4) AS int)")
    rows = rows.withColumn("_year", F.coalesce(field("datum"), field("ev"))).withColumn("url", F.coalesce(field("link"), field("forras")))
    text = tx.strip_markup(F.concat_ws(". ", "title", field(key)))
    return rows.select(F.concat("path", F.lit(":"), "pos").alias("doc_id"), "title", text.alias("text"), F.lit(source).alias("source"), year.alias("year"), F.lit(False).alias("fittable"), "url", F.coalesce("url", F.concat("path", F.lit(":"), "pos")).alias("key"))


def corpus(*parts: DataFrame) -> DataFrame:
    """All sources as one corpus."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.where("trim(text) <> ''")


def author_labels(pages: DataFrame, key: str = "regi_cimkek") -> DataFrame:
    return pages.select("doc_id", F.explode(list_items(F.col("front"), key)).alias("label"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The lines '- slug' of an append-only registry."""
    return spark.read.text(path).where(F.col("value").startswith("- ")).select(F.trim(F.substring("value", 3, 1_000_000)).alias("slug")).distinct()
