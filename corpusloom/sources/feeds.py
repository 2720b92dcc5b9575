"""Exports of blogs, analyser output, manifests, artefacts and crawled pages."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

ATOM = "id string, title string, published string, author struct<name:string>, content string, category array<struct<_term:string>>, type string, status string"
WXR = "title string, link string, post_id string, post_type string, status string, post_date_gmt string, encoded string, category array<struct<_VALUE:string,_domain:string>>"


def atom_entries(spark: SparkSession, path: str, author: str) -> tuple[DataFrame, DataFrame]:
    """Entries of an Atom export to keep, and the counts of the rest by reason."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(path)
    reason = F.when(~F.col("type").eqNullSafe("POST"), "not a post").when(~F.col("status").eqNullSafe("LIVE"), "not live").when(~F.col("author.name").eqNullSafe(author), "other author")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def wxr_items(spark: SparkSession, path: str) -> DataFrame:
    """Published posts of a WXR export, their time in ISO form."""
    rows = spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", "true").schema(WXR).load(path)
    return rows.where("post_type = 'post' AND status = 'publish'").withColumn("published", F.date_format(F.try_to_timestamp("post_date_gmt", F.lit("yyyy-MM-dd HH:mm:ss")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def analyser_tokens(replies: DataFrame, id_col: str = "doc_id", text_col: str = "tsv") -> DataFrame:
    """Tab-separated replies with a header -> id, pos, form, lemma, xpostag; columns are found by name, short and blank lines skipped.

    A reply whose header lacks a column is an error.
    """
    lines = F.filter(F.split(text_col, "\n"), lambda x: F.trim(x) != "")
    head = F.split(lines[0], "\t")
    at = {c: F.array_position(head, c) for c in ("form", "lemma", "xpostag")}
    rows = replies.select(id_col, *[F.when(p == 0, F.raise_error(F.lit(f"no column {c}"))).otherwise(p).alias(f"_{c}") for c, p in at.items()], F.posexplode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("pos", "_line"))
    cells = F.split("_line", "\t")
    rows = rows.withColumn("_cells", cells).where(F.size("_cells") >= F.greatest("_form", "_lemma", "_xpostag"))
    return rows.select(id_col, "pos", *[F.element_at("_cells", F.col(f"_{c}").cast("int")).alias(c) for c in at])


def page_metadata(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds title, description and links of crawled pages."""
    h = F.col(html_col)
    return pages.withColumn("title", F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)).withColumn("description", F.regexp_extract(h, r'(?is)<meta[^>]+(?:name|property)="(?:og:)?description"[^>]+content="([^"]*)"', 1)).withColumn("links", F.regexp_extract_all(h, F.lit(r'<a href="([^"]*)"'), F.lit(1)))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A reviewed import manifest: decisions by address."""
    return spark.read.csv(path, header=True, schema="url string, title string, decision string, reason string")


def artefact(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """A JSON artefact; where it is absent, an error (strict) or an empty frame."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not strict and not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def themes(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A curated theme list as typed rows with defaults; unknown states are refused."""
    out = []
    for r in rows:
        state = r.get("allapot", "aktiv")
        if state not in schemas.THEME_STATES:
            raise ValueError(f"unknown state {state!r} of theme {r.get('kulcs')!r}")
        out.append((r["kulcs"], r["nev"], r.get("leiras"), state, list(r.get("magok", [])), list(r.get("korabbi_nevek", [])), r.get("atiranyitas"), {k: str(v) for k, v in (r.get("eredet") or {}).items()}))
    return spark.createDataFrame(out, schemas.THEME)


class StaleCalibrationError(ValueError):
    """The theme list has changed since the calibration was frozen."""


def calibration(path: str, themes_path: str) -> dict:
    """A frozen calibration, refused where the theme list's hash is not the one that it was frozen with."""
    frozen = json.loads(Path(path).read_text(encoding="utf-8"))
    if hashlib.sha256(Path(themes_path).read_bytes()).hexdigest() != frozen.get("themes_sha256"):
        raise StaleCalibrationError(path)
    return frozen
