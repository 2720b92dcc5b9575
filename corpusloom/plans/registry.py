"""How queries are named, and how one SQL text serves Spark and DuckDB.

In a text, @name is a table or one of FRAMES; r'...' is a regular expression, which Spark reads as a
raw literal and DuckDB as a plain one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

QUERIES: dict = {}
ORACLES: dict = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(tx.tokens(F.col("text"))).alias("pos", "term"))


def _counts(spark, sf):
    return _tokens(spark, sf).groupBy("doc_id", "term").agg(F.count("*").alias("focus"))


def _sized(spark, sf):
    return table(spark, sf, "documents").withColumn("word_count", F.size(F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " ")).cast("long"))


def _doc_labels(spark, sf):
    labels = table(spark, sf, "labels")
    return (
        table(spark, sf, "documents")
        .join(labels, "doc_id", "left")
        .select("doc_id", "source", F.explode(F.array_compact(F.array(F.concat(F.lit("Lang-"), "lang"), F.concat(F.lit("lang-"), "lang"), F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.concat(F.lit("year-"), F.col("n_chars") % 7)))).alias("label"))
    )


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))


#: Name -> (Spark frame, DuckDB SQL).
FRAMES = {
    "tokens": (_tokens, rf"(SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '{tx.TOKEN}') AS w FROM documents))"),
    "counts": (_counts, rf"(SELECT doc_id, term, count(*) AS focus FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{tx.TOKEN}')) AS term FROM documents) GROUP BY ALL)"),
    "sized": (_sized, r"(SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS word_count FROM documents)"),
    "doc_labels": (_doc_labels, "(SELECT doc_id, source, unnest(list_filter(['Lang-' || lang, 'lang-' || lang, CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END, 'year-' || (n_chars % 7)], lambda x: x IS NOT NULL)) AS label FROM documents LEFT JOIN labels USING (doc_id))"),
    "vectors": (_vectors, "(SELECT vec_id, label, embedding::DOUBLE[] AS vec FROM embeddings)"),
}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = duck(oracle)
        return f

    return add


def duck(text: str) -> str:
    text = re.sub(r"\br'", "'", text)
    return re.sub(r"@(\w+)", lambda m: FRAMES[m[1]][1] if m[1] in FRAMES else m[1], text)


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    names = set(re.findall(r"@(\w+)", text))
    frames = {n: FRAMES[n][0](spark, sf_dir) if n in FRAMES else table(spark, sf_dir, n) for n in names}
    form = re.sub(r"@(\w+)", r"{\1}", text.replace("{", "{{").replace("}", "}}"))
    return spark.sql(form, **frames)


def sql(name: str, text: str, oracle: str | None = "") -> None:
    """A query in SQL; the oracle is the same text where both dialects read it alike, None where SQL cannot check it."""
    query(name, text if oracle == "" else oracle)(lambda spark, sf_dir, text=text: run_sql(spark, sf_dir, text))
