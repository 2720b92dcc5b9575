"""Keywords of a document against the rest of the corpus, by the Simple Maths score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from .lineage import checkpointed

#: At most so many terms have their totals broadcast.
FREQUENT = 200_000
#: Characters of the texts that one task counts.
PART_CHARS = 8 << 20


def doc_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, focus): how often each term is in each document."""
    return docs.select(id_col, F.explode(tx.tokens(F.col(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("focus"))


def totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("focus").alias("total"))


def leave_one_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """(id, term, focus, reference, n_focus, n_reference) of terms that a document has `least` times or more: it is compared with all others, not with itself.

    Texts are dealt out by document once, in parts of PART_CHARS characters, and counted where they are. Totals of the
    frequent terms, FREQUENT of them at most, are broadcast; only counts of the others meet their totals by a shuffle.
    """
    token, own = tx.tokens(F.col(text_col)), Window.partitionBy(id_col)
    known = checkpointed(docs.select(F.explode(token).alias("term")).groupBy("term").agg(F.count("*").alias("total")))
    powers = known.groupBy(F.length(F.bin("total")).alias("bits")).agg(F.count("*").alias("n"), F.sum("total").alias("sum")).collect()  # 64 rows at most
    n_all = sum(r["sum"] for r in powers)
    bits = min(b for b in range(1, 66) if sum(r["n"] for r in powers if r["bits"] >= b) <= FREQUENT)
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // PART_CHARS))
    rows = docs.where(F.col(id_col).isNotNull()).select(id_col, text_col).repartition(parts, id_col).select(id_col, token.alias("_tokens"))
    rows = rows.withColumn("n_focus", F.sum(F.array_size("_tokens")).over(own)).select(id_col, "n_focus", F.explode("_tokens").alias("term"))

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy(id_col, "n_focus", "term").agg(F.count("*").alias("focus")).where(F.col("focus") >= least)

    often = F.broadcast(known.where(F.length(F.bin("total")) >= bits))
    if all(r["bits"] >= bits for r in powers):
        out = counted(rows).join(often, "term")
    else:
        few = F.broadcast(known.where(F.length(F.bin("total")) >= bits).select("term"))
        out = counted(rows.join(few, "term", "left_semi")).join(often, "term")
        out = out.unionByName(counted(rows.join(few, "term", "left_anti")).join(known.where(F.length(F.bin("total")) < bits), "term"))
    return out.select(id_col, "term", "focus", (F.col("total") - F.col("focus")).alias("reference"), "n_focus", (F.lit(n_all).cast("long") - F.col("n_focus")).alias("n_reference"))


def scored(rows: DataFrame, k: float = 1.0) -> DataFrame:
    """Adds score = (f per million + k) / (r per million + k) and effect_size = log2 of the rates' ratio (0.5 for an absent reference)."""
    f = F.col("focus") * 1e6 / F.col("n_focus")
    r = F.col("reference") * 1e6 / F.col("n_reference")
    absent = F.when(F.col("reference") == 0, 0.5).otherwise(F.col("reference").cast("double"))
    effect = F.log2((F.col("focus") / F.col("n_focus")) / (absent / F.col("n_reference")))
    return rows.withColumn("score", (f + k) / (r + k)).withColumn("effect_size", effect).where(f > r)


def top_keywords(docs: DataFrame, top: int = 8, least: int = 2, k: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The `top` positive keywords of each document that occur in it `least` times or more."""
    rows = scored(leave_one_out(docs, id_col, text_col, least), k)
    place = Window.partitionBy(id_col).orderBy(F.desc("score"), "term")
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top).select(id_col, "rank", "term", "score", "effect_size", "focus")
