"""Placement of arriving vectors against a frozen calibration, and work on unseen texts only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..operators.placement import Rules


def place_stream(vectors: DataFrame, themes: DataFrame, rules: Rules, key: str = "vec_id") -> DataFrame:
    """vectors(key, kind, vec) -> key, themes, best: stateless, so it runs on streams and batches alike.

    themes(theme, k, vec) is the frozen side, collected into one row and broadcast; it is a curated list.
    The rules are those of operators.placement.place for writings without seeds.
    """
    packed = themes.select(F.struct("theme", "k", "vec").alias("t")).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    rows = vectors.join(F.broadcast(packed))
    sims = F.transform("ts", lambda t: F.struct((-vx.dot(F.col("vec"), t["vec"])).alias("minus"), t["theme"].alias("theme"), rules.threshold_column(t["k"], F.col("kind")).alias("thr")))
    rows = rows.withColumn("s", F.array_sort(sims)).withColumn("best", -F.col("s")[0]["minus"])
    over = F.filter("s", lambda x: -x["minus"] >= x["thr"])
    rows = rows.withColumn("over", over)
    near = F.filter("over", lambda x: F.col("best") + x["minus"] <= rules.delta)
    first = F.slice("over", 1, 1)
    chosen = F.slice(F.array_distinct(F.concat(first, near)), 1, rules.cap)
    return rows.select(key, F.transform(chosen, lambda x: x["theme"]).alias("themes"), "best")


def unseen(rows: DataFrame, cache: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct texts that the cache(text_sha) lacks."""
    return rows.withColumn("text_sha", F.sha2(text_col, 256)).dropDuplicates(["text_sha"]).join(cache.select("text_sha"), "text_sha", "left_anti")


def visible(rows: DataFrame, published: str, build_ts) -> DataFrame:
    """Rows that are due at build_ts."""
    return rows.where(F.col(published) <= F.lit(build_ts))
