"""A placement's release check: better than the baseline on held-out items, and wide and even enough."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate


@dataclass(frozen=True)
class Limits:
    """What a placement has to reach; all of them parameters."""

    delta: float = 0.03  # least gain of BCubed F over the stronger baseline, whose interval must lie above zero
    coverage: float = 0.40  # least share of items with a theme
    coverage_pages: float = 0.70  # the same for long pages
    share: float = 0.25  # greatest share of items, and of pages, that one theme may have


def spread(items: DataFrame, placed: str) -> DataFrame:
    """One row (coverage, mean_themes, largest_share) of an array column of themes, null for none."""
    themes = F.array_distinct(F.coalesce(placed, F.array().cast("array<string>")))
    rows = items.select(themes.alias("t"))
    total = rows.agg(F.count("*").alias("n"), F.avg((F.size("t") > 0).cast("double")).alias("coverage"), F.avg(F.size("t")).alias("mean_themes"))
    top = rows.select(F.explode("t").alias("theme")).groupBy("theme").agg(F.count("*").alias("c")).agg(F.coalesce(F.max("c"), F.lit(0)).alias("top"))
    # one row on either side
    return total.crossJoin(top).select("coverage", "mean_themes", (F.col("top") / F.col("n")).alias("largest_share"))


def named_posts(posts: DataFrame, forbidden: list[str]) -> DataFrame:
    """posts(key, new array, expected array) with ok: none of the forbidden themes, and one of the expected or none at all."""
    got = F.coalesce("new", F.array().cast("array<string>"))
    barred = F.array(*[F.lit(x) for x in forbidden]).cast("array<string>")
    return posts.withColumn("ok", ~F.arrays_overlap(got, barred) & ((F.size(got) == 0) | F.arrays_overlap(got, F.col("expected"))))


def gate(items: DataFrame, genres: list[str], limits: Limits = Limits(), resamples: int = 2_000, seed: int = 42, pages: DataFrame | None = None, posts: DataFrame | None = None, forbidden: list[str] = ()) -> DataFrame:
    """items(new array, base array, gold array) -> one row of figures and the verdict, passed.

    The baseline is the stronger by BCubed F of base as it is (A) and base without its genre-like themes (B).
    pages(new array) are the long pages, with a limit of their own; posts(key, new, expected) are those whose themes
    are known beforehand, judged by named_posts(). Without either, its part counts as passed.
    """
    both = items.withColumn("bare", F.array_except("base", F.array(*[F.lit(g) for g in genres]).cast("array<string>")))
    f = {name: evaluate.bcubed(both.withColumn("key", F.lit(0)), col).first()["f"] for name, col in (("new", "new"), ("A", "base"), ("B", "bare"))}
    stronger = "A" if (f["A"] or 0.0) >= (f["B"] or 0.0) else "B"
    delta = evaluate.paired_bootstrap(both, "base" if stronger == "A" else "bare", "new", "gold", resamples, seed)
    new = spread(items, "new")
    old = spread(items, "base").select(F.col("mean_themes").alias("mean_themes_base"))
    out = delta.crossJoin(new).crossJoin(old).select(F.lit(stronger).alias("stronger"), F.lit(f["new"]).alias("f_new"), F.lit(f[stronger]).alias("f_base"), "delta", "low", "high", "n", "coverage", "mean_themes", "mean_themes_base", "largest_share")
    better = (F.col("delta") >= limits.delta) & (F.col("low") > 0)
    wide = (F.col("coverage") >= limits.coverage) & (F.col("mean_themes") <= F.col("mean_themes_base")) & (F.col("largest_share") <= limits.share)
    known = F.lit(True)
    if pages is not None:
        out = out.crossJoin(spread(pages, "new").select(F.col("coverage").alias("coverage_pages"), F.col("largest_share").alias("largest_share_pages")))
        wide = wide & (F.col("coverage_pages") >= limits.coverage_pages) & (F.col("largest_share_pages") <= limits.share)
    if posts is not None:
        out = out.crossJoin(named_posts(posts, list(forbidden)).agg(F.count("*").alias("n_posts"), F.count_if(~F.col("ok")).alias("bad_posts")))
        known = F.col("bad_posts") == 0
    return out.withColumn("better", better).withColumn("wide", wide).withColumn("known", known).withColumn("passed", F.col("better") & F.col("wide") & F.col("known"))
