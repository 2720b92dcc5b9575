"""Checks of a built site: what its pages link to, are called and carry, against what was built and is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed

HREF = r"""<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""
HEADING = r"(?is)<h1[^>]*>([^<]*)</h1>"
INSIDE_OUT = ")[http"


def path_of(link: Column) -> Column:
    """The path of a link within the site, without query, fragment and closing slash; the root is empty."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(link, r"[?#].*", ""), r"^[a-z]+://[^/]*", ""), r"/+$", "")


def redirected(redirects: DataFrame) -> DataFrame:
    """redirects(source, target) -> source, target: where each chain ends; sources whose chain goes round for ever are left out.

    Pointers are doubled, so a chain of n redirects takes about log2(n) joins; a chain that has not ended
    after as many rounds as the table could need goes round.
    """
    hops = checkpointed(redirects.select("source", "target").groupBy("source").agg(F.min("target").alias("target")))
    rounds = hops.count().bit_length() + 1
    for _ in range(rounds):
        on = hops.select(F.col("source").alias("target"), F.col("target").alias("beyond"))
        if not hops.join(on, "target", "left_semi").limit(1).count():
            return hops
        hops = checkpointed(hops.join(on, "target", "left").select("source", F.coalesce("beyond", "target").alias("target")))
    return hops.join(hops.select(F.col("source").alias("target")), "target", "left_anti").select("source", "target")


def checks(pages: DataFrame, redirects: DataFrame, registry: DataFrame, names: DataFrame, carried: DataFrame, required: str) -> DataFrame:
    """Eight rows (check, n_checked, n_bad, first_bad); a site is sound if n_bad is 0 in all of them.

    pages(path, html) are what was built, redirects(source, target) and registry(path) are paths, names(name)
    the names in use, carried(path, name) the names that contents carry; `required` is the page that the
    home page must link to. Paths are as path_of() gives them.

    links: every distinct internal link ends at a built page, through redirects if need be. blind: there are such
    links at all. registry: every path ever published is built or redirected to a built one. headings: every first heading
    is a name in use. names: every name carried is in use. inside_out: no link of Markdown is written
    inside out. twice: no path is built twice. required: the required page is built, and linked from the home page.
    """
    built = pages.select("path").distinct()
    ends = redirected(redirects).join(built.withColumnRenamed("path", "target"), "target", "left_semi").select(F.col("source").alias("path"))
    alive = checkpointed(built.unionByName(ends).distinct())
    hrefs = checkpointed(pages.select("path", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)))).alias("href")).where(F.startswith("href", F.lit("/")) & ~F.startswith("href", F.lit("//"))).select(F.col("path").alias("at"), path_of(F.col("href")).alias("path")))
    links = hrefs.select("path").distinct()

    def against(rows: DataFrame, known: DataFrame, column: str, name: str) -> DataFrame:
        """Distinct values of a column that `known` lacks."""
        rows = rows.select(column).distinct()
        found = rows.join(known.select(column).distinct().withColumn("ok", F.lit(True)), column, "left")
        bad = F.when(F.col("ok").isNull(), F.col(column))
        return found.agg(F.lit(name).alias("check"), F.count("*").alias("n_checked"), F.count(bad).alias("n_bad"), F.min(bad).alias("first_bad"))

    def counted(rows: DataFrame, bad: Column, shown: Column, name: str) -> DataFrame:
        return rows.agg(F.lit(name).alias("check"), F.count("*").alias("n_checked"), F.count_if(bad).alias("n_bad"), F.min(F.when(bad, shown)).alias("first_bad"))

    headings = pages.select(F.trim(F.regexp_extract("html", HEADING, 1)).alias("name")).where("name <> ''")
    n_links, n_built, n_home = F.col("n_links"), F.col("n_built"), F.col("n_home")
    none = F.lit(None).cast("string")
    out = against(links, alive, "path", "links")
    out = out.unionByName(links.agg(F.count("*").alias("n_links")).select(F.lit("blind").alias("check"), n_links.alias("n_checked"), F.when(n_links == 0, 1).otherwise(0).cast("long").alias("n_bad"), none.alias("first_bad")))
    out = out.unionByName(against(registry, alive, "path", "registry"))
    out = out.unionByName(against(headings, names, "name", "headings"))
    out = out.unionByName(against(carried, names, "name", "names"))
    out = out.unionByName(counted(pages, F.contains("html", F.lit(INSIDE_OUT)), F.col("path"), "inside_out"))
    out = out.unionByName(counted(pages.groupBy("path").agg(F.count("*").alias("n")), F.col("n") > 1, F.col("path"), "twice"))
    home = hrefs.where((F.col("at") == "") & (F.col("path") == required)).agg(F.count("*").alias("n_home"))
    there = built.where(F.col("path") == required).agg(F.count("*").alias("n_built"))
    missing = F.when(n_built == 0, 1).otherwise(0) + F.when(n_home == 0, 1).otherwise(0)
    # one row on either side
    return out.unionByName(home.crossJoin(there).select(F.lit("required").alias("check"), F.lit(2).cast("long").alias("n_checked"), missing.cast("long").alias("n_bad"), F.when(missing > 0, F.lit(required)).alias("first_bad")))
