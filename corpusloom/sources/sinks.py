"""Results to files: front matter, registries, manifests, artefacts with their provenance."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Opening line, keys and closing line of front matter, and the body.
_FRONT = r"(?s)\A(---\n)(.*?)((?<=\n)---\n.*)\z"


def with_list_key(text: Column, key: str, values: Column) -> Column:
    """Front matter with one list key set, or taken out where values is null or empty; the body stays byte for byte.

    The key's block is its line and the lines that follow it indented or as list items. Fails on texts without front matter.
    """
    # possessive throughout: Java matches a group that may give back by recursion, one level an item
    block = rf"(?m)^{re.escape(key)}:[^\n]*+\n(?:[ \t-][^\n]*+\n)*+"
    # a Java regular expression ends lines at more than newlines; (?d) keeps it to those
    kept = F.regexp_replace(F.regexp_extract(text, _FRONT, 2), "(?d)" + block, "")
    # a list in JSON is its items in quotes
    item = lambda v: F.concat(F.lit("  - "), F.regexp_replace(F.to_json(F.array(v)), r"\A\[|\]\z", ""), F.lit("\n"))
    added = F.when(F.size(values) > 0, F.concat(F.lit(f"{key}:\n"), F.array_join(F.transform(values, item), ""))).otherwise("")
    whole = F.concat(F.lit("---\n"), kept, added, F.regexp_extract(text, _FRONT, 3))
    return F.when(text.rlike(_FRONT), whole).when(text.isNotNull(), F.raise_error(F.lit("no front matter")))


def update_front_matter(pages: DataFrame, raw_col: str = "raw", lists: tuple[str, ...] = ("temak", "kulcsszavak")) -> DataFrame:
    """Adds new_raw and changed; each list key comes from the array column of its name."""
    new = F.col(raw_col)
    for key in lists:
        new = with_list_key(new, key, F.col(key))
    return pages.withColumn("new_raw", new).withColumn("changed", F.col("new_raw") != F.col(raw_col))


def write_registry(old: DataFrame, new: DataFrame, path: str) -> DataFrame:
    """old and new slugs together, sorted, as lines '- slug'; nothing of old goes."""
    out = old.select("slug").unionByName(new.select("slug")).distinct()
    out.orderBy("slug").select(F.concat(F.lit("- "), "slug").alias("value")).write.mode("overwrite").text(path)
    return out


def write_manifest(rows: DataFrame, path: str) -> DataFrame:
    """A manifest for review; the counts by decision come back."""
    rows.write.mode("overwrite").csv(path, header=True)
    return rows.groupBy("decision").agg(F.count("*").alias("n"))


def write_artefact(rows: DataFrame, path: str, provenance: dict[str, str]) -> None:
    """Rows as JSON lines, and beside them one row that says how they came about."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    rows.sparkSession.createDataFrame([(json.dumps(provenance, sort_keys=True),)], "provenance string").write.mode("overwrite").json(f"{path}/provenance")


def feed_items(posts: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest posts first, as items of an RSS feed."""
    ordered = posts.orderBy(F.desc("published"), "link")
    item = F.concat(F.lit("<item><title>"), "title", F.lit("</title><link>"), "link", F.lit("</link><description>"), "content", F.lit("</description></item>"))
    return (ordered.limit(limit) if limit else ordered).select("link", item.alias("item"))
