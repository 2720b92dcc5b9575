"""Hubs of themes and keywords: spellings, members, counts, registries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions import unicode as un


def canonical_forms(counts: DataFrame) -> DataFrame:
    """counts(term, n) -> term, canonical: an acronym, else the most frequent spelling, else lower case first, else by alphabet.

    Spellings are aggregated by their folded form, so no group is sorted.
    """
    rows = counts.withColumn("folded", un.fold("term"))
    order = F.struct((~tx.is_acronym(F.col("term"))).alias("a"), (-F.col("n")).alias("b"), (~F.substring("term", 1, 1).rlike(r"^\p{Ll}")).alias("c"), F.col("term").alias("d"))
    best = rows.groupBy("folded").agg(F.min_by("term", order).alias("canonical"))
    return rows.join(best, "folded").select("term", "canonical")


def members(rows: DataFrame, label: str, fields: list[str], order: list) -> DataFrame:
    """label, n, members: the members of each hub as an ordered array of structs."""
    keyed = F.struct(*[o.alias(f"_o{k}") for k, o in enumerate(order)], *fields)
    packed = rows.groupBy(label).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(keyed)).alias("m"))
    return packed.select(label, "n", F.transform("m", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("members"))


def registry_union(old: DataFrame, new: DataFrame) -> DataFrame:
    """An append-only set: nothing of old goes."""
    return old.unionByName(new).distinct()


def unique_slugs(rows: DataFrame, slug: str, order: list[str]) -> DataFrame:
    """slug -> unique_slug: the first keeps it, later ones get -2, -3 and so on."""
    w = Window.partitionBy(slug).orderBy(*order)
    n = F.row_number().over(w)
    return rows.withColumn("unique_slug", F.when(n == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), n)))
