"""Cleaning of labels and statistics over label sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_labels(labels: DataFrame, genres: DataFrame, merges: DataFrame, least: int = 2, key: str = "doc_id", source: str = "source") -> DataFrame:
    """labels(key, source, label) -> key, source, label: lower case, merged, genres out, then those of `least` documents or more in a source.

    genres(label) and merges(label, target) are curated lists. Document frequency is counted after both.
    """
    rows = labels.select(key, source, F.lower(F.trim("label")).alias("label"))
    rows = rows.join(F.broadcast(merges), "label", "left").select(key, source, F.coalesce("target", "label").alias("label"))
    rows = rows.join(F.broadcast(genres), "label", "left_anti").distinct()
    enough = rows.groupBy(source, "label").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    return rows.join(enough, [source, "label"]).select(key, source, "label")
