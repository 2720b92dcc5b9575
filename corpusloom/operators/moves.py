"""Moves between two placements: old theme names replayed through a log of renames, then compared with the new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import TASK_ROWS, checkpointed, parts_for

#: What can become of a writing's themes.
KINDS = ("unchanged", "still none", "loses all", "gains", "widened", "narrowed", "changed")


def _followed(points: DataFrame, log: DataFrame, most: int = TASK_ROWS) -> DataFrame:
    """points(name, at) -> name, at, next: the first rename of the name after `at`, null if there is none. Null at comes before all renames.

    Points and renames of a name meet in one sorted group. A name with more than `most` of them is cut by quantiles of `at`
    (numbers or times) into blocks of about that many; where a block has no later rename, the first of the blocks after it counts.
    """
    events = points.select("name", "at", F.lit(None).cast(log.schema["at"].dataType).alias("then"))
    events = events.unionByName(log.where("old IS NOT NULL").select(F.col("old").alias("name"), "at", F.col("at").alias("then")))
    sizes = events.groupBy("name").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("n"), F.max(F.when(F.col("name").isNotNull(), F.col("n"))).alias("largest")).first()
    parts = parts_for(log.sparkSession, total.n or 0, most)
    blocks = -(-(total.largest or 0) // most)
    if blocks > 1:
        hot = F.broadcast(sizes.where((F.col("n") > most) & F.col("name").isNotNull()).select("name"))  # a share of 1 / most of the rows at most
        quantiles = events.join(hot, "name").groupBy("name").agg(F.percentile_approx("at", [k / blocks for k in range(1, blocks)]).alias("cuts"))
        events = events.join(F.broadcast(quantiles), "name", "left")
        events = events.withColumn("block", F.when(F.col("cuts").isNotNull(), F.size(F.filter("cuts", lambda x: x <= F.col("at")))).otherwise(0)).drop("cuts")
    else:
        events = events.withColumn("block", F.lit(0))
    # downwards, and points before renames of the same time, so that the last rename met is the next one
    down = Window.partitionBy("name", "block").orderBy(F.desc("at"), F.col("then").isNotNull())
    met = events.repartition(parts, "name", "block").withColumn("next", F.last("then", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = met.where("then IS NULL AND name IS NOT NULL").select("name", "at", "block", "next")
    if blocks > 1:
        firsts = events.join(hot, "name").where("then IS NOT NULL").groupBy("name", "block").agg(F.min("then").alias("first"))
        firsts = firsts.groupBy("name").agg(F.collect_list(F.struct("block", "first")).alias("firsts"))
        later = F.array_min(F.transform(F.filter("firsts", lambda x: x["block"] > F.col("block")), lambda x: x["first"]))
        found = found.join(F.broadcast(firsts), "name", "left").withColumn("next", F.coalesce("next", later))
    unnamed = points.where("name IS NULL").select("name", "at", F.lit(None).cast(log.schema["at"].dataType).alias("next"))
    return found.select("name", "at", "next").unionByName(unnamed)


def replayed(log: DataFrame) -> DataFrame:
    """log(at, old, new), at unique -> at, old, new, final: the name in the end of what was renamed then.

    A rename is followed by the next rename of its new name, if there is one; names may come back, as
    only later renames count. Pointers are doubled until none moves: a chain of n renames takes about
    log2(n) equi-joins. Renames that have reached their end are looked up, but not joined again: they have
    no next, and rows without a key would all meet in one task.
    """
    parts = parts_for(log.sparkSession, log.count())
    steps = checkpointed(_followed(log.select(F.col("new").alias("name"), "at"), log).select("at", "next", F.col("name").alias("final")))
    every, live = steps.where("next IS NULL"), steps.where("next IS NOT NULL")
    while live.limit(1).count():
        on = every.unionByName(live).select(F.col("at").alias("next"), F.col("next").alias("beyond"), F.col("final").alias("reached"))
        steps = checkpointed(live.select("at", "next").repartition(parts, "next").join(on.repartition(parts, "next"), "next").select("at", F.col("beyond").alias("next"), F.col("reached").alias("final")))
        every, live = every.unionByName(steps.where("next IS NULL")), steps.where("next IS NOT NULL")
    return log.repartition(parts, "at").join(every.select("at", "final").repartition(parts, "at"), "at").select("at", "old", "new", "final")


def current_names(recorded: DataFrame, log: DataFrame, registry: DataFrame | None = None, name: str = "name", at: str = "at") -> DataFrame:
    """recorded(name, at, ...) with current: the name that it has after all renames later than `at`; null at is before all of them.

    With a registry(name, ...), a name that it lacks in the end is an error, which tells the name.
    """
    names = recorded.select(F.col(name).alias("name"), F.col(at).alias("at")).distinct()
    found = checkpointed(_followed(names, log))
    parts = parts_for(log.sparkSession, max(log.count(), recorded.count()))
    ends = replayed(log).select(F.col("at").alias("next"), "final")
    moved = found.where("next IS NOT NULL").repartition(parts, "next").join(ends.repartition(parts, "next"), "next").select("name", "at", F.col("final").alias("current"))
    found = found.where("next IS NULL").select("name", "at", F.col("name").alias("current")).unionByName(moved)
    if registry is not None:
        found = checkpointed(found)
        known = registry.select(F.col("name").alias("current")).distinct()
        unknown = found.select("current").distinct().join(known, "current", "left_anti").agg(F.count("*").alias("_unknown"), F.min("current").alias("_which"))  # one row
        error = F.raise_error(F.concat(F.lit("no such name: "), F.coalesce("_which", F.lit("null"))))
        found = found.crossJoin(F.broadcast(unknown)).select("name", "at", F.when(F.col("_unknown") == 0, F.col("current")).otherwise(error).alias("current"))
    found = found.select(F.struct("name", "at").alias("_key"), "current")
    return recorded.withColumn("_key", F.struct(F.col(name).alias("name"), F.col(at).alias("at"))).repartition(parts, "_key").join(found.repartition(parts, "_key"), "_key").drop("_key")


def kind(old: Column, new: Column) -> Column:
    """One of KINDS, from two arrays without repeats."""
    lost, won = F.size(F.array_except(old, new)) > 0, F.size(F.array_except(new, old)) > 0
    none = F.when(F.size(old) == 0, "still none").otherwise("unchanged")
    return F.when(~lost & ~won, none).when(F.size(new) == 0, "loses all").when(F.size(old) == 0, "gains").when(~lost, "widened").when(~won, "narrowed").otherwise("changed")


def moves(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """old and new (key, themes array) -> key, old, new, kind; a writing that one side lacks has no themes there."""
    none = F.array().cast("array<string>")
    sides = old.select(key, F.array_sort(F.array_distinct("themes")).alias("old")).join(new.select(key, F.array_sort(F.array_distinct("themes")).alias("new")), key, "full")
    sides = sides.select(key, F.coalesce("old", none).alias("old"), F.coalesce("new", none).alias("new"))
    return sides.withColumn("kind", kind(F.col("old"), F.col("new")))


def by_source(moved: DataFrame, by: str = "source") -> DataFrame:
    """Counts of each kind by source, with a row of all (null)."""
    return moved.rollup(by).agg(*[F.count_if(F.col("kind") == k).alias(k.replace(" ", "_")) for k in KINDS], F.count("*").alias("all"))


def flow(moved: DataFrame) -> DataFrame:
    """old, new, n: where the writings of each old theme are now; null where they have no theme."""
    into = F.when(F.size("new") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.col("new"))
    return moved.select(F.explode("old").alias("old"), into.alias("new")).select("old", F.explode("new").alias("new")).groupBy("old", "new").agg(F.count("*").alias("n"))


def payload_digest(rows: DataFrame, key: str, columns: list[str], digits: int = 3) -> DataFrame:
    """One row (n, digest): a SHA-256 of all rows that does not depend on how they are dealt out.

    Rows are told apart as JSON and meet by the first hexadecimal digits of their key's digest; a bucket's
    digest is that of its rows' digests in order, and the whole is that of the buckets' digests in order.
    Take so many digits that a bucket of 64 bytes a row fits a task.
    """
    told = rows.select(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, digits).alias("bucket"), F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("row"))
    buckets = told.groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("row")), ""), 256).alias("digest"))
    order = F.array_sort(F.collect_list(F.struct("bucket", "digest")))
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.sha2(F.array_join(F.transform(order, lambda b: b["digest"]), ""), 256).alias("digest"))
