"""Mixing sources to target token weights by entropy balancing.

Each document d of n_d words gets a rate r_d, the copies that the mix expects of it. The rates stay as
close as possible to one each in relative entropy, sum r log r - r, subject to sum n r = target for
each source and r <= 2. The convex dual has one unknown per source, and its solution tilts
exponentially: r = min(2, exp(lambda_s * n / mean_s)). Newton steps on the dual, kept inside a
bracket, need two sums per source over all documents; Spark adds them up over the table of (source,
size, documents), which holds the same sums exactly. Rates are then rounded into whole copies from the
largest size to the smallest, carrying the rounding error of a size into the next one.

Scale: texts are read once, for their sizes. Newton works on the counts by (source, size). What is
held by source on the driver is one row per source and is refused above `max_sources`. Sums are over
integers, so that reruns agree whatever the order of tasks. Documents of one size in one source, even
a third of all rows, are numbered inside salted parts with the parts' offsets added.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, Workspace, free_names, read

WEIGHTS = (3.0, 1.0, 2.0)
CAP = 2
_FINE = 1024  # parts of a word in which rates are summed


def targets(sizes: dict, total_share: float = 1.5, weights=WEIGHTS, cap: float = CAP) -> dict:
    """Source -> target words. Weights go by code point, null last; above cap times a source's size the excess is reshared."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(order)}
    left, open_, out = total_share * sum(sizes.values()), list(order), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / whole > cap * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / whole for s in open_}
            break
        for s in full:
            out[s] = float(cap * sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def _rate(cap: float = CAP):
    return F.least(F.lit(float(cap)), F.exp(F.least(F.lit(700.0), F.col("lambda") * F.col("size") / F.col("mean"))))


def tilts(spark: SparkSession, counts: DataFrame, totals: dict, goal: dict, steps: int = 60, cap: float = CAP) -> dict:
    """Source -> lambda, by Newton steps on the dual, each one distributed sum over counts(source, size, docs)."""
    state = {}
    for s, (size, docs) in totals.items():
        if size and goal[s] < cap * size * (1 - 1e-9):
            state[s] = {"l": 0.0, "lo": -math.inf, "hi": math.inf, "mean": size / docs}
    done = {s: (math.inf if totals[s][0] else 0.0) for s in totals if s not in state}
    kind = counts.schema["source"].dataType.simpleString()
    for _ in range(steps):
        if not state:
            break
        now = spark.createDataFrame([(s, x["l"], x["mean"]) for s, x in state.items()], f"source {kind}, lambda double, mean double")
        r = _rate(cap)
        sums = (
            counts.join(F.broadcast(now), counts["source"].eqNullSafe(now["source"]))
            .select(now["source"], "docs", "size", "mean", r.alias("r"))
            .groupBy("source")
            .agg(
                F.sum(F.round(F.col("docs") * F.col("size") * F.col("r") * _FINE).cast("long")).alias("f"),
                F.sum(F.when(F.col("r") < cap, F.round(F.col("docs") * F.col("size") * F.col("r") * F.col("size") / F.col("mean") * _FINE)).otherwise(0).cast("long")).alias("g"),
            )
            .collect()
        )
        for row in sums:
            x, s = state[row.source], row.source
            got, slope = row.f / _FINE, row.g / _FINE
            if abs(got - goal[s]) <= max(0.5, 1e-9 * goal[s]):
                done[s] = round(x["l"], 9)
                del state[s]
                continue
            x["lo" if got < goal[s] else "hi"] = x["l"]
            # Newton on the logarithm of the sum, which is nearly straight in lambda.
            step = x["l"] + (math.log(goal[s] / got) * got / slope if slope > 0 and got > 0 and goal[s] > 0 else math.copysign(math.inf, goal[s] - got))
            if not (x["lo"] < step < x["hi"]) or not math.isfinite(step):
                lo, hi = x["lo"], x["hi"]
                step = (lo + hi) / 2 if math.isfinite(lo + hi) else (hi - 2 * max(1.0, abs(hi)) if math.isfinite(hi) else lo + 2 * max(1.0, abs(lo)))
            x["l"] = step
            if x["hi"] - x["lo"] < 1e-12 * max(1.0, abs(step)):
                done[s] = round(step, 9)
                del state[s]
    return done | {s: round(x["l"], 9) for s, x in state.items()}


def round_source(cap: int = CAP):
    """applyInPandas function: the sizes of one source, with rates -> copies for all documents of each size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False).reset_index(drop=True)
        size, docs, rate = pdf["size"].to_numpy(np.int64), pdf["docs"].to_numpy(np.int64), pdf["rate"].to_numpy(float)
        copies, error = np.zeros(len(pdf), np.int64), 0.0
        for k in range(len(pdf)):
            if size[k]:
                want = docs[k] * rate[k] + error / size[k]
                copies[k] = min(cap * docs[k], max(0, math.floor(want + 0.5)))
                error = (want - copies[k]) * size[k]
        return pd.DataFrame({"source": pdf["source"], "size": size, "docs": docs, "copies": copies})

    return run


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_share: float = 1.5, weights=WEIGHTS, max_sources: int = 100_000, part_rows: int = 5_000) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, rate, copies, taken.

    size counts words (null: 0); null is a source of its own, last in order. Documents without words
    take nothing; a source without words has target 0. Equal or repeated rows share copies by hash
    and row order within equal hashes, so that reruns agree. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "mixing")
    sized = space.table(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    )
    counts = space.table(sized.groupBy("source", "size").agg(F.count("*").alias("docs")))
    per_source = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("size"), F.sum("docs").alias("docs"))
    rows = per_source.limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    totals = {r["source"]: (r["size"], r["docs"]) for r in rows}
    goal = targets({s: x[0] for s, x in totals.items()}, total_share, weights)
    tilt = tilts(spark, counts, totals, goal)
    n = sum(x[1] for x in totals.values())
    kind = sized.schema["source"].dataType.simpleString()
    plan = spark.createDataFrame([(s, totals[s][0], goal[s], tilt[s], totals[s][0] / totals[s][1] or 1.0) for s in totals], f"source {kind}, source_size long, target double, lambda double, mean double")
    rated = counts.join(F.broadcast(plan), counts["source"].eqNullSafe(plan["source"])).drop(plan["source"]).withColumn("rate", F.when(F.col("target") == 0, 0.0).otherwise(_rate()))
    schema = T.StructType([counts.schema["source"], T.StructField("size", T.LongType()), T.StructField("docs", T.LongType()), T.StructField("copies", T.LongType())])
    # A row per size of a source meets in one task: as many as the longest text has words, at most.
    allotted = rated.select("source", "size", "docs", "rate").groupBy("source").applyInPandas(round_source(), schema)
    # Every document of a size gets copies div docs, and the first copies mod docs by hash one more.
    parts = max(1, -(-n // part_rows))
    order = F.xxhash64(F.col("id"), F.lit(5))
    dealt = sized.withColumn("order", order).withColumn("part", F.pmod(F.xxhash64("order"), F.lit(parts)))
    dealt = dealt.withColumn("null_source", F.col("source").isNull()).withColumn("source_key", F.coalesce(F.col("source").cast("string"), F.lit("")))
    part_sizes = dealt.groupBy("source_key", "null_source", "size", "part").agg(F.count("*").alias("in_part"))
    before = Window.partitionBy("source_key", "null_source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part_sizes.withColumn("before", F.coalesce(F.sum("in_part").over(before), F.lit(0)))
    shares = allotted.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key"), F.col("source").isNull().alias("null_source"), "size", F.floor(F.col("copies") / F.col("docs")).alias("each"), (F.col("copies") % F.col("docs")).alias("extra"))
    offsets = offsets.join(shares, ["source_key", "null_source", "size"])
    place = Window.partitionBy("source_key", "null_source", "size", "part").orderBy("order", "id")
    ranked = dealt.withColumn("rank", F.row_number().over(place)).join(offsets.drop("in_part"), ["source_key", "null_source", "size", "part"])
    out = ranked.withColumn("copies", F.col("each") + F.when(F.col("before") + F.col("rank") <= F.col("extra"), 1).otherwise(0))
    out = out.drop("source").join(F.broadcast(plan.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key"), F.col("source").isNull().alias("null_source"), "source", "source_size", "target", "lambda", "mean")), ["source_key", "null_source"])
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.when(F.col("target") == 0, 0.0).otherwise(_rate()).alias("rate"), F.col("copies").cast("long").alias("copies"), (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows that share id and text share their copies evenly."""
    id_col, text_col = how.get("id_col", "doc_id"), how.get("text_col", "text")
    name, copies, key, copy = free_names(docs, "name", "copies", "key", "copy")
    named = docs.withColumn(name, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row")))
    taken = mix(named, **(how | {"id_col": name})).select(F.col(name), F.col("copies").alias(copies))
    taken = taken.groupBy(name).agg((F.sum(copies) / F.count("*")).cast("int").alias(copies)).where(F.col(copies) > 0)
    # joined by a hash beside the name, as a struct with a null id equals no other
    taken = taken.select(F.xxhash64(name).alias(key), copies).hint("shuffle_hash")
    out = named.withColumn(key, F.xxhash64(name)).join(taken, key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return out.select(*docs.columns)


def op5_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")
