"""Placing writings on themes by similarity, as one plan with a single shuffle by writing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as vx

MOST_THEMES = 10_000


@dataclass(frozen=True)
class Rules:
    """Frozen thresholds: tau by length class, correction by seed count, delta, cap."""

    tau: dict[str, float]
    g: dict[int, float] = field(default_factory=dict)
    delta: float = 0.1
    cap: int = 3
    one_sided: bool = True
    k_ref: int = 5

    def nearest(self, k: int) -> float:
        return self.g[min(self.g, key=lambda x: abs(x - k))] if self.g else 0.0

    def correction(self, k: int) -> float:
        c = self.nearest(k) - self.nearest(self.k_ref)
        return max(c, 0.0) if self.one_sided else c

    def threshold(self, k: int, kind: str) -> float:
        return self.tau[kind] + self.correction(k)

    def threshold_column(self, k: Column, kind: Column, most: int = 64) -> Column:
        """tau[kind] + correction(k) as a column; seed counts above `most` take the nearest of g as well."""
        steps = sorted({(self.correction(x), x) for x in range(1, most + 1)}, key=lambda s: s[1])
        corr = F.lit(self.correction(most))
        for c, x in reversed(steps):
            corr = F.when(k == x, F.lit(c)).otherwise(corr)
        tau = F.lit(None).cast("double")
        for name, t in self.tau.items():
            tau = F.when(kind == name, F.lit(t)).otherwise(tau)
        return tau + corr


def theme_vectors(vectors: DataFrame, seeds: DataFrame, key: str = "vec_id") -> DataFrame:
    """seeds(theme, key) -> theme, k, vec: the unit mean of the seeds' vectors. A seed without a vector is an error."""
    found = seeds.join(vectors, key, "left").withColumn("vec", F.when(F.col("vec").isNull(), F.raise_error(F.lit("a seed has no vector"))).otherwise(F.col("vec")))
    means = vx.mean_by(found, ["theme"], "vec", "vec")
    return means.join(seeds.groupBy("theme").agg(F.count("*").alias("k")), "theme").select("theme", "k", vx.unit(F.col("vec")).alias("vec"))


def centred(vectors: DataFrame, mean: DataFrame) -> DataFrame:
    """vec -> unit(vec - mean); mean is one row."""
    return vectors.crossJoin(F.broadcast(mean)).withColumn("vec", vx.unit(vx.minus(F.col("vec"), F.col("mean")))).drop("mean")


def _few(themes: DataFrame) -> DataFrame:
    """Themes are a curated list; more than MOST_THEMES of them are refused."""
    if themes.limit(MOST_THEMES + 1).count() > MOST_THEMES:
        raise ValueError(f"more than {MOST_THEMES} themes")
    return themes


def similarities(vectors: DataFrame, themes: DataFrame, key: str = "vec_id") -> DataFrame:
    """Every writing with every theme."""
    t = _few(themes).select("theme", "k", F.col("vec").alias("theme_vec"))
    return vectors.join(F.broadcast(t)).withColumn("sim", vx.dot(F.col("vec"), F.col("theme_vec"))).drop("vec", "theme_vec")


def similarity_lists(vectors: DataFrame, themes: DataFrame, key: str = "vec_id") -> DataFrame:
    """key, sims: of every writing, an array of (theme, sim) with all themes, told within its row."""
    t = _few(themes).agg(F.collect_list(F.struct("theme", "vec")).alias("themes"))
    sims = F.transform("themes", lambda x: F.struct(x["theme"].alias("theme"), vx.dot(F.col("vec"), x["vec"]).alias("sim")))
    return vectors.join(F.broadcast(t)).select(key, sims.alias("sims"))


def place(sims: DataFrame, rules: Rules, key: str = "vec_id", kind: str = "kind") -> DataFrame:
    """sims(key, kind, theme, k, sim, seed) -> the chosen (key, theme, position, sim, best, role).

    Seeds stay, uncapped. Without a seed the first theme over its threshold is taken, even beyond
    delta of the best; further ones need both. Ties go to the lower theme.
    """
    own = Window.partitionBy(key)
    order = own.orderBy(F.desc("sim"), "theme")
    rows = sims.withColumn("thr", rules.threshold_column(F.col("k"), F.col(kind))).withColumn("rank", F.row_number().over(order))
    rows = rows.withColumn("ok", F.col("sim") >= F.col("thr")).withColumn("best", F.max("sim").over(own)).withColumn("n_seeds", F.count_if("seed").over(own))
    rows = rows.withColumn("first", F.min(F.when(F.col("ok"), F.col("rank"))).over(own))
    near = F.col("ok") & (F.col("best") - F.col("sim") <= rules.delta)
    primary = (F.col("n_seeds") == 0) & (F.col("rank") == F.col("first"))
    chosen = rows.where(F.col("seed") | primary | near)
    turn = own.orderBy(F.desc("seed"), "rank")
    chosen = chosen.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= F.greatest(F.lit(rules.cap), F.col("n_seeds")))
    shown = own.orderBy(F.desc("sim"), "rank")
    return chosen.select(key, "theme", F.row_number().over(shown).alias("position"), "sim", "best", F.when(F.col("n_seeds") > 0, "seed").otherwise("placed").alias("role"))


def roles(placed: DataFrame, writings: DataFrame, subjectless: DataFrame | None = None, key: str = "vec_id") -> DataFrame:
    """key, role of every writing: seed, placed, none, or subjectless, which empties all but seeds."""
    role = placed.select(key, "role").distinct()
    out = writings.select(key).join(role, key, "left").withColumn("role", F.coalesce("role", F.lit("none")))
    if subjectless is not None:
        marked = subjectless.select(key).distinct().withColumn("_none", F.lit(True))
        out = out.join(marked, key, "left").withColumn("role", F.when(F.col("_none") & (F.col("role") != "seed"), "subjectless").otherwise(F.col("role"))).drop("_none")
    return out
