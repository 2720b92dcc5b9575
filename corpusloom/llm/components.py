"""Connected components by alternating star contraction, each round cut by a written table.

Every round shuffles the edges twice and halves the depth of the trees; a hub with a large share of all
edges is joined through `join_groups`. Nothing but two numbers a round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_groups


def _star(pairs: DataFrame, total: int) -> DataFrame:
    """(u, v) -> (u, v, m): m the least of u and its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    return join_groups(pairs, least, ["u"], "n", total)


def components(space: Workspace, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a, b) -> (node, root) for every node but the roots; root is the least node of its component."""
    tree = space.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        total = tree.count()
        both = tree.unionByName(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = space.table(_star(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        small = _star(large, total)
        # a parent that is not the least links to the least; so does the node itself
        links = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        new = space.table(links.where("u <> v").distinct())
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        space.drop(tree, large)
        tree = new
        if tuple(state) == seen:
            return tree.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(state)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
