"""Connected components by alternating large-star and small-star steps, each an aggregate and joins over the edges.

After Kiveris, Lattanzi, Mirrokni, Rastogi and Vassilvitskii, "Connected components in MapReduce and beyond", 2014.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstmill.shared import discard, materialize

MAX_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of each node and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    joined = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node of its component.

    Each round is written to the shared folder; it ends when a round changes no edge.
    """
    edges = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v"), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        after = materialize(_small_star(_large_star(edges)), "stars")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = after
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
