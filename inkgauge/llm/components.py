"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm import common


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node sends its larger neighbours to the smallest of its neighbourhood. Minima are reduced before the shuffle; a hub's one is sent to its edges."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("copies"))
    met = common.join_hot(both.where("b > a"), least, "a", "copies", 2 * n)
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node sends its smaller neighbours and itself to the smallest of them. Here a is the larger end of every edge."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("copies"))
    met = common.join_hot(edges, least, "a", "copies", n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return met.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root for every node of the undirected edges (a, b): root is the smallest node that can be reached.

    Each round is written to the shared folder; the rounds end when the edges no longer change. Self edges are allowed and
    make a node of its own. No edge or label comes to the driver.
    """
    kind = edges.schema["a"].dataType
    now = common.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    sign = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h"))
    mark = now.agg(sign.alias("s")).first().s
    while mark.n:
        large = common.table(_large_star(now, mark.n), name)
        fresh = common.table(_small_star(large, large.count()), name)
        common.drop(large)
        common.drop(now)
        was, now = mark, fresh
        mark = now.agg(sign.alias("s")).first().s
        if mark == was:
            break
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
    alone = edges.where("a = b").select(F.col("a").alias("node")).distinct().join(found, "node", "left_anti").select("node", F.col("node").cast(kind).alias("root"))
    return found.unionByName(alone)
