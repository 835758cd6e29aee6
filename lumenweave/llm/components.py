"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum (partial sums before the shuffle) and a join, so a node
with very many links is split like any skewed join; nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.llm.common import settle


def _large_star(links: DataFrame) -> DataFrame:
    """links: v < u. Each larger neighbour of a node is linked with the least of the node's neighbourhood."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("v < u").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, is linked with the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("v < u").distinct()


def roots(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, root for every node with a link, root the least node reachable."""
    now = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        now = settle(_small_star(_large_star(now)))
        mark = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if mark == before or not mark[0]:
            break
        before = mark
    tops = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(tops.withColumn("root", F.col("node")))
