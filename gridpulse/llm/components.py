"""Connected components of a large graph, by alternating star steps.

Every node that has larger neighbours hooks them to the smallest node of its neighbourhood (large
star), then smaller ones likewise (small star), until the edges are stars whose centre is the smallest
node. The number of rounds grows with the logarithm of the graph. Each round is a few joins and
aggregations, written to the shared folder; the driver only learns whether edges changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """(a > b) edges -> every larger neighbour of a node hooked to the least of its neighbourhood."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """(a > b) edges -> a node and its smaller neighbours hooked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hooked = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hooked.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (a, b), in any direction and repeated at will -> (node, component), the component being
    its smallest node; nodes without edges to others are left out."""
    start = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    now = scratch.table(start)
    before = _state(now)
    while before[0]:
        large = scratch.table(_large_star(now))
        small = scratch.table(_small_star(large))
        after = _state(small)
        scratch.drop([now, large])
        now = small
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
