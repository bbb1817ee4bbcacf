"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum with map-side combine and a join back on the
node, so a hub with many links costs one partial row per task and its rows are
split by adaptive skew joins. Each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrun.llm.common import written

#: Rounds grow with the logarithm of the longest chain; this only stops a fault.
MAX_ROUNDS = 60


def _state(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``); the root is the smallest node."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(edges)
    for _ in range(MAX_ROUNDS if before[0] else 0):
        # large star: each larger neighbour of u moves to u's smallest neighbour (u included)
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: u and its smaller neighbours move to the smallest of them
        large = written(large.filter("a <> b").distinct(), "large_star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))))
        edges = written(small.distinct(), "small_star")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
