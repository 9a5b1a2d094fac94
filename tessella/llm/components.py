"""Connected components of a graph that no single machine needs to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import scratch


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for every node that has an edge; edges: a, b of one type.

    Alternates large-star and small-star steps: each node hands its larger, then its smaller neighbours to its smallest
    one. Every step is an aggregate by node and a join, rounds are written to the shared folder, and a hub is only ever
    a skewed join key. Nulls and loops are ignored.
    """
    now = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b"))).distinct()
        mark = seen
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = scratch.table(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    raise RuntimeError(f"no fixed point within {rounds} rounds")
