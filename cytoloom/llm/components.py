"""Connected components of an edge table by alternating stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b): component is the smallest node reachable.

    Large-star and small-star steps (each a minimum per node that combines before the shuffle, and a join) turn
    every component into a star; the number of rounds grows with the logarithm of its size. Loops and repeated
    edges do no harm. The result reads a table that ``forget`` deletes. Raises if ``rounds`` steps do not settle.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        before, now = now, written(small, "edges")
        forget(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == sign:
            stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            out = stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
            out._scratch = now._scratch
            return out
        sign = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")
