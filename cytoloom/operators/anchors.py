"""Anchors between reference and query: mutual neighbours, their filter and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settled
from .knn import knn


def mutual(neighbours: DataFrame, k: int) -> DataFrame:
    """(cellr, cellq): each among the other's first ``k`` between the sets; lists shorter than k count whole."""
    rq = neighbours.where((F.col("kind") == "rq") & (F.col("rank") <= k)).select(F.col("src").alias("cellr"), F.col("dst").alias("cellq"))
    qr = neighbours.where((F.col("kind") == "qr") & (F.col("rank") <= k)).select(F.col("dst").alias("cellr"), F.col("src").alias("cellq"))
    return rq.join(qr, ["cellr", "cellq"])


def filtered(anchors: DataFrame, ref: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """Anchors whose cells are among each other's first ``k`` correlation neighbours, in either direction, on the panel."""
    near = knn(ref, query, k).select(F.col("src").alias("cellr"), F.col("dst").alias("cellq"))
    near = near.unionByName(knn(query, ref, k).select(F.col("dst").alias("cellr"), F.col("src").alias("cellq")))
    return anchors.join(near, ["cellr", "cellq"], "left_semi")


def shared_counts(neighbours: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(cellr, cellq, shared): neighbours that both cells of an anchor have, over both sets; anchors with none go.

    A cell's neighbours are the first ``k`` of its own set (itself among them) and the first ``k`` of the other.
    """
    of = neighbours.where(F.col("rank") <= k)
    key = lambda kind: F.col("dst") * 2 + (1 if kind[1] == "q" else 0)  # one number per cell of either set: arrays of longs intersect by hashing
    lists = {}
    for side in ("r", "q"):
        parts = [of.where(F.col("kind") == side + other).select("src", key(side + other).alias("n")) for other in ("r", "q")]
        lists[side] = parts[0].unionByName(parts[1]).groupBy("src").agg(F.collect_set("n").alias("n"))
    rows = anchors.join(lists["r"].select(F.col("src").alias("cellr"), F.col("n").alias("nr")), "cellr").join(lists["q"].select(F.col("src").alias("cellq"), F.col("n").alias("nq")), "cellq")
    return rows.select("cellr", "cellq", F.size(F.array_intersect("nr", "nq")).cast("long").alias("shared")).where("shared > 0")


def rescaled(scores: DataFrame, column: str = "shared") -> DataFrame:
    """``score``: the count between its 0.01 and 0.9 quantiles (linear), clipped to 0..1; 1 for all if both are equal.

    Shared neighbours are whole numbers of at most twice the neighbour count, so ``percentile`` keeps no more different
    values than that, for any number of anchors.
    """
    q = scores.agg(F.percentile(column, F.array(F.lit(0.01), F.lit(0.9))).alias("q"))
    lo, hi = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    rows = scores.crossJoin(F.broadcast(q))  # one row
    score = F.when(hi == lo, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col(column) - lo, hi - lo))))
    return rows.withColumn("score", score).drop("q")


def scored(neighbours: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(cellr, cellq, score). The counts are kept: their quantiles and their scaling both read them."""
    return rescaled(settled(shared_counts(neighbours, anchors, k))).select("cellr", "cellq", "score")
