"""Group means, names and evaluation of labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .transfer import UNASSIGNED


def cluster_means(cells: DataFrame, clusters: DataFrame, upper: float | None = None) -> DataFrame:
    """(cluster, feature, mean), values above ``upper`` counted as it."""
    rows = cells.join(clusters, "ord").select("cluster", F.posexplode("v").alias("feature", "x"))
    x = F.least(F.col("x"), F.lit(upper)) if upper is not None else F.col("x")
    return rows.groupBy("cluster", "feature").agg(F.avg(x).alias("mean"))


#: The genes that the reference set's heatmap shows unless others are asked for.
DEFAULT_GENES = (
    "Cxcl16", "Cacnb3", "Cox6a2", "Bst2", "Siglech", "Hmox1", "C1qa", "Vcam1", "Hba-a1", "Hbb-bs", "Hba-a2", "Ngp", "S100a9",
    "S100a8", "Klf1", "Car2", "Car1", "Ppt1", "Ppp1r14a", "Ffar2", "Mmp12", "Jchain", "Ifi30", "Vpreb3", "Wfdc17", "Ccl9",
    "Ccl6", "Ncr1", "Ccl5", "Gzma", "Cd22", "Ighd", "1810046K07Rik", "Zbtb32", "Bhlhe41", "Cd3d", "Cd3e", "Trbc2",
)


def gene_means(cells: DataFrame, panel: list[str], clusters: DataFrame, genes: Sequence[str] = DEFAULT_GENES, upper: float | None = 10) -> DataFrame:
    """(cluster, gene, mean) of the panel's features that are among ``genes``, values above ``upper`` counted as it."""
    at = [i for i, g in enumerate(panel) if g in set(genes)]
    if not at:
        raise ValueError("the panel has none of the genes")
    names = F.array(*(F.lit(panel[i]) for i in at))
    slim = cells.select("ord", F.array(*(F.get("v", F.lit(i)) for i in at)).alias("v"))
    return cluster_means(slim, clusters, upper).select("cluster", F.get(names, F.col("feature")).alias("gene"), "mean")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster").agg(F.count("*").alias("n"))


def named(clusters: DataFrame, names: DataFrame) -> DataFrame:
    """Add name: '' for clusters without one and for -1. ``names`` has a row per cluster."""
    rows = clusters.join(names, "cluster", "left")
    return rows.withColumn("name", F.when(F.col("cluster") == -1, "").otherwise(F.coalesce("name", F.lit(""))))


def heatmap(means: DataFrame, features: list[int]) -> DataFrame:
    """The means as one row per cluster with a column per feature."""
    return means.groupBy("cluster").pivot("feature", features).agg(F.first("mean"))


def score_histogram(scores: DataFrame, bins: int = 100) -> DataFrame:
    """(bin, n): counts in equal bins between the least and largest score."""
    lo_hi = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    rows = scores.crossJoin(F.broadcast(lo_hi))  # one row
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col("score") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins), F.lit(bins - 1))
    return rows.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def rates(rows: DataFrame) -> DataFrame:
    """(type, tpr, tnr) per true type of rows (truth, label), from one count per pair of both."""
    pairs = rows.groupBy("truth", "label").agg(F.count("*").alias("n"))
    of_truth = pairs.groupBy("truth").agg(F.sum("n").alias("pos"), F.sum(F.when(F.col("truth") == F.col("label"), F.col("n")).otherwise(0)).alias("tp"))
    of_label = pairs.groupBy(F.col("label").alias("truth")).agg(F.sum("n").alias("called"))
    total = pairs.agg(F.sum("n").alias("total"))
    out = of_truth.join(of_label, "truth", "left").crossJoin(F.broadcast(total))  # one row
    wrong = F.coalesce("called", F.lit(0)) - F.col("tp")
    neg = F.col("total") - F.col("pos")
    return out.select(F.col("truth").alias("type"), (F.col("tp") / F.col("pos")).alias("tpr"), F.try_divide(neg - wrong, neg).alias("tnr"))


def majority(rows: DataFrame, by: str, label: str) -> DataFrame:
    """(by, label, n, size, share): the most frequent label of each group (ties: the smaller label)."""
    counts = rows.groupBy(by, label).agg(F.count("*").alias("n"))
    best = counts.groupBy(by).agg(F.min_by(F.struct(F.col(label).alias("label"), "n"), F.struct((-F.col("n")).alias("k"), F.col(label).alias("l"))).alias("b"), F.sum("n").alias("size"))
    return best.select(by, F.col("b.label").alias("label"), F.col("b.n").alias("n"), "size", (100 * F.col("b.n") / F.col("size")).alias("share"))


def agreement(rows: DataFrame) -> DataFrame:
    """Add agree: label equals truth; unassigned cells never do."""
    return rows.withColumn("agree", (F.col("truth") == F.col("label")) & (F.col("label") != UNASSIGNED))
