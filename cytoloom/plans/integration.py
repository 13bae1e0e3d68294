"""The pipelines: mapping a query set to a reference, transferring labels, clustering both."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import anchors as A
from ..operators import clean, cluster, correct, gates, transfer
from ..operators.cca import cca
from ..operators.embed import neighbour_embedding
from ..operators.knn import Vectors, four_way
from ..params import Params
from ..sources.scratch import discard, kept, settled


@dataclass
class Mapping:
    """What the mapping finds on its way."""

    neighbours: DataFrame
    anchors: DataFrame
    weights: DataFrame
    corrected: DataFrame


def map_query(query: DataFrame, ref: DataFrame, latent: DataFrame | None = None, panel_size: int | None = None, p: Params = Params(), zero: str = "nan") -> Mapping:
    """Calibrate query rows (ord, v) to the reference over a shared panel; ``latent`` defaults to the reference's own vectors."""
    size = panel_size or query.select(F.max(F.size("v"))).first()[0]
    ref_emb, query_emb, _ = cca(ref, query, size - 1)
    neighbours = four_way(ref_emb, query_emb, latent if latent is not None else ref, p.k_find_nn)
    neighbours = kept(neighbours, "neighbours")
    pairs = A.filtered(A.mutual(neighbours, p.k_find_anchor), ref, query, p.k_filter_anchor)
    found = kept(correct.numbered(A.scored(neighbours, pairs, p.k_score_anchor)), "anchors")
    weights = correct.anchor_weights(found, query, p.k_find_weights, p.sd_weight, p.delta, zero)
    return Mapping(neighbours, found, weights, correct.corrected(query, weights, correct.anchor_differences(found, ref, query)))


def mapped_rows(query: DataFrame, ref: DataFrame, latent: DataFrame | None, panel_size: int | None, p: Params) -> DataFrame:
    """The corrected query without NaN, computed once; what it was made of is deleted."""
    found = map_query(query, ref, latent, panel_size, p)
    out = kept(gates.drop_nan(found.corrected), "mapped")
    discard(found.neighbours, found.anchors)
    return out


def integrate(query: DataFrame, ref: DataFrame, labels: DataFrame, latent: DataFrame | None = None, p: Params = Params(), k: int | None = None) -> DataFrame:
    """(src, label, mean_dist, keep): labels of the reference on every query cell, 'Not Assigned' far from it."""
    return transfer.labelled(mapped_rows(query, ref, latent, None, p), ref, labels, k, p.c, p.mask_threshold)


def embedded(cells: DataFrame, k: int, p: Params = Params()) -> DataFrame:
    """Cells in a neighbour embedding of as many components as they have features, computed once."""
    width = cells.select(F.max(F.size("v"))).first()[0] or 1
    return settled(neighbour_embedding(cells, width, k, 0.1, negatives=p.embed_negatives))


def scan(cells: DataFrame, p: Params = Params(), min_sizes: Sequence[int] = range(5, 21, 4), min_samples: Sequence[int] = range(10, 41, 3)) -> tuple[DataFrame, DataFrame]:
    """Labels and scores of density clustering over the grid, in an embedding of 50 neighbours."""
    return cluster.parameter_scan(cells, min_sizes, min_samples, space=embedded(cells, 50, p))


def cluster_cells(cells: DataFrame, option: int = 1, k: int = 30, markers: list[gates.Gate] | None = None, p: Params = Params(), **grid) -> DataFrame:
    """(ord, cluster): 1 neighbour graph, 2 scan and consensus, 3 graph refined by density, 4 marker gates, 5 density on all markers.

    Option 2 warns and gives every cell -1 where no run of the scan reaches the cutoff.
    """
    if option == 1:
        return cluster.graph_clusters(cells, k)
    if option == 2:
        labels, scores = scan(cells, p, **grid)
        return cluster.consensus(labels, scores, p.query_silhouette_cutoff, inconsistent=p.inconsistent_value, min_size=p.query_min_cluster_size, none="noise")
    if option == 3:
        return cluster.refined_clusters(cells, cluster.graph_clusters(cells, k))
    if option == 4:
        return gates.marker_gate(cells, markers or [])
    if option == 5:
        return cluster.density_grid(embedded(cells, 15, p), [3], [20], "euclidean").select("ord", F.col("label").alias("cluster"))
    raise ValueError(f"no option {option}")


def cluster_reference(cells: DataFrame, option: int = 1, p: Params = Params(), **grid) -> DataFrame:
    """(ord, cluster): 1 scan and consensus, 2 the best run of the scan, 3 one density clustering."""
    if option in (1, 2):
        labels, scores = scan(cells, p, **grid)
        if option == 2:
            return cluster.best_run(labels, scores)
        return cluster.consensus(labels, scores, p.silhouette_cutoff, p.silhouette_percentile, p.inconsistent_value, p.min_cluster_size)
    if option == 3:
        return cluster.density_grid(embedded(cells, 15, p), [p.density_min_cluster_size], [p.density_min_samples]).select("ord", F.col("label").alias("cluster"))
    raise ValueError(f"no option {option}")


@dataclass
class Result:
    """The full pipeline's tables; ``kept`` is the corrected query without the masked cells, ``tables`` all others so.

    The weights are made anew where they are read.
    """

    corrected: DataFrame
    kept: DataFrame
    tables: dict[str, DataFrame]
    weights: DataFrame
    mask: DataFrame
    query_clusters: DataFrame
    reference: DataFrame
    p: Params

    @cached_property
    def reference_clusters(self) -> DataFrame:
        """Scan and consensus of the reference, with the pipeline's own cutoff and size; raises if no run reaches the cutoff."""
        return cluster_reference(self.reference, 1, replace(self.p, silhouette_cutoff=self.p.pipeline_silhouette_cutoff, min_cluster_size=self.p.pipeline_min_cluster_size))


def pipeline(query: DataFrame, query_panel: list[str], ref: DataFrame, ref_panel: list[str], latent: DataFrame | None = None, amount_query: int = -1, amount_ref: int = -1, prepared: bool = False, p: Params = Params(), option: int = 1, markers: list[gates.Gate] | None = None, k: int | None = None) -> Result:
    """Subset, gate, clean, map, transfer weights, discard far cells, cluster the corrected query and the reference.

    ``query`` has (ord, v, blanks, size, ...). With ``prepared`` the values are taken as they are, as for
    already normalised sets; gates then still apply where blanks and size are there. ``option`` and ``markers`` (places in
    the shared panel) say how the query is clustered, ``k`` how many neighbours give labels (by default a share).
    """
    query, ref = gates.take_subset(query, amount_query), gates.take_subset(ref, amount_ref)
    every = query
    if {"blanks", "size"} <= set(query.columns):
        query = gates.blank_size_gate(query, p.size_limits, p.blank_lower, p.blank_upper)
    if not prepared:
        query = clean.clean_query(query.select("ord", "v"))
        ref, _ = clean.clean_reference(ref.select("ord", "v"))
        if latent is not None:  # rows without counts went on all reference tables
            latent = latent.join(ref.select("ord"), "ord", "left_semi")
    panel = gates.common_panel(query_panel, ref_panel)
    q = settled(gates.select_panel(query, query_panel, panel).select("ord", "v"))
    r = settled(gates.select_panel(ref, ref_panel, panel).select("ord", "v"))
    mapped, data = mapped_rows(q, r, latent, len(panel), p), Vectors(r)
    w = transfer.transfer_weights(mapped, data, k, p.c)  # a row per neighbour: only made where it is read
    mask = settled(transfer.query_mask(transfer.mean_distances(mapped, data, k), p.mask_threshold))
    inside = settled(transfer.discard(mapped, mask))
    tables = transfer.discard_everywhere({"query": every, "cleaned": query.select("ord", "v"), "panel": q}, mask) | transfer.discard_everywhere({"weights": w}, mask, "src")
    return Result(mapped, inside, tables, w, mask, cluster_cells(inside, option, p.k_cluster, markers, p), latent if latent is not None else r, p)
