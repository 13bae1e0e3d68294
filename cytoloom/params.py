"""Default parameters of the integration pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Neighbour counts, kernel widths and thresholds. The values are fixed: results depend on them."""

    k_find_nn: int = 80
    k_find_anchor: int = 20
    k_filter_anchor: int = 100
    k_score_anchor: int = 80
    k_find_weights: int = 100
    sd_weight: float = 1.0
    delta: float = 1e-5
    c: float = 0.1
    mask_threshold: float = 0.5
    border: float = 564000
    size_limits: tuple[float, float] | None = (1000, 25000)
    blank_lower: tuple[float, ...] | None = (-1200, -1200, -1200, -1200)
    blank_upper: tuple[float, ...] | None = (6000, 2500, 5000, 2500)
    k_cluster: int = 30
    silhouette_cutoff: float | None = None
    silhouette_percentile: float = 95
    inconsistent_value: float = 0.1
    min_cluster_size: int = 8
    pipeline_silhouette_cutoff: float | None = 0.114
    pipeline_min_cluster_size: int = 10
    query_silhouette_cutoff: float | None = 0.0
    query_min_cluster_size: int = 1
    density_min_cluster_size: int = 2
    density_min_samples: int = 14
    embed_negatives: int = 50
