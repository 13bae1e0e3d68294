"""Canonical correlation of two sets over a shared panel, by Gram matrices.

The cells-by-cells cross-product is never formed: with standardised rows Zr and Zq its singular vectors are
Zr M and Zq N with M, N of panel size, found from the two panel-by-panel Gram matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import matrix


def standardize_rows(x: np.ndarray) -> np.ndarray:
    """Mean 0 and sample deviation 1 of every row; NaN where a row has no variance."""
    if not x.size:
        return x
    centred = x - x.mean(axis=1, keepdims=True)
    sd = x.std(axis=1, ddof=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(sd > 1e-12 * np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300), centred / sd, np.nan)


def standardized(cells: DataFrame) -> DataFrame:
    """(ord, v) with standardised rows; a row without variance becomes all NaN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = matrix(b.column(1))
            if len(z):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(standardize_rows(z).tolist(), pa.list_(pa.float64()))], ["ord", "v"])

    return cells.select("ord", "v").mapInArrow(run, "ord long, v array<double>")


def gram(cells: DataFrame, standardize: bool = True) -> np.ndarray:
    """Z^T Z over all cells: partial sums per task, panel-sized results on the driver. Rows without variance are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                z = matrix(b.column(0))
                z = standardize_rows(z) if standardize else z
                z = z[~np.isnan(z).any(axis=1)]
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "g"])

    rows = cells.select("v").mapInArrow(run, "i int, g array<double>")
    sums = rows.select("i", F.posexplode("g").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    p = int(sums["i"].max()) + 1 if len(sums) else 0
    out = np.zeros((p, p))
    out[sums["i"], sums["j"]] = sums["x"]
    return out


def projected(cells: DataFrame, weights: np.ndarray, standardize: bool = True) -> DataFrame:
    """(ord, v) with every standardised row times ``weights``."""
    sent = cells.sparkSession.sparkContext.broadcast(weights)  # panel by components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = matrix(b.column(1))
            if len(z):
                z = (standardize_rows(z) if standardize else z) @ sent.value
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z.tolist(), pa.list_(pa.float64()))], ["ord", "v"])

    return cells.select("ord", "v").mapInArrow(run, "ord long, v array<double>")


def cca(ref: DataFrame, query: DataFrame, components: int, standardize: bool = True) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Embeddings (ord, v) of both sets and the singular values, largest first; the values are not applied.

    Each component's sign makes the first reference cell non-negative. Fewer components come back where the
    cross-product has a lower rank. Raises if a cell has no variance (drop such cells first).
    """
    gr, gq = gram(ref, standardize), gram(query, standardize)
    if not gr.size or not gq.size:
        raise ValueError("both sets need cells with variance")
    lam, e = np.linalg.eigh(gr)
    good = lam > lam.max() * 1e-10
    lam, e = lam[good], e[:, good]
    s2, w = np.linalg.eigh((np.sqrt(lam)[:, None] * (e.T @ gq @ e)) * np.sqrt(lam)[None])
    order = np.argsort(-s2)[:components]
    order = order[s2[order] > s2.max() * 1e-12]
    s, w = np.sqrt(s2[order]), w[:, order]
    left = e @ (w / np.sqrt(lam)[:, None])
    right = e @ (w * np.sqrt(lam)[:, None]) / s
    first = np.array([ref.orderBy("ord").select("v").first()[0]], float)
    sign = np.where(((standardize_rows(first) if standardize else first) @ left)[0] < 0, -1.0, 1.0)
    return projected(ref, left * sign, standardize), projected(query, right * sign, standardize), s


def pca(cells: DataFrame, components: int = 2) -> DataFrame:
    """(ord, v): principal components, each signed so that its largest loading is positive."""
    n = F.count("*")
    p = cells.select(F.max(F.size("v"))).first()[0] or 0
    mean = np.array(cells.agg(*(F.avg(F.get("v", F.lit(j))) for j in range(p)), n).first()[:p], float)
    sent = mean

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1))
            if len(x):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array((x - sent).tolist(), pa.list_(pa.float64()))], ["ord", "v"])

    centred = cells.select("ord", "v").mapInArrow(centre, "ord long, v array<double>")
    _, e = np.linalg.eigh(gram(centred, standardize=False))
    e = e[:, ::-1][:, :components]
    e = e * np.sign(e[np.abs(e).argmax(axis=0), np.arange(e.shape[1])])
    return projected(centred, e, standardize=False)
