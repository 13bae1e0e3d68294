"""Canonical correlation of panels too wide for a Gram matrix: restarted Lanczos bidiagonalisation.

The cross-product C = Zr Zq^T of two standardised sets is applied and never formed. A left vector is Zr x and a right one
Zq y, kept as x and y of panel length; C and its transpose then need Gq y and Gr x, and the same two products give the
vectors' inner products. Each product is one pass over a set: partial sums z^T (z x) per task, one number per feature to
the driver. No panel-by-panel matrix and no vector of cells is on the driver.

Coefficients may hold what Z takes to nothing: a constant for centred rows, and more for wide panels. No inner product sees
it, so orthogonalisation would let it grow from rounding, by the ratio of two elements of the bidiagonal matrix a step, until
it swamps the rest. So constants are taken off, and both Gram matrices get a ``RIDGE`` on their diagonals, as if each set had
a very short row more for each feature; the singular values are taken without it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cca import projected, standardize_rows
from .knn import matrix

#: Of the mean eigenvalue of a Gram matrix.
RIDGE = 1e-10


def gram_times(cells: DataFrame, x: np.ndarray, standardize: bool = True) -> np.ndarray:
    """Z^T Z x over all cells in one pass. Rows without variance are left out."""
    sent = cells.sparkSession.sparkContext.broadcast(x)  # a number per feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(x))
        for b in batches:
            if b.num_rows:
                z = matrix(b.column(0))
                z = standardize_rows(z) if standardize else z
                z = z[~np.isnan(z).any(axis=1)]
                total += z.T @ (z @ sent.value)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x)), pa.int32()), pa.array(total)], ["j", "x"])

    sums = cells.select("v").mapInArrow(run, "j int, x double").groupBy("j").agg(F.sum("x").alias("x")).toPandas()
    sent.destroy()
    out = np.zeros(len(x))
    out[sums["j"]] = sums["x"]
    return out


class _Basis:
    """Vectors Z c of one set, by their coefficients and the Gram matrix (with its ridge) times these."""

    def __init__(self, cells: DataFrame, start: np.ndarray, standardize: bool):
        self.cells, self.standardize = cells, standardize
        self.c, self.g = np.zeros((len(start), 0)), np.zeros((len(start), 0))
        self.ridge = RIDGE * float(start @ gram_times(cells, start, standardize)) / float(start @ start)  # a random start sees the mean

    def add(self, c: np.ndarray) -> tuple[float, np.ndarray]:
        """Add the vector with coefficients ``c``, made orthogonal to the others and of length one.

        Gives its length before, and what the others took; a length of 0, and no vector, if nothing is left of it.
        """
        took = np.zeros(self.c.shape[1])
        for _ in range(2):  # the second time takes what rounding left
            part = self.g.T @ c
            c, took = c - self.c @ part, took + part
            c = c - c.mean() if self.standardize else c  # centred rows do not see a constant
        g = gram_times(self.cells, c, self.standardize) + self.ridge * c
        square = float(c @ g)
        whole = float(np.sqrt(max(square, 0.0)))
        if whole > 0:
            self.c, self.g = np.column_stack([self.c, c / whole]), np.column_stack([self.g, g / whole])
        return whole, took

    def rotate(self, by: np.ndarray) -> None:
        self.c, self.g = self.c @ by, self.g @ by


def cca_by_lanczos(ref: DataFrame, query: DataFrame, components: int, standardize: bool = True, extra: int = 10, tolerance: float = 1e-9, rounds: int = 100) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """As :func:`cca.cca`: embeddings (ord, v) of both sets and the singular values, largest first.

    The space holds ``components`` + ``extra`` vectors a side; after that it is restarted from its best singular vectors,
    until each one's residual is below ``tolerance`` times the largest singular value. A step is one pass over either set, so
    both should be cheap to read. Fewer components come back where the cross-product has a lower rank. Raises if there
    are no cells with variance, or if ``rounds`` restarts do not suffice.
    """
    if components < 1:
        raise ValueError("at least one component is needed")
    first = ref.orderBy("ord").select("v").first()
    if first is None or query.first() is None:
        raise ValueError("both sets need cells with variance")
    width = len(first[0])
    start = np.random.default_rng(0).normal(size=width)
    right, left = _Basis(query, start, standardize), _Basis(ref, start, standardize)
    if not right.ridge or not left.ridge:
        raise ValueError("both sets need cells with variance")
    right.add(start)
    size = min(components + extra, width)
    b = np.zeros((0, 1))  # left by right: C right = left b
    for _ in range(rounds):
        rest = 0.0
        while True:
            # C times the newest right vector, less what the left ones hold of it.
            alpha, took = left.add(right.g[:, -1])
            top = float(np.abs(b).max(initial=max(alpha, np.abs(took).max(initial=0.0))))
            grown = alpha > 1e-11 * top
            if not grown and alpha > 0:
                left.c, left.g = left.c[:, :-1], left.g[:, :-1]
            b[:, -1] = took
            if grown:
                b = np.vstack([b, np.append(np.zeros(b.shape[1] - 1), alpha)])
            if not b.size:
                raise ValueError("both sets need cells with variance")
            if not grown:
                rest = 0.0
                break
            # The transpose times the newest left vector, less what the right ones hold.
            beta, _ = right.add(left.g[:, -1])
            if beta <= 1e-11 * max(top, alpha):
                if beta > 0:
                    right.c, right.g = right.c[:, :-1], right.g[:, :-1]
                rest = 0.0
                break
            if len(b) >= size:
                rest = beta
                break
            b = np.column_stack([b, np.zeros(len(b))])
        p, s, q = np.linalg.svd(b, full_matrices=False)
        keep = min(components, len(s))
        if rest * np.abs(p[-1, :keep]).max() <= tolerance * s[0]:
            break
        # Restart from the best vectors, some more than wanted, and the next right one.
        more = min(len(s) - 1, components + extra // 2)
        following = right.c[:, -1:], right.g[:, -1:]
        right.c, right.g = right.c[:, :-1], right.g[:, :-1]
        right.rotate(q[:more].T)
        left.rotate(p[:, :more])
        right.c, right.g = np.column_stack([right.c, following[0]]), np.column_stack([right.g, following[1]])
        b = np.column_stack([np.diag(s[:more]), np.zeros(more)])
    else:
        raise ValueError(f"not converged after {rounds} restarts")
    x, y = left.c @ p[:, :keep], right.c[:, : b.shape[1]] @ q[:keep].T
    gx, gy = left.g @ p[:, :keep] - left.ridge * x, right.g[:, : b.shape[1]] @ q[:keep].T - right.ridge * y
    whole = np.sqrt(np.maximum((x * gx).sum(axis=0) * (y * gy).sum(axis=0), 0))  # 1, or 0 for what only the ridge has
    s = np.where(whole > 0.5, (gx * gy).sum(axis=0) / np.maximum(whole, 0.5), 0)
    real = s > max(s[0] * 1e-6, 0)
    x, y, s = x[:, real], y[:, real], s[real]
    head = np.array([first[0]], float)
    sign = np.where(((standardize_rows(head) if standardize else head) @ x)[0] < 0, -1.0, 1.0)
    return projected(ref, x * sign, standardize), projected(query, y * sign, standardize), s
