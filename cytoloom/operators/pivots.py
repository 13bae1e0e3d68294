"""Neighbour joins through a partition of space: exact, or within (1 + eps) of the exact distances.

An index has at most some thousand centres, fitted on a bounded sample; every data row belongs to its nearest centre's
cell, and a cell's radius is the distance of its farthest row, so no row lies nearer to a query row than the distance of
the centre less the radius. A query row first meets the cells nearest to it that hold enough rows, which bounds the
distance of its last neighbour; then those other cells that may hold a nearer one. With ``eps`` a cell is left out where
it could not improve that bound by more than the factor 1 + eps: the r-th row returned is at most 1 + eps times as far as the
r-th neighbour. Correlation distances are half the squares of Euclidean distances of unit rows, which is how they are bounded.

Cells are cut into blocks of bounded size, so a cell with a third of all rows is many blocks. The nearest cells and the
query rows that meet them are joined, block by block. For the others the query becomes strips that see all blocks one after
the other in one task: there a row looks only at blocks of its cells and keeps the best within its bound, so neither copies
of rows for each cell nor each cell's best cross the network. Nothing but centres and counts is on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import kept
from .knn import BLOCK_BYTES, HELD, KNN, Closest, arrays, gathered, matrix, unit
from .knn import packed as strips_of

#: Rows that centres are fitted on.
SAMPLE = 4096
#: No more centres than these.
CELLS = 1024
#: Rows of a batch.
STEP = 4096


def points(rows: DataFrame, metric: str) -> DataFrame:
    """(ord, v) as the metric sees them: unit rows for correlation; rows that have NaN there are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                x = unit(x) if metric == "correlation" else x
                good = ~np.isnan(x).any(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), pa.array(list(x[good]), pa.list_(pa.float64()))], ["ord", "v"])

    return rows.select("ord", "v").mapInArrow(run, "ord long, v array<double>")


def apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * (x @ c.T), 0))


def centres(sample: np.ndarray, many: int) -> np.ndarray:
    """Rows far from each other, then moved to the means of what is nearest to them."""
    at, far = [0], apart(sample, sample[:1])[:, 0]
    while len(at) < many and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, apart(sample, sample[at[-1:]])[:, 0])
    c = sample[at]
    for _ in range(4):
        own = apart(sample, c).argmin(axis=1)
        c = np.array([sample[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
    return c


def packed(rows: DataFrame, name: str, parts: dict[int, int], meets: dict[int, int]) -> DataFrame:
    """(cell, name, other, name_ords, name_v): each cell's rows in ``parts`` blocks, a copy for each block that they meet."""
    sent = rows.sparkSession.sparkContext.broadcast((parts, meets))  # a number per cell

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, ords = np.asarray(b.column(0)), np.asarray(b.column(1), np.int64)
            many = np.array([sent.value[0].get(int(c), 1) for c in cell], np.int64)
            block = (ords.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % many if len(ords) else ords
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(block, pa.int64())], ["cell", "ord", "v", "block"])

    def pack(block: pa.Table) -> pa.Table:
        ords = np.asarray(block.column("ord").combine_chunks(), np.int64)
        order = np.argsort(ords, kind="stable")
        x = matrix(block.column("v").combine_chunks())[order]
        cell = block.column("cell")[0].as_py()
        cols = [pa.array([cell], pa.int32()), pa.array([block.column("block")[0].as_py()], pa.int64()), pa.array([sent.value[1].get(cell, 0)], pa.int64())]
        return pa.Table.from_arrays([*cols, pa.array([ords[order].tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["cell", name, "many", f"{name}_ords", f"{name}_v"])

    dealt = rows.select("cell", "ord", "v").mapInArrow(deal, "cell int, ord long, v array<double>, block long")
    blocks = dealt.groupBy("cell", "block").applyInArrow(pack, f"cell int, {name} long, many long, {name}_ords binary, {name}_v binary")
    other = "d" if name == "q" else "q"
    return blocks.where("many > 0").withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1))).drop("many")


def wanted(space: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, k: int, tau: np.ndarray | None = None, eps: float = 0.0) -> np.ndarray:
    """Which cells of ``space`` (centres, sizes, radius) each row visits: the nearest that hold ``k`` rows, or of the others those that ``tau`` leaves."""
    c, sizes, radius = space
    d = apart(x, c)
    order = np.argsort(d, axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    first = np.zeros(d.shape, bool)
    np.put_along_axis(first, order, before < k, axis=1)
    if tau is not None:
        # A distance from a matrix product is off by some 1e-8 of the lengths.
        slack = 1e-7 * (np.sqrt((x * x).sum(axis=1))[:, None] + np.sqrt((c * c).sum(axis=1)) + radius)
        first = ~first & (np.maximum(d - radius - slack, 0) * (1 + eps) <= tau[:, None] + slack)
    return first & (sizes > 0)


class Index:
    """Cells over a table (ord, v). Written once in the shared folder, so that searches start there."""

    def __init__(self, data: DataFrame, metric: str = "euclidean", cells: int | None = None, block_bytes: int = BLOCK_BYTES):
        if metric not in ("correlation", "euclidean"):
            raise ValueError(f"unknown metric {metric!r}")
        self.metric, self.spark = metric, data.sparkSession
        rows = points(data, metric)
        sample = rows.orderBy(F.xxhash64("ord"), "ord").limit(SAMPLE).toArrow()
        self.centres = np.zeros((0, 0))
        if sample.num_rows:
            x = matrix(sample.column("v").combine_chunks())
            self.centres = centres(x, cells or min(CELLS, max(1, int(len(x) ** 0.5))))
        self.rows = kept(self._home(rows), "cells")
        self.sizes, self.radius = np.zeros(len(self.centres), np.int64), np.zeros(len(self.centres))
        for r in self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():  # a row per centre
            self.sizes[r["cell"]], self.radius[r["cell"]] = r["n"], r["r"]
        self.n = int(self.sizes.sum())
        self.per = max(1, block_bytes // 4 // (8 * max(1, self.centres.shape[1])))
        #: The share of all pairs that the last search compared.
        self.share = 0.0

    def _home(self, rows: DataFrame) -> DataFrame:
        sent = self.spark.sparkContext.broadcast(self.centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    d = apart(matrix(b.column(1)), sent.value)
                    own = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int32()), pa.array(d[np.arange(len(d)), own])], ["ord", "v", "cell", "away"])

        return rows.mapInArrow(run, "ord long, v array<double>, cell int, away double")

    def _visits(self, rows: DataFrame, k: int) -> DataFrame:
        """(cell, ord, v): the nearest cells that hold ``k`` rows."""
        sent = self.spark.sparkContext.broadcast((self.centres, self.sizes, self.radius))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for low in range(0, b.num_rows, STEP):
                    part = b.slice(low, STEP)
                    at, cell = np.nonzero(wanted(sent.value, matrix(part.column(1)), k))
                    for i in range(0, len(at), STEP):
                        take = pa.array(at[i : i + STEP])
                        yield pa.RecordBatch.from_arrays([pa.array(cell[i : i + STEP], pa.int32()), part.column(0).take(take), part.column(1).take(take)], ["cell", "ord", "v"])

        return rows.mapInArrow(run, "cell int, ord long, v array<double>")

    def _rest(self, rows: DataFrame, k: int, eps: float) -> DataFrame:
        """(src, dst, rank, dist): the k best within ``tau`` of rows (ord, v, tau) in the cells that the bound leaves."""
        metric, sizes = self.metric, self.sizes
        sent = self.spark.sparkContext.broadcast((self.centres, sizes, self.radius))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs = 0
            for b in batches:
                for low in range(0, b.num_rows, STEP):
                    part = b.slice(low, STEP)
                    pairs += int(wanted(sent.value, matrix(part.column(1)), k, np.asarray(part.column(2)), eps).sum(axis=0) @ sizes)
            yield pa.RecordBatch.from_arrays([pa.array([pairs])], ["pairs"])

        self._pairs += rows.select("ord", "v", "tau").mapInArrow(count, "pairs long").agg(F.sum("pairs")).first()[0] or 0
        many, wide = rows.count(), 8 * (self.centres.shape[1] + 1)
        q_blocks = max(1, -(-many * wide // (BLOCK_BYTES // 4)), -(-many * HELD * min(k, self.n) // (BLOCK_BYTES // 2)), min(2 * self.spark.sparkContext.defaultParallelism, many))
        parts = np.maximum(1, -(-sizes * wide // (BLOCK_BYTES // 16)))
        cell_of = np.repeat(np.arange(len(parts)), parts)
        at = lambda values: F.get(F.array(*(F.lit(int(x)) for x in values)), F.col("cell"))
        block = (at(np.cumsum(parts) - parts) + F.pmod(F.xxhash64("ord"), at(parts))).cast("int")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            src, best, now = None, None, None
            for q, d, ords, x in arrays(batches):
                if d < 0:
                    if best is not None:
                        yield from best.found(src, k)
                    src, now, tau = ords, q, x[:, -1]
                    x = np.ascontiguousarray(x[:, :-1])
                    visits = np.concatenate([wanted(sent.value, x[i : i + STEP], k, tau[i : i + STEP], eps) for i in range(0, len(x), STEP)])
                    best, least = Closest(x, k, metric), tau if metric == "euclidean" else tau * tau / 2
                elif q == now:
                    best.see(ords, x, np.flatnonzero(visits[:, cell_of[d]]), least)
            if best is not None:
                yield from best.found(src, k)

        left = strips_of(rows.select("ord", F.concat("v", F.array("tau")).alias("v")), q_blocks, "q").select("q", F.lit(-1).alias("d"), "ords", "v")
        right = gathered(self.rows.select("ord", "v", block.alias("d")), "d").select(F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"), "d", "ords", "v")
        return left.unionByName(right).repartitionById(q_blocks, F.col("q")).sortWithinPartitions("q", "d").mapInArrow(meet, KNN)

    def _meet(self, visits: DataFrame, k: int) -> DataFrame:
        """(src, dst, rank, dist): the k best of each block that a row meets."""
        metric = self.metric
        asked = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}  # a row per centre
        self._pairs += sum(n * int(self.sizes[c]) for c, n in asked.items())
        q_parts = {c: -(-n // self.per) for c, n in asked.items()}
        d_parts = {c: -(-int(self.sizes[c]) // self.per) for c in asked}

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    src, q, ords, d = (np.frombuffer(c[i].as_py(), t) for c, t in zip(b.columns, ("<i8", "<f8", "<i8", "<f8"), strict=True))
                    best = Closest(q.reshape(len(src), -1), k, metric)
                    best.see(ords, d.reshape(len(ords), -1))
                    yield from best.found(src, k)

        left, right = packed(visits, "q", q_parts, d_parts), packed(self.rows, "d", d_parts, q_parts)
        return left.join(right.hint("merge"), ["cell", "q", "d"]).select("q_ords", "q_v", "d_ords", "d_v").mapInArrow(meet, KNN)

    def search(self, query: DataFrame, k: int, eps: float = 0.0, drop_self: bool = False) -> DataFrame:
        """(src, dst, rank, dist): as ``knn`` gives them, for ``eps`` 0; rows of ``query`` that have NaN have no neighbours.

        Distances have 12 digits and ties go to the smaller ord. ``drop_self`` leaves out the row with the same ord.
        """
        if k < 1 or eps < 0:
            raise ValueError("k must be at least 1 and eps at least 0")
        self._pairs, kk = 0, k + drop_self
        rows = points(query, self.metric)
        if not self.n:
            return self.spark.createDataFrame([], KNN)
        w = Window.partitionBy("src").orderBy("dist", "dst")
        best = lambda found, m: found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m)
        near = kept(best(self._meet(self._visits(rows, kk), kk), kk), "near")
        last = F.max("dist") if self.metric == "euclidean" else F.sqrt(2 * F.greatest(F.max("dist"), F.lit(0.0)))
        # Fewer rows than asked for: all cells were met already.
        bound = near.groupBy("src").agg(F.when(F.count("*") >= kk, last).otherwise(F.lit(-1.0)).alias("tau"))
        more = self._rest(kept(rows.join(bound.withColumnRenamed("src", "ord"), "ord").select("ord", "v", "tau"), "bounds"), kk, eps)
        asked = rows.count()
        self.share = self._pairs / (asked * self.n) if asked else 0.0
        out = near.unionByName(more)
        return best(out.where("src != dst") if drop_self else out, k).select("src", "dst", "rank", "dist")
