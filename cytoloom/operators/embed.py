"""Low-dimensional neighbour embedding: a fuzzy neighbour graph laid out by attraction and sampled repulsion.

The neighbour search is the distributed join. Up to ``MOST_CELLS`` the layout moves all points together, on arrays in one
task. Beyond, points are dealt to blocks by a hash: a task moves one block's points along the edges that start there,
against the positions that the others had at the last exchange, and away from random ones of these. Blocks exchange positions every ``TURN`` epochs. Either way it starts from principal components, and
generators are seeded by block and epoch, so a result depends only on the cells and the parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, kept
from .cca import pca
from .knn import Closest, knn, matrix, unit
from .limits import MOST_CELLS

#: Blocks of a layout at least, cells of one at most, and epochs between exchanges of positions.
BLOCKS, BLOCK_CELLS, TURN = 12, 30_000, 8
#: Points that are moved away from the same random others, and portions of an epoch's edges.
TOGETHER, PARTS = 64, 16


def membership(dist: np.ndarray) -> np.ndarray:
    """Strengths of each row's neighbours (ascending distances): 1 at the nearest, decaying so that they sum to log2(k)."""
    rho = np.where((dist > 0).any(axis=1), np.where(dist > 0, dist, np.inf).min(axis=1), 0.0)[:, None]
    over = np.maximum(dist - rho, 0)
    lo, hi = np.full((len(dist), 1), 1e-6), np.full((len(dist), 1), np.maximum(dist.max(), 1e-3) * 1e3)
    target = np.log2(max(dist.shape[1], 2))
    for _ in range(60):
        mid = np.sqrt(lo * hi)
        big = np.exp(-over / mid).sum(axis=1, keepdims=True) > target
        hi, lo = np.where(big, mid, hi), np.where(big, lo, mid)
    return np.exp(-over / np.sqrt(lo * hi))


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a x^(2b)) closest to 1 up to ``min_dist`` and an exponential decay beyond."""
    x = np.linspace(1e-3, 3 * spread, 300)
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b = 1.0, 1.0
    for _ in range(100):  # Gauss-Newton with a little damping
        u = x ** (2 * b)
        f = 1 / (1 + a * u)
        j = np.stack([-u * f * f, -2 * a * np.log(x) * u * f * f], 1)
        step = np.linalg.solve(j.T @ j + 1e-6 * np.eye(2), j.T @ (y - f))
        a, b = max(1e-3, a + step[0]), max(0.1, b + step[1])
    return float(a), float(b)


def layout(start: np.ndarray, head: np.ndarray, tail: np.ndarray, weight: np.ndarray, epochs: int, negatives: int, a: float, b: float, seed: int) -> np.ndarray:
    """Move points along sampled edges, nearer by weight, and away from random others."""
    rng = np.random.default_rng(seed)
    y, n = start.astype(np.float32), len(start)
    chance = weight / weight.max() if len(weight) else weight
    step = max(1, (1 << 22) // max(1, negatives * y.shape[1]))  # edges whose random others are looked at together
    for e in range(epochs):
        rate = np.float32(1 - e / epochs)
        at = np.flatnonzero(rng.random(len(head)) < chance)
        i, j = head[at], tail[at]
        d = y[i] - y[j]
        r = np.maximum((d * d).sum(axis=1, keepdims=True), 1e-9)
        g = np.clip(-2 * a * b * r ** (b - 1) / (1 + a * r**b) * d, -4, 4).astype(np.float32) * rate
        np.add.at(y, i, g)
        np.add.at(y, j, -g)
        for low in range(0, len(i), step):
            part = i[low : low + step]
            d = y[part][:, None] - y[rng.integers(0, n, (len(part), negatives))]
            r = np.einsum("ijk,ijk->ij", d, d)[..., None]
            push = np.clip((2 * b * (r > 0) / ((0.001 + r) * (1 + a * r**b))).astype(np.float32) * d, -4, 4)
            np.add.at(y, part, push.sum(axis=1) * rate)
    return y.astype(float)


def placed(start: np.ndarray, dst: np.ndarray, dist: np.ndarray, epochs: int, negatives: int, min_dist: float, seed: int) -> np.ndarray:
    """Coordinates from a start, each row's neighbours (row numbers) and their distances."""
    n = len(start)
    src, w = np.repeat(np.arange(n), dst.shape[1]), np.round(membership(dist), 9).reshape(-1).astype(np.float32)
    low, high = np.minimum(src, dst.reshape(-1)), np.maximum(src, dst.reshape(-1))
    order = np.lexsort((high, low))
    low, high, w = low[order], high[order], w[order]
    # An edge of both lists weighs w + w' - w w'; the edges are in the order of their ends.
    first = np.flatnonzero(np.r_[True, (np.diff(low) != 0) | (np.diff(high) != 0)])
    other = np.where(np.diff(np.r_[first, len(w)]) > 1, w[np.minimum(first + 1, len(w) - 1)], np.float32(0))
    i, j, w = low[first], high[first], w[first] + other - w[first] * other
    i, j, w = i[w != 0], j[w != 0], w[w != 0]
    # Rounded: sums over other partitions differ in their last digits, which the layout would magnify.
    start = np.round(10 * start / max(np.abs(start).max(), 1e-12), 6) + np.random.default_rng(seed).normal(0, 1e-4, start.shape)
    return layout(start, i, j, w, epochs, negatives, *curve(min_dist), seed)


def embedded_rows(x: np.ndarray, components: int, k: int, min_dist: float = 0.1, epochs: int = 200, negatives: int = 5, seed: int = 0) -> np.ndarray:
    """The embedding of rows that one task holds, by correlation; rows without variance stay at the origin."""
    out = np.zeros((len(x), components))
    z = unit(x)
    good = np.flatnonzero(~np.isnan(z).any(axis=1)) if len(x) else np.zeros(0, int)
    z, x = z[good], x[good]
    near = min(k, len(x)) - 1
    if near < 1:
        return out
    dst, dist = np.zeros((len(x), near), np.int64), np.zeros((len(x), near))
    step = max(1, (1 << 21) // len(x))  # rows that are compared with all others together
    for low in range(0, len(x), step):
        best = Closest(z[low : low + step], near + 1, "correlation")
        best.see(np.arange(len(x)), z)
        for b in best.found(np.arange(low, low + len(best.q)), near, drop_self=True):
            at, rank = np.asarray(b.column(0)), np.asarray(b.column(2)) - 1
            dst[at, rank], dist[at, rank] = np.asarray(b.column(1)), np.asarray(b.column(3))
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    start = np.zeros((len(x), components))
    wide = min(components, len(s))
    start[:, :wide] = (u * s * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1, 1))[:, :wide]
    out[good] = placed(start, dst, np.maximum(dist, 0), epochs, negatives, min_dist, seed)
    return out


def pushes(y: np.ndarray, others: np.ndarray, a: float, b: float) -> np.ndarray:
    """The sum of the pushes that each of ``others`` (group, many, width) gives to each row of its group in ``y``, each clipped to 4."""
    r = np.maximum((y * y).sum(axis=2)[:, :, None] + (others * others).sum(axis=2)[:, None] - 2 * y @ others.transpose(0, 2, 1), 0)
    c = np.where(r > 1e-12, 2 * b / ((0.001 + r) * (1 + a * r**b)), 0.0)
    strong = c * np.sqrt(r) > 4  # only these can need clipping
    g, i, j = np.nonzero(strong)
    far = y[g, i] - others[g, j]
    over = np.clip(c[g, i, j][:, None] * far, -4, 4)
    c[strong] = 0
    out = c.sum(axis=2)[:, :, None] * y - c @ others
    np.add.at(out, (g, i), over)
    return out


def moved(y: np.ndarray, n: int, head: np.ndarray, tail: np.ndarray, chance: np.ndarray, first: np.ndarray, epochs: range, of: int, negatives: int, a: float, b: float, seed: tuple[int, ...]) -> None:
    """Move the first ``n`` rows of ``y`` along edges (``head`` ascending, below n) for some epochs ``of`` all; the others stay.

    ``first`` marks the edges whose head is pushed away from random rows: each edge is listed from both its ends. An
    epoch's edges act in ``PARTS`` portions, each on what the ones before left: all at once they overshoot, which the
    others, where they stand still, do not make up for.
    """
    for e in epochs:
        rng = np.random.default_rng([*seed, e])
        rate = 1 - e / of
        drawn = rng.permutation(np.flatnonzero(rng.random(len(head)) < chance))
        for some in np.array_split(drawn, min(PARTS, len(drawn)) or 1):
            some = np.sort(some)
            for low in range(0, len(some), 1 << 15):
                part = some[low : low + (1 << 15)]
                i = head[part]
                d = y[i] - y[tail[part]]
                r = np.maximum((d * d).sum(axis=1, keepdims=True), 1e-9)
                g = np.clip(-2 * a * b * r ** (b - 1) / (1 + a * r**b) * d, -4, 4)
                start = np.flatnonzero(np.r_[True, np.diff(i) != 0])
                y[i[start]] += np.add.reduceat(g, start) * rate
            at = rng.permutation(head[some[first[some]]])
            step = TOGETHER * max(1, (1 << 19) // (TOGETHER * negatives))
            for low in range(0, len(at), step):
                part = at[low : low + step]
                groups = -(-len(part) // TOGETHER)
                full = np.r_[part, np.full(groups * TOGETHER - len(part), part[0])]
                push = pushes(y[full].reshape(groups, TOGETHER, -1).astype(float), y[rng.integers(0, len(y), (groups, negatives))].astype(float), a, b).reshape(len(full), -1)
                np.add.at(y, part, push[: len(part)] * rate)


def spread(cells: DataFrame, near: DataFrame, n: int, components: int, min_dist: float, epochs: int, negatives: int, seed: int) -> DataFrame:
    """(ord, v): the layout in blocks, from neighbour lists (src, dst, rank, dist) of equal lengths."""
    blocks = max(BLOCKS, -(-n // BLOCK_CELLS))
    home = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w = np.round(membership(matrix(b.column(2))), 9)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column(0)), w.shape[1])), b.column(1).flatten(), pa.array(w.reshape(-1))], ["src", "dst", "w"])

    lists = near.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst", "dist"))).alias("n")).select("src", "n.dst", F.col("n.dist").alias("dist"))
    lists = lists.select("src", "dst", F.transform("dist", lambda x: F.greatest(x, F.lit(0.0))).alias("dist"))
    one = lists.mapInArrow(weigh, "src long, dst long, w double")
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst")
    # An edge of both lists weighs w + w' - w w'.
    edges = both.agg(F.when(F.count("*") > 1, F.sum("w") - F.min("w") * F.max("w")).otherwise(F.sum("w")).alias("w"))
    edges = kept(edges.select("src", "dst", "w", home("src").alias("block")), "edges")
    most = edges.agg(F.max("w")).first()[0] or 1.0

    def pack_edges(t: pa.Table) -> pa.Table:
        src, dst, w = (np.asarray(t[c]) for c in ("src", "dst", "w"))
        at = np.lexsort((dst, src))
        own, many = np.unique(src, return_counts=True)
        v = many.astype("<i8").tobytes() + dst[at].tobytes() + (w[at] / most).astype("<f4").tobytes()
        return pa.table([pa.array([t["block"][0].as_py()], pa.int32()), pa.array([-1], pa.int32()), pa.array([own.tobytes()], pa.binary()), pa.array([v], pa.binary())], names=["q", "d", "ords", "v"])

    def pack_start(t: pa.Table) -> pa.Table:
        ords = np.asarray(t["ord"])
        at = np.argsort(ords)
        x = np.zeros((len(ords), components))
        v = matrix(t["v"].combine_chunks())[at]
        x[:, : v.shape[1]] = np.round(10 * v / scale, 6)
        block = t["block"][0].as_py()
        return placed_rows(block, ords[at], x + np.random.default_rng([seed, block]).normal(0, 1e-4, x.shape))

    def placed_rows(block: int, ords: np.ndarray, y: np.ndarray) -> pa.Table:
        return pa.table([pa.array([block], pa.int32()), pa.array([ords.tobytes()], pa.binary()), pa.array([y.astype("<f4").tobytes()], pa.binary())], names=["d", "ords", "v"])

    placed_schema = "d int, ords binary, v binary"
    fixed = kept(edges.groupBy("block").applyInArrow(pack_edges, f"q int, {placed_schema}"), "block-edges")
    start = kept(pca(cells, components).join(edges.select(F.col("src").alias("ord")).distinct(), "ord"), "start")
    scale = max(start.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0] or 0.0, 1e-12)
    state = kept(start.withColumn("block", home("ord")).groupBy("block").applyInArrow(pack_start, placed_schema), "positions")
    discard(edges, start)
    a, b = curve(min_dist)

    def turn(some: range):
        def end(block: int, head: np.ndarray, tail: np.ndarray, chance: np.ndarray, own: np.ndarray, names: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(names)
            moved(y, len(own), np.searchsorted(own, head), order[np.searchsorted(names, tail, sorter=order)], chance, head < tail, some, epochs, negatives, a, b, (seed, block))
            return placed_rows(block, own, y[: len(own)]).to_batches()[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = None
            for batch in batches:
                for i in range(batch.num_rows):
                    q, d = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                    ords, v = np.frombuffer(batch.column(2)[i].as_buffer(), "<i8"), batch.column(3)[i].as_buffer()
                    if d == -1:
                        if now is not None:
                            yield end(*now)
                        head = np.repeat(ords, np.frombuffer(v, "<i8", len(ords)))
                        tail, chance = np.frombuffer(v, "<i8", len(head), 8 * len(ords)), np.frombuffer(v, "<f4", len(head), 8 * (len(ords) + len(head)))
                        names = np.r_[ords, np.setdiff1d(tail, ords)]
                        now = (q, head, tail, chance, ords, names, np.zeros((len(names), components), np.float32))
                    else:
                        names, y = now[-2:]
                        at = np.minimum(np.searchsorted(ords, names), len(ords) - 1)
                        hit = ords[at] == names
                        y[hit] = np.frombuffer(v, "<f4").reshape(len(ords), -1)[at[hit]]
            if now is not None:
                yield end(*now)

        return run

    for low in range(0, epochs, TURN):
        copies = state.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("q"), "d", "ords", "v")
        met = fixed.unionByName(copies.join(F.broadcast(fixed.select("q")), "q", "left_semi")).repartitionById(blocks, F.col("q")).sortWithinPartitions("q", "d")
        new = kept(met.mapInArrow(turn(range(low, min(low + TURN, epochs))), placed_schema), "positions")
        discard(state)
        state = new
    discard(fixed)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ords = np.frombuffer(batch.column(1)[i].as_buffer(), "<i8")
                y = np.frombuffer(batch.column(2)[i].as_buffer(), "<f4").astype(float)
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(ords) + 1) * components, pa.int32()), pa.array(y))
                yield pa.RecordBatch.from_arrays([pa.array(ords), v], ["ord", "v"])

    return state.mapInArrow(unpack, "ord long, v array<double>")


def neighbour_embedding(cells: DataFrame, components: int = 2, k: int = 30, min_dist: float = 0.1, epochs: int = 200, negatives: int = 50, metric: str = "correlation", seed: int = 0, most: int = MOST_CELLS) -> DataFrame:
    """(ord, v): ``components`` coordinates of every cell that has neighbours; ``k`` counts the cell itself. Beyond ``most`` cells in blocks."""
    n = cells.count()
    near = knn(cells, cells, min(k, max(2, n)) - 1, metric, drop_self=True)
    if n > most:
        return spread(cells, near, n, components, min_dist, epochs, negatives, seed)
    lists = near.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst", "dist"))).alias("n"))
    rows = lists.join(pca(cells, components).withColumnRenamed("ord", "src"), "src").withColumn("g", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("src")
        ids = pdf["src"].to_numpy()
        dst = np.searchsorted(ids, np.array([[x["dst"] for x in r] for r in pdf["n"]]))
        y = placed(np.array(pdf["v"].tolist()), dst, np.array([[x["dist"] for x in r] for r in pdf["n"]]), epochs, negatives, min_dist, seed)
        return pd.DataFrame({"ord": ids, "v": y.tolist()})

    return rows.groupBy("g").applyInPandas(run, "ord long, v array<double>")
