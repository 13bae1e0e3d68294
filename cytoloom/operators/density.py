"""Minimum spanning trees of mutual reachability, by Boruvka rounds over neighbour lists.

Two cells are as far apart as the largest of their distance and their core distances (that of a cell to its
``min_samples``-th neighbour, itself counted). In a round every component takes its least edge to another one, in the
order (distance, a, b), which leaves no cycles, and components joined by such edges become one.

The trees of all ``min_samples`` go through the rounds together. The lists are written once, in blocks of cells; a round
sends every block the cores and components of all, a few numbers a cell and tree, and a block gives each component's least
edge. A list says nothing about what is beyond its last entry, so that edge counts only if no cell of the component might
have a nearer one beyond its list's end. Such cells are searched exactly, strips of them against blocks of all cells, for
all trees at once. The largest component of a tree is not searched: it waits for the others to join it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, kept
from .knn import BLOCK_BYTES, knn, matrix, unit

#: Entries of a neighbour list at least, and entries beyond the one that is the core distance.
LIST, FOUND = 15, 8
ROUNDS = 64
#: Pairs of an exact search that are worth a strip of their own, and distances that a task looks at together.
WORTH, CHUNK = 1 << 26, 1 << 20
_OFFER = "t int, comp long, d double, a long, b long, to long"


def list_length(min_samples: Sequence[int]) -> int:
    return max(LIST, max(min_samples) - 1 + FOUND)


def core_distances(near: DataFrame, cells: DataFrame, min_samples: int) -> DataFrame:
    """(ord, core) of every cell that has neighbours: the distance to its ``min_samples``-th nearest, itself the first, or to its last."""
    if min_samples < 2:
        return cells.select("ord", F.lit(0.0).alias("core"))
    return near.where(F.col("rank") < min_samples).groupBy(F.col("src").alias("ord")).agg(F.max("dist").alias("core"))


def distances_between(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """All distances, rounded as in the neighbour joins; rows are unit rows for correlation."""
    if metric == "correlation":
        return np.maximum(np.round(1 - q @ x.T, 12), 0)
    return np.round(np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None] - 2 * q @ x.T, 0)), 12)


def _row(*values: object) -> list[pa.Array]:
    """One row: numbers as int, arrays as binary."""
    return [pa.array([v], pa.int32()) if isinstance(v, int) else pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in values]


def _lists(near: DataFrame, samples: Sequence[int], blocks: int) -> DataFrame:
    """(block, n, ords, many, dst, dist, core): the neighbour lists of each block's cells and their core distances for all ``samples``."""

    def pack(t: pa.Table) -> pa.Table:
        src, dst, dist = np.asarray(t["src"], np.int64), np.asarray(t["dst"], np.int64), np.asarray(t["dist"], float)
        order = np.lexsort((np.asarray(t["rank"]), src))
        ords, start, many = np.unique(src[order], return_index=True, return_counts=True)
        dst, dist = dst[order], dist[order]
        core = np.stack([dist[start + np.minimum(s - 1, many) - 1] if s > 1 else np.zeros(len(ords)) for s in samples], 1)
        return pa.Table.from_arrays(_row(t["block"][0].as_py(), len(ords), ords, many.astype(np.int64), dst, dist, core), ["block", "n", "ords", "many", "dst", "dist", "core"])

    dealt = near.select("src", "dst", "rank", "dist", F.pmod(F.xxhash64("src"), F.lit(blocks)).cast("int").alias("block"))
    return dealt.groupBy("block").applyInArrow(pack, "block int, n int, ords binary, many binary, dst binary, dist binary, core binary")


def _least(t: int, comp: np.ndarray, d: np.ndarray, a: np.ndarray, b: np.ndarray, to: np.ndarray) -> pa.RecordBatch:
    """The least (d, a, b) of each component, of edges that are in the order (a, b)."""
    order = np.argsort(d, kind="stable")
    own, at = np.unique(comp[order], return_index=True)
    at = order[at]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t, np.int32)), *(pa.array(x) for x in (own, d[at], a[at], b[at], to[at]))], ["t", "comp", "d", "a", "b", "to"])


def _offers(lists: DataFrame, state: DataFrame, blocks: int, trees: Sequence[int]) -> DataFrame:
    """Each block's least edges out of each component that its lists touch. ``state`` is (d, ords, comp, core)."""

    def end(ords: np.ndarray, many: np.ndarray, dst: np.ndarray, dist: np.ndarray, names: np.ndarray, comp: np.ndarray, core: np.ndarray) -> Iterator[pa.RecordBatch]:
        src = np.repeat(ords, many)
        a, b = np.minimum(src, dst), np.maximum(src, dst)
        order = np.lexsort((b, a))
        a, b, dist = a[order], b[order], dist[order]
        i, j = np.searchsorted(names, a), np.searchsorted(names, b)
        for t in trees:
            x, y = comp[i, t], comp[j, t]
            out = np.flatnonzero(x != y)
            if len(out):
                d = np.maximum(dist[out], np.maximum(core[i[out], t], core[j[out], t]))
                for own, to in ((x, y), (y, x)):
                    yield _least(t, own[out], d, a[out], b[out], to[out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for i in range(batch.num_rows):
                d, ords = batch.column(1)[i].as_py(), np.frombuffer(batch.column(2)[i].as_buffer(), "<i8")
                x, y, z = (batch.column(c)[i] for c in (3, 4, 5))
                if d < 0:
                    if now is not None:
                        yield from end(*now)
                    many, dst, dist = np.frombuffer(x.as_py(), "<i8"), np.frombuffer(y.as_py(), "<i8"), np.frombuffer(z.as_py(), "<f8")
                    names = np.unique(np.r_[ords, dst])
                    now = (ords, many, dst, dist, names, None, None)
                else:
                    names = now[4]
                    comp, core = (np.frombuffer(c.as_buffer(), k).reshape(len(ords), -1) for c, k in ((x, "<i8"), (y, "<f8")))
                    if now[5] is None:
                        now = (*now[:5], np.zeros((len(names), comp.shape[1]), np.int64), np.zeros((len(names), comp.shape[1])))
                    at = np.minimum(np.searchsorted(ords, names), len(ords) - 1)
                    hit = ords[at] == names
                    now[5][hit], now[6][hit] = comp[at[hit]], core[at[hit]]
        if now is not None:
            yield from end(*now)

    fixed = lists.select(F.col("block").alias("q"), F.lit(-1).alias("d"), "ords", F.col("many").alias("x"), F.col("dst").alias("y"), F.col("dist").alias("z"))
    copies = lists.select(F.col("block").alias("q")).crossJoin(state.select("d", "ords", F.col("comp").alias("x"), F.col("core").alias("y"), F.lit(None).cast("binary").alias("z")))  # a few dozen blocks
    met = fixed.unionByName(copies).repartitionById(blocks, F.col("q")).sortWithinPartitions("q", "d")
    return met.mapInArrow(run, _OFFER)


def _searched(asked: DataFrame, cells: DataFrame, vectors: DataFrame, state: DataFrame, n: int, trees: int, metric: str) -> DataFrame:
    """The nearest cell of another component to each row of ``asked`` (t, ord, comp, core), for both components.

    ``vectors`` (d, v) and ``state`` (d, ords, comp, core) have all cells, in blocks.
    """
    ords = kept(asked.select("ord").distinct(), "asked")
    many, width = ords.count(), vectors.select("width").first()[0]
    parallel = 2 * cells.sparkSession.sparkContext.defaultParallelism
    q_blocks = max(1, -(-many * 8 * (width + 4 * trees) // (BLOCK_BYTES // 4)), min(parallel, -(-many * n // WORTH)))
    strip = lambda: F.pmod(F.xxhash64("ord", F.lit(1)), F.lit(q_blocks)).cast("int").alias("q")

    def pack(v: pa.Table, rows: pa.Table) -> pa.Table:
        names, x = np.asarray(v["ord"], np.int64), matrix(v["v"].combine_chunks())
        order = np.argsort(names)
        names, x = names[order], x[order]
        at, t = np.searchsorted(names, np.asarray(rows["ord"], np.int64)), np.asarray(rows["t"])
        comp, core = np.full((len(names), trees), -1, np.int64), np.zeros((len(names), trees))
        comp[at, t], core[at, t] = np.asarray(rows["comp"], np.int64), np.asarray(rows["core"], float)
        return pa.Table.from_arrays(_row(v["q"][0].as_py(), -1, names, x, comp, core), ["q", "d", "ords", "v", "comp", "core"])

    def end(src: np.ndarray, comp: np.ndarray, best: np.ndarray, dst: np.ndarray, to: np.ndarray) -> Iterator[pa.RecordBatch]:
        for t in range(trees):
            i = np.flatnonzero(np.isfinite(best[:, t]))
            if len(i):
                a, b = np.minimum(src[i], dst[i, t]), np.maximum(src[i], dst[i, t])
                i = i[np.lexsort((b, a))]
                a, b = np.minimum(src[i], dst[i, t]), np.maximum(src[i], dst[i, t])
                yield _least(t, comp[i, t], best[i, t], a, b, to[i, t])
                yield _least(t, to[i, t], best[i, t], a, b, comp[i, t])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for r in range(batch.num_rows):
                ords = np.frombuffer(batch.column(2)[r].as_buffer(), "<i8")
                v, comp, core = (np.frombuffer(batch.column(c)[r].as_buffer(), k).reshape(len(ords), -1) for c, k in ((3, "<f8"), (4, "<i8"), (5, "<f8")))
                v = unit(v) if metric == "correlation" else v
                if batch.column(1)[r].as_py() < 0:
                    if now is not None:
                        yield from end(now[0], now[2], *now[4:])
                    now = (ords, v, comp.copy(), core.copy(), np.full(comp.shape, np.inf), np.zeros(comp.shape, np.int64), np.zeros(comp.shape, np.int64))
                    continue
                src, q, own, mine, best, dst, to = now
                for low in range(0, len(src), max(1, CHUNK // len(ords))):
                    at = np.arange(low, min(len(src), low + max(1, CHUNK // len(ords))))
                    far = distances_between(q[at], v, metric)
                    for t in range(trees):
                        some = np.flatnonzero(own[at, t] >= 0)
                        if not len(some):
                            continue
                        i = at[some]
                        d = np.maximum(far[some], mine[i, t, None])
                        np.maximum(d, core[None, :, t], out=d)
                        d[(own[i, t, None] == comp[None, :, t]) | np.isnan(d)] = np.inf
                        j = d.argmin(axis=1)  # the first of equals, which is the smaller (a, b)
                        x = d[np.arange(len(i)), j]
                        nearer = np.isfinite(x) & ((x < best[i, t]) | ((x == best[i, t]) & (ords[j] < dst[i, t])))
                        i, j = i[nearer], j[nearer]
                        best[i, t], dst[i, t], to[i, t] = x[nearer], ords[j], comp[j, t]
        if now is not None:
            yield from end(now[0], now[2], *now[4:])

    left = cells.select("ord", "v").join(ords, "ord").withColumn("q", strip()).groupBy("q")
    left = left.cogroup(asked.withColumn("q", strip()).groupBy("q")).applyInArrow(pack, "q int, d int, ords binary, v binary, comp binary, core binary")
    right = vectors.join(state, "d").select(F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"), "d", "ords", "v", "comp", "core")
    right = right.join(F.broadcast(ords.select(strip()).distinct()), "q", "left_semi")  # strips without rows meet nothing
    return left.unionByName(right).repartitionById(q_blocks, F.col("q")).sortWithinPartitions("q", "d").mapInArrow(run, _OFFER)


def reach_trees(cells: DataFrame, samples: Sequence[int], metric: str = "correlation", near: DataFrame | None = None) -> DataFrame:
    """(i, a, b, d) with a < b: for the i-th of ``samples`` the edges of the minimum spanning tree of mutual reachability.

    ``near`` are the cells' neighbour lists, if they are there already, at least as long as the largest of ``samples``
    needs. Cells without a distance to any other (no variance) are in no edge; no cells or one have no edges. Ties go to
    the smaller (a, b) of the edges that a round sees.
    """
    spark, trees = cells.sparkSession, len(samples)
    if near is None:
        near = kept(knn(cells, cells, list_length(samples), metric, drop_self=True).withColumn("dist", F.greatest("dist", F.lit(0.0))), "near")
    rows = near.count()
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-rows * 24 // (BLOCK_BYTES // 4)))
    lists = kept(_lists(near, samples, blocks), "lists")
    n = lists.agg(F.sum("n")).first()[0] or 0
    none = spark.createDataFrame([], "i int, a long, b long, d double")
    if n < 2:
        discard(lists)
        return none

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ords, many, dist, core = (np.frombuffer(batch.column(c)[r].as_buffer(), k) for c, k in ((1, "<i8"), (2, "<i8"), (3, "<f8"), (4, "<f8")))
                core = core.reshape(len(ords), -1)
                bound = np.where(many >= n - 1, np.inf, dist[np.cumsum(many) - 1])
                for t in range(trees):
                    cols = [np.full(len(ords), batch.column(0)[r].as_py(), np.int32), np.full(len(ords), t, np.int32), ords, core[:, t], np.maximum(bound, core[:, t]), ords]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["block", "t", "ord", "core", "bound", "comp"])

    def pack(t: pa.Table) -> pa.Table:
        ords = np.asarray(t["ord"], np.int64)
        order = np.lexsort((np.asarray(t["t"]), ords))
        return pa.Table.from_arrays(_row(t["block"][0].as_py(), ords[order][::trees], np.asarray(t["comp"], np.int64)[order], np.asarray(t["core"], float)[order]), ["d", "ords", "comp", "core"])

    def pack_vectors(t: pa.Table) -> pa.Table:
        x = matrix(t["v"].combine_chunks())[np.argsort(np.asarray(t["ord"], np.int64))]
        return pa.Table.from_arrays(_row(t["block"][0].as_py(), x.shape[1], x), ["d", "width", "v"])

    state = kept(lists.select("block", "ords", "many", "dist", "core").mapInArrow(begin, "block int, t int, ord long, core double, bound double, comp long"), "state")
    vectors = None
    found: list[DataFrame] = []
    key = ["t", "comp"]
    for _ in range(ROUNDS):
        sizes = state.groupBy(key).agg(F.count("*").alias("n")).groupBy("t").agg(F.count("*").alias("many"), F.max(F.struct("n", "comp")).alias("top")).collect()  # a row per tree
        left = sorted(r["t"] for r in sizes if r["many"] > 1)
        if not left:
            break
        largest = F.element_at(F.create_map(*(F.lit(x) for r in sizes for x in (r["t"], r["top"]["comp"]))), F.col("t"))
        active = state.where(F.col("t").isin(left))
        blocked = kept(state.groupBy("block").applyInArrow(pack, "d int, ords binary, comp binary, core binary"), "blocks")
        edge = F.struct("d", "a", "b", "to")
        best = kept(_offers(lists, blocked, blocks, left).groupBy(key).agg(F.min(edge).alias("best")), "best")
        open_ = active.join(best, key, "left").where((F.col("bound") < F.lit(float("inf"))) & (F.col("best").isNull() | (F.col("bound") < F.col("best.d"))))
        open_ = kept(open_.select("t", "ord", "comp", "core", (F.col("comp") == largest).alias("waits")), "open")
        asked, waiting = open_.where("not waits").select("t", "ord", "comp", "core"), open_.where("waits").select("t", "comp").distinct()
        if not asked.isEmpty():
            if vectors is None:
                dealt = cells.select("ord", "v").join(state.where("t = 0").select("ord", "block"), "ord")
                vectors = kept(dealt.groupBy("block").applyInArrow(pack_vectors, "d int, width int, v binary"), "vectors")
            more = _searched(asked, cells, vectors, blocked, n, trees, metric).select(*key, edge.alias("best"))
            best_ = kept(best.unionByName(more).groupBy(key).agg(F.min("best").alias("best")), "best")
            discard(best)
            best = best_
        chosen = best.join(F.broadcast(waiting), key, "left_anti")  # at most a row per tree
        found.append(kept(chosen.select(F.col("t").alias("i"), "best.a", "best.b", "best.d").distinct(), "tree"))
        # Follow the chosen edges: of two components that chose one edge the smaller is the root, and so is one that waits.
        up = chosen.select(*key, F.col("best.to").alias("up"), F.col("best.a").alias("a"), F.col("best.b").alias("b"))
        up = up.unionByName(waiting.select(*key, F.col("comp").alias("up"), F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b")))
        back = up.select("t", F.col("comp").alias("up"), F.col("a").alias("x"), F.col("b").alias("y"))
        up = kept(up.join(back, ["t", "up"]).select(*key, F.when((F.col("a") == F.col("x")) & (F.col("b") == F.col("y")) & (F.col("comp") < F.col("up")), F.col("comp")).otherwise(F.col("up")).alias("up")), "up")
        while True:
            nxt = kept(up.join(up.select("t", F.col("comp").alias("up"), F.col("up").alias("top")), ["t", "up"]).select(*key, F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "up")
            discard(up)
            moved = not nxt.where("moved").isEmpty()
            up = nxt.select(*key, "up")
            up._scratch = nxt._scratch
            if not moved:
                break
        state_ = kept(state.join(up, key, "left").select("block", "t", "ord", "core", "bound", F.coalesce("up", "comp").alias("comp")), "state")
        discard(state, blocked, best, open_, up)
        state = state_
    else:
        raise RuntimeError(f"trees did not end in {ROUNDS} rounds")
    discard(lists, state, *([] if vectors is None else [vectors]))
    out = none
    for edges in found:
        out = out.unionByName(edges)
    return out


def reach_tree(cells: DataFrame, min_samples: int, metric: str = "correlation", near: DataFrame | None = None) -> DataFrame:
    """(a, b, d): the tree of one ``min_samples``, see :func:`reach_trees`."""
    return reach_trees(cells, [min_samples], metric, near).select("a", "b", "d")
