"""Exact k-nearest-neighbour joins: correlation or Euclidean distance.

A table of vectors is (ord long, v array<double>). A data side of at most ``SEND_BYTES`` is broadcast. A larger one is
never on the driver: the query becomes strips and the data blocks of bounded size, one row each; every strip meets all
blocks in one task, one block after the other, and keeps the k best that it has seen, so the result needs no further
exchange and a block only gives what beats them. The blocks are written once and each task reads them: no copy of them is
on disk for each strip. Either way ties go to the smaller ord; distances are rounded to 12 digits
first, so that equal rows tie on every machine. A row without variance has no correlation neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: Strips of queries hold a quarter of this, blocks of data a sixteenth; what a strip has found takes at most a half.
BLOCK_BYTES = 64 << 20
#: A data side of at most so many bytes is broadcast.
SEND_BYTES = 16 << 20
#: Data rows that are looked at together, pairs of them, pairs whose distances are made together, and rows of a batch that is given.
TILE, CHUNK, EXACT, OUT = 4096, 1 << 19, 1 << 14, 1 << 18
#: Bytes of a neighbour that is kept or waits, and data blocks of a file.
HELD, A_FILE = 40, 4
KNN = "src long, dst long, rank int, dist double"


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    n = len(column)
    return np.asarray(column.flatten(), float).reshape(n, -1) if n else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows centred and of length one; a row without variance becomes NaN."""
    z = x - x.mean(axis=1, keepdims=True) if x.size else x
    norm = np.sqrt((z * z).sum(axis=1, keepdims=True))
    scale = np.abs(x).max(axis=1, keepdims=True) if x.size else norm
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(norm > 1e-12 * np.maximum(scale, 1e-300), z / norm, np.nan)


class Vectors:
    """The data side of neighbour joins: counted once, and collected once where it is small enough to broadcast, else written in blocks once."""

    def __init__(self, rows: DataFrame, block_bytes: int = SEND_BYTES):
        self.rows, self.block_bytes, self.sent, self.blocks = rows.select("ord", "v"), block_bytes, None, None
        self.n, self.width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
        self.small = self.n * (self.width or 1) * 8 <= block_bytes

    def broadcast(self):
        """(ords, vectors) in ascending order, at most ``block_bytes``."""
        if self.sent is None:
            t = self.rows.toArrow()
            ords = np.asarray(t.column(0), np.int64)
            order = np.argsort(ords, kind="stable")
            self.sent = self.rows.sparkSession.sparkContext.broadcast((ords[order], matrix(t.column(1).combine_chunks())[order]))
        return self.sent

    def blocked(self) -> DataFrame:
        """(d, ords, v): the rows in blocks of a sixteenth of BLOCK_BYTES; smaller ones only where they are few."""
        if self.blocks is None:
            size, parallel = self.n * 8 * (self.width or 1), 2 * self.rows.sparkSession.sparkContext.defaultParallelism
            many = max(1, -(-size // (BLOCK_BYTES // 16)), min(parallel, -(-size // max(1, self.block_bytes // 4))))
            self.blocks = kept(packed(self.rows, many, "d"), "blocks", A_FILE)
        return self.blocks


def packed(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """(name, ords, v): the rows of each of ``blocks`` blocks as two binaries, ascending by ord."""
    return gathered(rows.select("ord", "v", F.pmod(F.xxhash64("ord"), F.lit(blocks)).cast("int").alias(name)), name)


def gathered(rows: DataFrame, name: str) -> DataFrame:
    """As :func:`packed`, of rows (ord, v) whose block is in the column ``name``."""

    def pack(block: pa.Table) -> pa.Table:
        ords = np.asarray(block.column("ord").combine_chunks(), np.int64)
        order = np.argsort(ords, kind="stable")
        x = matrix(block.column("v").combine_chunks())[order]
        return pa.table({name: pa.array([block.column(name)[0].as_py()], pa.int32()), "ords": pa.array([ords[order].tobytes()], pa.binary()), "v": pa.array([x.tobytes()], pa.binary())})

    return rows.groupBy(name).applyInArrow(pack, f"{name} int, ords binary, v binary")


def strips(query: DataFrame, data: Vectors, kk: int) -> DataFrame:
    """(d, ords, v, q, own, z): in one partition each strip of ``query`` (q, its ords and vectors) with every data block.

    A strip's task reads all data blocks, so strips are as large as a task may hold with ``kk`` neighbours a row.
    """
    wide, many, parallel = 8 * (data.width or 1), query.count(), 2 * query.sparkSession.sparkContext.defaultParallelism
    held = HELD * max(1, min(kk, data.n))  # bytes of a row's neighbours as they are merged
    q_blocks = max(1, -(-many * wide // (BLOCK_BYTES // 4)), -(-many * held // (BLOCK_BYTES // 2)), min(parallel, many))
    left = packed(query, q_blocks, "q").select("q", F.col("ords").alias("own"), F.col("v").alias("z")).repartitionById(q_blocks, F.col("q"))
    # The blocks, as one partition, are read by the task of each strip, of which the join holds one.
    return data.blocked().coalesce(1).hint("shuffle_replicate_nl").crossJoin(left)


def met(batches: Iterator[pa.RecordBatch], start: Callable) -> Iterator[tuple]:
    """(what ``start`` makes of a strip's ords and vectors, ords, vectors of a data block) of rows of :func:`strips`."""
    pair = lambda b, i, at: (o := np.frombuffer(b.column(at)[i].as_buffer(), "<i8"), np.frombuffer(b.column(at + 1)[i].as_buffer(), "<f8").reshape(len(o), -1))
    begun = {}
    for b in batches:
        for i in range(b.num_rows):
            q = b.column(3)[i].as_py()
            if q not in begun:
                begun[q] = start(*(x.copy() for x in pair(b, i, 4)))
            yield begun[q], *pair(b, i, 1)


def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(q, d, ords, vectors) of rows (q, d, ords, v)."""
    for b in batches:
        for i in range(b.num_rows):
            ords = np.frombuffer(b.column(2)[i].as_buffer(), "<i8")
            yield b.column(0)[i].as_py(), b.column(1)[i].as_py(), ords, np.frombuffer(b.column(3)[i].as_buffer(), "<f8").reshape(len(ords), -1)


class Closest:
    """The ``k`` least (distance, ord) of every row of ``q`` among the data rows seen so far; unit rows for correlation.

    Pairs are sifted by products in single precision, less what these may be off by, so that none is lost; those left get
    their distance in double precision, pair by pair. They wait until there are half as many as are kept, then the best stay.
    """

    def __init__(self, q: np.ndarray, k: int, metric: str):
        self.q, self.k, self.euclid = q, k, metric == "euclidean"
        self.dist, self.dst = np.full((len(q), 0), np.inf), np.zeros((len(q), 0), np.int64)
        self.last, self.last_ord = np.full(len(q), np.inf), np.full(len(q), np.iinfo(np.int64).max)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.many, self.sides = 0, {}
        good = np.isfinite(q).all(axis=1) if self.euclid else np.zeros(0, bool)
        # Distances do not change with the origin, but products round less near the rows.
        self.centre = q[good].mean(axis=0) if good.any() else np.zeros(q.shape[1])
        self.squares = ((q - self.centre) ** 2).sum(axis=1) if self.euclid else np.ones(len(q))

    def see(self, ords: np.ndarray, d: np.ndarray, wanted: np.ndarray | None = None, least: np.ndarray | None = None) -> None:
        """Look at data rows; only for the query rows ``wanted``, and only up to the distance ``least`` of each, if given."""
        rows = np.arange(len(self.q)) if wanted is None else wanted
        for low in range(0, len(ords) if len(rows) else 0, TILE):
            self._tile(rows, ords[low : low + TILE], d[low : low + TILE], least)
            if 2 * self.many >= self.k * len(self.q):
                self.settle()

    def _left(self, kind: type) -> np.ndarray:
        if kind not in self.sides:
            x = self.q - self.centre
            self.sides[kind] = (np.concatenate([x, np.ones((len(x), 1))], 1) if self.euclid else x).astype(kind)
        return self.sides[kind]

    def _tile(self, rows: np.ndarray, ords: np.ndarray, d: np.ndarray, least: np.ndarray | None) -> None:
        x = d - self.centre
        half = (x * x).sum(axis=1, keepdims=True) / 2
        x = np.concatenate([x, -half], 1) if self.euclid else x
        far = np.sqrt(2 * np.nanmax(half, initial=0.0)) if self.euclid else 1.0
        # The products rank data rows of one query row as their distances do: q d, or q d - d^2 / 2.
        fits = max(far * far, np.nanmax(self.squares[rows], initial=0.0)) < 1e30
        right = x.astype(np.float32) if fits else None
        step = max(1, CHUNK // len(d))
        for a in range(0, len(rows), step):
            at = rows[a : a + step]
            hit = self._sifted(at, right, far, least, np.float32) if fits else None
            if hit is None or len(hit) > len(at) * (2 * self.k + 64):
                hit = self._sifted(at, x, far, least, np.float64)
            for low in range(0, len(hit), EXACT):
                i, j = np.divmod(hit[low : low + EXACT], len(d))
                i = at[i]
                apart = self._exact(i, d[j])
                last = self.last[i] if least is None else np.minimum(self.last[i], least[i] + 2e-12)
                keep = (apart < last) | ((apart == last) & (ords[j] < self.last_ord[i]))
                if keep.any():
                    self.waiting.append((i[keep], apart[keep], ords[j[keep]]))
                    self.many += int(keep.sum())
            if self.many > 8 * self.k * len(self.q):
                self.settle()

    def _sifted(self, at: np.ndarray, right: np.ndarray, far: float, least: np.ndarray | None, kind: type) -> np.ndarray:
        """Places in the block ``at`` by ``right`` whose distance may count, by products of the given precision."""
        score = self._left(kind)[at] @ right.T
        squares = self.squares[at]
        length = np.sqrt(squares)
        off = (right.shape[1] + 8) * (np.finfo(kind).eps * (length + far) * far + np.finfo(float).eps * np.sqrt(self.centre @ self.centre) * (length + far))
        last = (self.last[at] if least is None else np.minimum(self.last[at], least[at])) + 2e-12  # rounding to 12 digits decides
        with np.errstate(invalid="ignore"):
            bound = ((squares - last * last) / 2 if self.euclid else 1 - last) - off
        if score.shape[1] > self.k and not np.isfinite(last).all():
            own = np.partition(score, score.shape[1] - self.k, axis=1)[:, -self.k].astype(float)
            slack = 2e-12 * (2 * np.sqrt(np.maximum(squares - 2 * own, 0)) + 1) if self.euclid else 2e-12
            bound = np.fmax(bound, own - 2 * off - slack)
        return np.flatnonzero(score >= np.nextafter(bound.astype(kind), kind(-np.inf))[:, None])

    def _exact(self, i: np.ndarray, d: np.ndarray) -> np.ndarray:
        if not self.euclid:
            return np.round(1 - np.einsum("ij,ij->i", self.q[i], d), 12)
        d = self.q[i] - d
        return np.round(np.sqrt(np.einsum("ij,ij->i", d, d)), 12)

    def settle(self) -> None:
        """Take what waits into the ``k`` best of each row."""
        if not self.waiting:
            return
        row, x, o = (np.concatenate(c) for c in zip(*self.waiting, strict=True))
        self.waiting, self.many = [], 0
        order = np.argsort(row, kind="stable")
        row, x, o = row[order], x[order], o[order]
        first = np.searchsorted(row, np.arange(len(self.q) + 1))
        had = self.dist.shape[1]
        more = min(self.k, had + int(np.diff(first).max())) - had
        if more:
            self.dist = np.concatenate([self.dist, np.full((len(self.q), more), np.inf)], 1)
            self.dst = np.concatenate([self.dst, np.zeros((len(self.q), more), np.int64)], 1)
        had, step, most = self.dist.shape[1], max(1, CHUNK // (5 * self.k)), 4 * self.k
        for low in range(0, len(self.q), step):
            here = slice(first[low], first[min(low + step, len(self.q))])
            place = np.arange(here.start, here.stop) - first[row[here]]
            for p in range(0, int(place.max(initial=-1)) + 1, most):
                some = np.flatnonzero((place >= p) & (place < p + most))
                at, col = row[here][some] - low, had + place[some] - p
                dist = np.concatenate([self.dist[low : low + step], np.full((min(step, len(self.q) - low), int(col.max()) + 1 - had), np.inf)], 1)
                dst = np.zeros(dist.shape, np.int64)
                dst[:, :had] = self.dst[low : low + step]
                dist[at, col], dst[at, col] = x[here][some], o[here][some]
                order = np.argsort(dist, axis=1)
                ranked = np.take_along_axis(dist, order, 1)
                tied = np.flatnonzero(((ranked[:, 1:] == ranked[:, :-1]) & np.isfinite(ranked[:, 1:])).any(axis=1))
                order[tied] = np.lexsort((dst[tied], dist[tied]), axis=-1)
                order = order[:, :had]
                self.dist[low : low + step], self.dst[low : low + step] = np.take_along_axis(dist, order, 1), np.take_along_axis(dst, order, 1)
        if had == self.k:
            self.last = self.dist[:, -1].copy()
            self.last_ord = np.where(np.isfinite(self.last), self.dst[:, -1], np.iinfo(np.int64).max)

    def found(self, src: np.ndarray, k: int | None = None, drop_self: bool = False) -> Iterator[pa.RecordBatch]:
        """Batches (src, dst, rank, dist) of all rows, at most ``k`` of each."""
        self.settle()
        step = max(1, OUT // max(1, self.dist.shape[1]))
        for a in range(0, len(src), step):
            s, x, o = src[a : a + step], self.dist[a : a + step], self.dst[a : a + step]
            here = np.isfinite(x)
            if drop_self:
                here &= o != s[:, None]
            rank = np.cumsum(here, axis=1)
            i, j = np.nonzero(here & (rank <= (self.k if k is None else k)))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(s[i]), pa.array(o[i, j]), pa.array(rank[i, j].astype(np.int32)), pa.array(x[i, j])], ["src", "dst", "rank", "dist"])


def nearest(q: np.ndarray, d: np.ndarray, ords: np.ndarray, k: int, metric: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, ords, distances) of each row's k best; ``q`` and ``d`` are unit rows for correlation."""
    best = Closest(q, k, metric)
    best.see(ords, d)
    best.settle()
    for i in range(len(q)):
        many = int(np.isfinite(best.dist[i]).sum())
        if many:
            yield i, best.dst[i, :many], best.dist[i, :many]


def seen(ords: np.ndarray, x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Data rows as the metric compares them: unit rows for correlation, without those of no variance."""
    if metric != "correlation":
        return ords, x
    x = unit(x)
    good = ~np.isnan(x).any(axis=1)
    return (ords, x) if good.all() else (ords[good], x[good])


def knn(query: DataFrame, data: DataFrame | Vectors, k: int, metric: str = "correlation", drop_self: bool = False, eps: float = 0.0, then: tuple[Callable[[pa.RecordBatch], pa.RecordBatch], str] | None = None) -> DataFrame:
    """(src, dst, rank, dist): the ``k`` nearest rows of ``data`` to each row of ``query``, fewer if there are fewer.

    ``drop_self`` leaves out the row with the same ord, whatever its distance. With ``eps`` above 0 the Euclidean distance
    of each rank may be up to 1 + eps times the least one (see ``pivots``, which also has an exact search by cells).
    ``then``, for the exact search, is what is given in place of a batch, which has all neighbours of its rows, and its schema.
    """
    if metric not in ("correlation", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    if k < 1:
        raise ValueError("k must be at least 1")
    if eps:
        if metric != "euclidean":
            raise ValueError("eps holds for the Euclidean distance")
        from .pivots import Index  # which builds on this module

        return Index(data.rows if isinstance(data, Vectors) else data).search(query, k, eps, drop_self)
    data = data if isinstance(data, Vectors) else Vectors(data)
    kk = k + drop_self
    made, schema = then or ((lambda b: b), KNN)
    as_query = unit if metric == "correlation" else lambda x: x

    if data.small:
        sent = data.broadcast()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ords, d = seen(*sent.value, metric)
            for b in batches:
                step = max(1, OUT // max(1, min(kk, len(ords))))
                for a in range(0, b.num_rows, step):
                    part = b.slice(a, step)
                    best = Closest(as_query(matrix(part.column(1))), kk, metric)
                    best.see(ords, d)
                    yield from map(made, best.found(np.asarray(part.column(0), np.int64), k, drop_self))

        return query.select("ord", "v").repartition(query.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip = {}

        def start(src: np.ndarray, x: np.ndarray) -> Closest:
            best = Closest(as_query(x), kk, metric)
            strip[id(best)] = src, best
            return best

        for best, ords, x in met(batches, start):
            best.see(*seen(ords, x, metric))
        for src, best in strip.values():
            yield from map(made, best.found(src, k, drop_self))

    return strips(query, data, kk).mapInArrow(meet, schema)


def distances_to(query: DataFrame, data: DataFrame) -> DataFrame:
    """(src, dst, dist): the whole matrix of correlation distances, a row per pair, in batches of bounded size.

    There are as many rows as pairs; nothing but a strip, a block and a batch is in a task, whatever the sizes.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (src, z), ords, x in met(batches, lambda ords, x: seen(ords, x, "correlation")):
            dst, d = seen(ords, x, "correlation")
            step = max(1, OUT // max(1, len(dst)))
            for a in range(0, len(src) if len(dst) else 0, step):
                part = src[a : a + step]
                dist = np.round(1 - z[a : a + step] @ d.T, 12)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, len(dst))), pa.array(np.tile(dst, len(part))), pa.array(dist.reshape(-1))], ["src", "dst", "dist"])

    return strips(query, Vectors(data), 1).mapInArrow(meet, "src long, dst long, dist double")


def four_way(ref_emb: DataFrame, query_emb: DataFrame, ref_latent: DataFrame, k: int, reference_first: bool = True, query_latent: DataFrame | None = None, eps: float = 0.0) -> DataFrame:
    """Neighbours within and between both sets: kind (rr, qq, rq, qr), src, dst, rank, dist.

    Between the sets Euclidean in the embedding. Within, k + 1 with the row itself: correlation on the latent
    vectors for the reference and Euclidean in the embedding for the query, or the other way round. ``eps`` allows that
    much more than the least distance for the Euclidean ones.
    """
    r, q = Vectors(ref_emb), Vectors(query_emb)
    if reference_first:
        rr, qq = knn(ref_latent, ref_latent, k + 1), knn(query_emb, q, k + 1, "euclidean", eps=eps)
    else:
        rr, qq = knn(ref_emb, r, k + 1, "euclidean", eps=eps), knn(query_latent if query_latent is not None else ref_latent, query_latent if query_latent is not None else ref_latent, k + 1)
    parts = {"rr": rr, "qq": qq, "rq": knn(ref_emb, q, k, "euclidean", eps=eps), "qr": knn(query_emb, r, k, "euclidean", eps=eps)}
    out = None
    for kind, rows in parts.items():
        rows = rows.select(F.lit(kind).alias("kind"), "src", "dst", "rank", "dist")
        out = rows if out is None else out.unionByName(rows)
    return out


def indicator(neighbours: DataFrame, offset_i: int = 0, offset_j: int = 0) -> DataFrame:
    """The neighbour table as coordinates of a sparse 0/1 matrix, rows and columns moved."""
    return neighbours.select((F.col("src") + offset_i).alias("i"), (F.col("dst") + offset_j).alias("j")).distinct()
