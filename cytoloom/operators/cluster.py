"""Clustering: neighbour graphs with modularity communities, density clustering, scans and consensus.

Neighbour search, communities, silhouettes, the density trees of large sets, consensus and its linkage are distributed.
Small graphs and small sets of cells are finished on arrays; the clusters of one density tree are cut in one task, which
refuses more than a stated number of edges.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import discard, kept, settled
from .communities import communities
from .consensus import NoRun, cell_distances, class_distances, consensus_classes, flat_clusters, kept_runs, linked, linked_classes
from .density import list_length, reach_trees
from .embed import embedded_rows, neighbour_embedding
from .knn import BLOCK_BYTES, knn, matrix, unit
from .limits import MOST_CELLS, MOST_REFINED, MOST_TREE, SMALL_EDGES


def knn_edges(cells: DataFrame, k: int = 30) -> DataFrame:
    """(a, b, w) with a < b: correlation neighbours without the cell itself (k counts it); a mutual pair weighs 2."""
    near = knn(cells, cells, k - 1, drop_self=True)
    return near.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("w"))


def louvain(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Community of each of n nodes, from 1 in order of first member; moves are in node order, so results are fixed."""
    member = np.arange(n)
    a, b, w = np.asarray(a), np.asarray(b), np.asarray(w, float)
    total = w.sum()
    size = n
    while total > 0:
        loops = np.zeros(size)
        same = a == b
        np.add.at(loops, a[same], w[same])
        src, dst, ww = np.r_[a[~same], b[~same]], np.r_[b[~same], a[~same]], np.r_[w[~same], w[~same]]
        order = np.argsort(src, kind="stable")
        src, dst, ww = src[order], dst[order], ww[order]
        start = np.searchsorted(src, np.arange(size + 1))
        degree = np.bincount(src, ww, size) + 2 * loops
        com, mass = np.arange(size), degree.copy()
        moved_any = False
        for _ in range(100):
            moved = 0
            for v in range(size):
                at = slice(start[v], start[v + 1])
                if start[v] == start[v + 1]:
                    continue
                links: dict[int, float] = {}
                for c, x in zip(com[dst[at]].tolist(), ww[at].tolist(), strict=True):
                    links[c] = links.get(c, 0.0) + x
                own = com[v]
                mass[own] -= degree[v]
                best, gain = own, links.get(own, 0.0) - mass[own] * degree[v] / (2 * total)
                for c in sorted(links):
                    g = links[c] - mass[c] * degree[v] / (2 * total)
                    if g > gain + 1e-12:
                        best, gain = c, g
                mass[best] += degree[v]
                if best != own:
                    com[v] = best
                    moved += 1
            moved_any |= moved > 0
            if not moved:
                break
        if not moved_any:
            break
        values, com = np.unique(com, return_inverse=True)
        member = com[member]
        a, b = np.minimum(com[a], com[b]), np.maximum(com[a], com[b])
        key, inverse = np.unique(a.astype(np.int64) * len(values) + b, return_inverse=True)
        a, b, w, size = key // len(values), key % len(values), np.bincount(inverse, w), len(values)
    _, first, inverse = np.unique(member, return_index=True, return_inverse=True)
    rank = np.empty(len(first), int)
    rank[np.argsort(first)] = np.arange(1, len(first) + 1)
    return rank[inverse]


def graph_clusters(cells: DataFrame, k: int = 30, small: int = SMALL_EDGES) -> DataFrame:
    """(ord, cluster) of the neighbour graph's communities."""
    return communities(settled(knn_edges(cells, k)), cells, small)


# ------------------------------------------------------------------ density clustering


def distances(x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "correlation":
        z = unit(x)
        return np.maximum(np.round(1 - z @ z.T, 12), 0)
    s = (x * x).sum(axis=1)
    return np.sqrt(np.maximum(s[:, None] + s[None] - 2 * x @ x.T, 0))


def density_tree(dist: np.ndarray, min_samples: int) -> np.ndarray:
    """Edges (a, b, distance) of the minimum spanning tree of mutual reachability, ascending; the core distance counts the cell itself."""
    last = min(min_samples, len(dist)) - 1
    return _prim(lambda now: dist[now], np.partition(dist, last, axis=1)[:, last])


def _prim(row: Callable[[int], np.ndarray], core: np.ndarray) -> np.ndarray:
    """The tree of :func:`density_tree` from each cell's distances, asked for once, and the core distances."""
    n = len(core)
    best, source = np.full(n, np.inf), np.zeros(n, int)
    inside = np.zeros(n, bool)
    now, out = 0, []
    for _ in range(n - 1):
        inside[now] = True
        reach = np.maximum(np.maximum(row(now), core[now]), core)
        better = ~inside & (reach < best)
        best[better], source[better] = reach[better], now
        nxt = int(np.argmin(np.where(inside, np.inf, best)))
        out.append((source[nxt], nxt, best[nxt]))
        now = nxt
    tree = np.array(out).reshape(-1, 3)
    return tree[np.argsort(tree[:, 2], kind="stable")]


def density_tree_of_rows(x: np.ndarray, min_samples: int) -> np.ndarray:
    """As :func:`density_tree` of the rows' correlation distances, of which only a part is there at a time."""
    n, z = len(x), unit(x)
    core = np.zeros(n)
    step, last = max(1, (1 << 21) // max(1, n)), min(min_samples, n) - 1
    for low in range(0, n, step):
        core[low : low + step] = np.partition(np.maximum(np.round(1 - z[low : low + step] @ z.T, 12), 0), last, axis=1)[:, last]
    zt = np.ascontiguousarray(z.T)
    return _prim(lambda now: np.maximum(np.round(1 - z[now] @ zt, 12), 0), core)


def density_clusters(tree: np.ndarray, n: int, min_size: int) -> np.ndarray:
    """Labels by excess of mass over the condensed tree: clusters from 0 in order of first member, noise -1. The root is never chosen."""
    if n < 2:
        return np.full(n, -1)
    left, right, height, size = [-1] * n, [-1] * n, [0.0] * n, [1] * n
    parent, top = list(range(n)), list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, d in tree.tolist():
        a, b = find(int(a)), find(int(b))
        left.append(top[a])
        right.append(top[b])
        height.append(d)
        size.append(size[top[a]] + size[top[b]])
        parent[b] = a
        top[a] = len(left) - 1

    def leaves(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            x = stack.pop()
            if x < n:
                out.append(x)
            else:
                stack += [left[x], right[x]]
        return out

    density = lambda d: 1 / d if d > 0 else 1e12
    born, stable, children, points = [0.0], [0.0], [[]], [[]]
    stack = [(len(left) - 1, 0)]
    while stack:
        node, cluster = stack.pop()
        if node < n:
            points[cluster].append(node)
            continue
        d = density(height[node])
        big = [c for c in (left[node], right[node]) if size[c] >= min_size]
        if len(big) == 2:
            stable[cluster] += (d - born[cluster]) * size[node]
            for c in big:
                born.append(d)
                stable.append(0.0)
                children.append([])
                points.append([])
                children[cluster].append(len(born) - 1)
                stack.append((c, len(born) - 1))
        else:
            for c in (left[node], right[node]):
                if c in big:
                    stack.append((c, cluster))
                else:
                    got = leaves(c)
                    stable[cluster] += (d - born[cluster]) * len(got)
                    points[cluster] += got
    chosen = [True] * len(born)
    chosen[0] = False
    for c in range(len(born) - 1, 0, -1):
        below = sum(stable[x] for x in children[c])
        if children[c] and below > stable[c]:
            stable[c], chosen[c] = below, False
        else:
            todo = list(children[c])
            while todo:
                x = todo.pop()
                chosen[x] = False
                todo += children[x]
    label = np.full(n, -1)
    for c in range(1, len(born)):
        if chosen[c]:
            todo = [c]
            while todo:
                x = todo.pop()
                label[points[x]] = c
                todo += children[x]
    used, first, inverse = np.unique(label, return_index=True, return_inverse=True)
    rank = np.full(len(used), -1)
    real = np.flatnonzero(used >= 0)
    rank[real[np.argsort(first[real])]] = np.arange(len(real))
    return rank[inverse]


def density_grid(cells: DataFrame, min_sizes: Sequence[int], min_samples: Sequence[int], metric: str = "correlation", most: int = MOST_CELLS) -> DataFrame:
    """(run, min_samples, min_cluster_size, ord, label), min_samples in the outer loop; cells without distances are noise.

    Up to ``most`` cells one task makes a tree of all distances, trees of different min_samples in parallel. Beyond, the
    trees are made by :func:`~cytoloom.operators.density.reach_trees` together and only their edges meet in one task each, at most MOST_TREE.
    """
    spark = cells.sparkSession
    n = cells.count()
    schema = "run int, min_samples int, min_cluster_size int, ord long, label int"
    if n > most:
        near = kept(knn(cells, cells, list_length(min_samples), metric, drop_self=True).withColumn("dist", F.greatest("dist", F.lit(0.0))), "near")
        trees = reach_trees(cells, min_samples, metric, near)
        discard(near)

        def cut(pdf: pd.DataFrame) -> pd.DataFrame:
            if len(pdf) > MOST_TREE:
                raise ValueError(f"a tree of {len(pdf)} edges; one task takes {MOST_TREE}")
            pdf = pdf.sort_values(["d", "a", "b"])
            ids = np.unique(np.r_[pdf["a"], pdf["b"]])
            tree = np.stack([np.searchsorted(ids, pdf["a"]), np.searchsorted(ids, pdf["b"]), pdf["d"]], 1)
            i = int(pdf["i"].iloc[0])
            samples = int(min_samples[i])
            return pd.concat([pd.DataFrame({"run": i * len(min_sizes) + j, "min_samples": samples, "min_cluster_size": size, "ord": ids, "label": density_clusters(tree, len(ids), size)}) for j, size in enumerate(min_sizes)])

        found = trees.groupBy("i").applyInPandas(cut, schema)
        grid = [(i * len(min_sizes) + j, int(samples), int(size)) for i, samples in enumerate(min_samples) for j, size in enumerate(min_sizes)]
        runs = F.broadcast(spark.createDataFrame(grid, "run int, min_samples int, min_cluster_size int"))  # a row per run
        every = cells.select("ord").join(runs)
        return every.join(found.select("run", "ord", "label"), ["run", "ord"], "left").select("run", "min_samples", "min_cluster_size", "ord", F.coalesce("label", F.lit(-1)).alias("label"))
    got = cells.select("ord", "v").toArrow()  # at most MOST_CELLS rows
    ords = np.asarray(got.column(0), np.int64)
    order = np.argsort(ords)
    data = spark.sparkContext.broadcast((ords[order], matrix(got.column(1).combine_chunks())[order]))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x = data.value
        dist = None
        for pdf in pdfs:
            for i, samples in zip(pdf["i"], pdf["samples"], strict=True):
                dist = distances(x, metric) if dist is None else dist
                tree = density_tree(dist, int(samples))
                for j, size in enumerate(min_sizes):
                    yield pd.DataFrame({"run": i * len(min_sizes) + j, "min_samples": samples, "min_cluster_size": size, "ord": ids, "label": density_clusters(tree, len(ids), size)})

    grid = spark.createDataFrame([(i, int(s)) for i, s in enumerate(min_samples)], "i int, samples int").repartition(len(min_samples), "i")
    return grid.mapInPandas(run, schema)


def silhouettes(cells: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, score): mean silhouette with correlation distance, every label (noise too) a cluster, singletons 0.

    Distances to a cluster need only the sum of its unit vectors. Cells are in blocks with their labels of all runs (``by``):
    a block gives its part of every cluster's sum, a run's sums are put together, and each block meets the runs one after the other.
    """
    by = list(by)
    runs = labels.select(*by).distinct().toArrow().to_pylist() if by else [{}]  # a row per run
    if not runs:
        return labels.select(*by, F.lit(0.0).alias("score")).limit(0)
    schema = ", ".join(["run_ int", *(f"`{f.name}` {f.dataType.simpleString()}" for f in labels.select(*by).schema.fields)])
    keys = F.broadcast(cells.sparkSession.createDataFrame([(i, *(r[c] for c in by)) for i, r in enumerate(runs)], schema))
    plain = dict(labels.dtypes)["label"] in ("tinyint", "smallint", "int", "bigint")
    label = F.col("label").cast("long") if plain else F.xxhash64("label")
    named = labels.join(keys, by) if by else labels.crossJoin(keys)
    of = named.groupBy("ord").agg(F.collect_list(F.struct(F.col("run_").alias("r"), label.alias("l"))).alias("l"))
    n, width = cells.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-n * (8 * (width or 1) + 12 * len(runs)) // (BLOCK_BYTES // 4)), min(2 * cells.sparkSession.sparkContext.defaultParallelism, n // 1000))
    dealt = cells.select("ord", "v").join(of, "ord").select("ord", "v", "l.r", "l.l", F.pmod(F.xxhash64("ord"), F.lit(blocks)).cast("int").alias("block"))

    def pack(t: pa.Table) -> pa.Table:
        """(block, z, many, r, l): unit vectors, how many labels each cell has, their runs and they themselves."""
        z = unit(matrix(t["v"].combine_chunks()))
        order = np.argsort(np.asarray(t["ord"]), kind="stable")
        order = order[~np.isnan(z[order]).any(axis=1)]
        lists = [t[c].combine_chunks().take(pa.array(order)) for c in ("r", "l")]
        many = np.diff(np.asarray(lists[0].offsets)).astype(np.int64)
        flat = [np.asarray(x.flatten()) for x in lists]
        return pa.Table.from_arrays([pa.array([t["block"][0].as_py()], pa.int32()), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (z[order], many, flat[0].astype(np.int32), flat[1]))], ["block", "z", "many", "r", "l"])

    def opened(batch: pa.RecordBatch, row: int, at: int) -> tuple[np.ndarray, ...]:
        """Unit vectors, and run, cell and label of every label in the order of the runs."""
        z, many, r, l = (np.frombuffer(batch.column(at + c)[row].as_buffer(), kind) for c, kind in enumerate(("<f8", "<i8", "<i4", "<i8")))
        order = np.argsort(r, kind="stable")
        return z.reshape(len(many), -1), r[order], np.repeat(np.arange(len(many)), many)[order], l[order]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                z, r, cell, l = opened(batch, row, 1)
                ends = np.searchsorted(r, np.arange(len(runs) + 1))
                for run in np.unique(r):
                    some = slice(ends[run], ends[run + 1])
                    order = np.argsort(l[some], kind="stable")
                    own, first, many = np.unique(l[some][order], return_index=True, return_counts=True)
                    sums = np.add.reduceat(z[cell[some][order]], first)
                    yield pa.RecordBatch.from_arrays([pa.array([int(run)], pa.int32()), batch.column(0).slice(row, 1), *(pa.array([x.tobytes()], pa.binary()) for x in (own, many.astype(np.int64), sums))], ["run_", "block", "l", "n", "s"])

    def added(t: pa.Table) -> pa.Table:
        got = sorted(zip(*(t[c].to_pylist() for c in ("block", "l", "n", "s")), strict=True))
        l, many, sums = (np.concatenate([np.frombuffer(g[i], kind) for g in got]) for i, kind in ((1, "<i8"), (2, "<i8"), (3, "<f8")))
        order = np.argsort(l, kind="stable")
        own, first = np.unique(l[order], return_index=True)
        sums = np.add.reduceat(sums.reshape(len(l), -1)[order], first)
        return pa.Table.from_arrays([pa.array([t["run_"][0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (own, np.add.reduceat(many[order], first), sums))], ["run_", "l", "n", "s"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for row in range(batch.num_rows):
                run = batch.column(1)[row].as_py()
                if run < 0:
                    z, r, cell, l = opened(batch, row, 2)
                    now, ends = batch.column(0)[row].as_py(), np.searchsorted(r, np.arange(len(runs) + 1))
                    continue
                if batch.column(0)[row].as_py() != now or ends[run] == ends[run + 1]:
                    continue
                own, many, sums = (np.frombuffer(batch.column(c)[row].as_buffer(), kind) for c, kind in ((2, "<i8"), (3, "<i8"), (4, "<f8")))
                sums, total = np.ascontiguousarray(sums.reshape(len(own), -1).T), 0.0
                step = max(1, (1 << 20) // len(own))
                for low in range(ends[run], ends[run + 1], step):
                    some = slice(low, min(low + step, ends[run + 1]))
                    near = z[cell[some]] @ sums
                    at, i = np.searchsorted(own, l[some]), np.arange(some.stop - some.start)
                    a = (many[at] - near[i, at]) / np.maximum(many[at] - 1, 1)
                    near = 1 - near / many
                    near[i, at] = np.inf
                    b = near.min(axis=1)
                    most = np.maximum(a, b)
                    told = (many[at] > 1) & np.isfinite(b) & (most != 0)
                    total += float(((b - a)[told] / most[told]).sum())
                yield pa.RecordBatch.from_arrays([pa.array([run], pa.int32()), pa.array([total]), pa.array([int(ends[run + 1] - ends[run])])], ["run_", "total", "n"])

    packed = kept(dealt.groupBy("block").applyInArrow(pack, "block int, z binary, many binary, r binary, l binary"), "labelled")
    sums = kept(packed.mapInArrow(parts, "run_ int, block int, l binary, n binary, s binary").groupBy("run_").applyInArrow(added, "run_ int, l binary, n binary, s binary"), "sums")
    left = packed.select("block", F.lit(-1).alias("run_"), "z", "many", "r", "l")
    right = packed.select("block").crossJoin(F.broadcast(sums.select("run_"))).join(sums, "run_").select("block", "run_", F.col("l").alias("z"), F.col("n").alias("many"), F.col("s").alias("r"), F.lit(None).cast("binary").alias("l"))
    met = left.unionByName(right).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "run_").mapInArrow(judged, "run_ int, total double, n long")
    scores = met.groupBy("run_").agg((F.sum("total") / F.sum("n")).alias("score"))
    if not by:
        return cells.sparkSession.range(1).select(F.lit(0).alias("run_")).join(scores, "run_", "left").select("score")
    return scores.join(keys, "run_").select(*by, "score")


def parameter_scan(cells: DataFrame, min_sizes: Sequence[int] = range(5, 21, 4), min_samples: Sequence[int] = range(10, 41, 3), metric: str = "correlation", space: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Labels of every grid run, and (run, min_samples, min_cluster_size, score).

    Density clustering works in ``space``, an embedding of the cells (by default the cells themselves); silhouettes are
    those of the cells.
    """
    labels = settled(density_grid(cells if space is None else space, min_sizes, min_samples, metric))
    keys = ["run", "min_samples", "min_cluster_size"]
    return labels, settled(silhouettes(cells, labels, keys))


# ------------------------------------------------------------------ consensus


def consensus_distance(labels: DataFrame, scores: DataFrame, cutoff: float | None = None, percentile: float = 95) -> DataFrame:
    """(a, b, d) with a < b for pairs of cells in one cluster of some kept run: 1 - share of kept runs that join them.

    Pairs that are not listed have distance 1. Noise joins nobody. Kept are runs with a score of at least the
    cutoff, by default the given percentile of the scores; raises if none is. There are as many rows as pairs;
    :func:`consensus` needs none.
    """
    return cell_distances(labels, *kept_runs(scores, cutoff, percentile))


def average_linkage(dist: np.ndarray) -> np.ndarray:
    """Merges (a, b, height, size) by unweighted averages, heights ascending, by nearest-neighbour chains."""
    n = len(dist)
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    chain: list[int] = []
    merges = []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            row = np.where(alive, d[chain[-1]], np.inf)
            best = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[best]:
                best = chain[-2]
            if len(chain) > 1 and best == chain[-2]:
                break
            chain.append(best)
        b, a = sorted((chain.pop(), chain.pop()), reverse=True)
        merges.append((a, b, d[a, b]))
        new = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = new, new
        d[a, a] = np.inf
        size[a] += size[b]
        alive[b] = False
    merges.sort(key=lambda m: m[2])
    label = {i: i for i in range(n)}
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    count = {i: 1 for i in range(n)}
    out = []
    for k, (a, b, h) in enumerate(merges):
        a, b = find(a), find(b)
        out.append((label[a], label[b], h, count[a] + count[b]))
        root[b] = a
        count[a] += count[b]
        label[a] = n + k
    return np.array(out, float).reshape(-1, 4)


def inconsistency_cut(tree: np.ndarray, n: int, t: float) -> np.ndarray:
    """Flat clusters from 1: a subtree stays whole if no link in it has an inconsistency coefficient above t.

    The coefficient compares a link's height with the mean of it and its direct child links, in their sample
    deviations; it is 0 where there is no deviation.
    """
    m = len(tree)
    coefficient = np.zeros(m)
    for k in range(m):
        heights = [tree[k, 2]] + [tree[int(c) - n, 2] for c in tree[k, :2] if c >= n]
        if len(heights) > 1:
            sd = float(np.std(heights, ddof=1))
            coefficient[k] = (heights[0] - np.mean(heights)) / sd if sd > 1e-15 else 0.0
    most = coefficient.copy()
    for k in range(m):
        for c in tree[k, :2]:
            if c >= n:
                most[k] = max(most[k], most[int(c) - n])
    label, number = np.zeros(n, int), 0
    stack = [(n + m - 1, 0)] if m else [(0, 0)]
    while stack:
        node, inside = stack.pop()
        if node < n:
            if not inside:
                number += 1
                inside = number
            label[int(node)] = inside
            continue
        if not inside and most[int(node) - n] <= t:
            number += 1
            inside = number
        stack += [(int(tree[int(node) - n, 1]), inside), (int(tree[int(node) - n, 0]), inside)]
    return label


def relabel(labels: DataFrame, legacy: bool = False) -> DataFrame:
    """Sorted labels become 1, 2, ...; -1 stays. With ``legacy`` the smallest label becomes -1 even if it is a cluster."""
    values = labels.select("label").distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("label")
    if legacy:
        new = values.select("label", F.row_number().over(w).alias("r")).select("label", F.when(F.col("r") == 1, -1).otherwise(F.col("r") - 1).cast("int").alias("cluster"))
    else:
        real = values.where("label <> -1").select("label", F.row_number().over(w).cast("int").alias("cluster"))
        new = real.unionByName(values.where("label = -1").select("label", F.lit(-1).cast("int").alias("cluster")))
    return labels.join(F.broadcast(new), "label").select("ord", "cluster")  # a row per cluster


def consensus_clusters(cells: DataFrame, pairs: DataFrame, inconsistent: float = 0.3, min_size: int = 10, legacy: bool = False) -> DataFrame:
    """(ord, cluster): average linkage of the consensus distances of cells, cut by inconsistency, small clusters -1."""
    nodes = settled(cells.select(F.col("ord").alias("node"), F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("own")))
    return relabel(settled(flat_clusters(nodes, linked(nodes, pairs, inconsistent), nodes.select(F.col("node").alias("ord"), "node"), min_size)), legacy)


def consensus(labels: DataFrame, scores: DataFrame, cutoff: float | None = None, percentile: float = 95, inconsistent: float = 0.3, min_size: int = 10, legacy: bool = False, none: str = "raise") -> DataFrame:
    """(ord, cluster) of every cell of the kept runs: as :func:`consensus_clusters`, between classes of cells that all runs treat alike.

    Where no run reaches the cutoff this raises, or with ``none="noise"`` warns and gives every cell -1: no run joins any.
    """
    try:
        runs, many = kept_runs(scores, cutoff, percentile)
    except NoRun as e:
        if none != "noise":
            raise
        warnings.warn(f"{e}: no cell is in a cluster", stacklevel=2)
        return labels.select("ord").distinct().select("ord", F.lit(-1).cast("int").alias("cluster"))
    members, classes = consensus_classes(labels, runs, many)
    return relabel(settled(flat_clusters(classes, linked_classes(classes, many, inconsistent), members, min_size)), legacy)


def best_run(labels: DataFrame, scores: DataFrame) -> DataFrame:
    """(ord, cluster) of the run with the largest score, the first on ties."""
    top = scores.orderBy(F.desc("score"), "run").limit(1).select("run")
    return labels.join(F.broadcast(top), "run").select("ord", F.col("label").alias("cluster"))


def refined_clusters(cells: DataFrame, clusters: DataFrame, min_samples: int = 5, components: int = 4, k: int = 20, most: int = MOST_REFINED) -> DataFrame:
    """(ord, cluster): inside each cluster, cells that density clustering of the cluster's embedding leaves as noise become -1.

    A cluster of up to ``most`` cells is one task, whose memory grows with its cells and not with their pairs. Larger ones,
    of which there are few, go one after the other through the layout in blocks and the trees in rounds.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        x = embedded_rows(np.array(pdf["v"].tolist()), components, k)
        label = density_clusters(density_tree_of_rows(x, min_samples), len(x), max(round(len(x) / 10), 2))
        return pd.DataFrame({"ord": pdf["ord"], "cluster": np.where(label < 0, -1, key[0]).astype("int32")})

    rows = cells.select("ord", "v").join(clusters.select("ord", "cluster"), "ord")
    large = {r["cluster"]: r["count"] for r in rows.groupBy("cluster").count().where(F.col("count") > most).collect()}
    out = rows.where(~F.col("cluster").isin(list(large))) if large else rows
    out = out.groupBy("cluster").applyInPandas(run, "ord long, cluster int")
    for name, n in sorted(large.items()):
        own = settled(rows.where(F.col("cluster") == name).select("ord", "v"))
        space = settled(neighbour_embedding(own, components, k, negatives=5, most=most))
        label = density_grid(space, [max(round(n / 10), 2)], [min_samples], most=most).where("label >= 0").select("ord", F.lit(name).cast("int").alias("cluster"))
        out = out.unionByName(own.select("ord").join(label, "ord", "left").select("ord", F.coalesce("cluster", F.lit(-1)).alias("cluster")))
    return out


def without_noise(clusters: DataFrame) -> DataFrame:
    """Rows of cells that belong to a cluster."""
    return clusters.where("cluster <> -1")
