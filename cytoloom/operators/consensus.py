"""Consensus of clustering runs: classes of cells that all runs treat alike, and average linkage of classes in rounds.

Cells with one label in every run, noise included, are one class with a size; distances are between classes. Average
linkage only needs the sum of similarities between two clusters, and sums of merged clusters add, so pairs that no run
joins (similarity 0) are never listed; between classes none is, as the counts of their labels give the sums. It is reducible: two clusters that are each other's nearest stay so whatever
else merges, so each round merges all such pairs at once. The cut needs of a cluster its last height and the largest
inconsistency inside, so it is decided as clusters merge, without the tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, kept
from .knn import BLOCK_BYTES
from .limits import SMALL_EDGES

#: Classes of one label that meet in one task, also clusters that are compared together, and labels of theirs.
MEET, COLUMNS = 1000, 2048
ROUNDS = 10_000


class NoRun(ValueError):
    """No run has the score that a consensus asks for."""


def kept_runs(scores: DataFrame, cutoff: float | None = None, percentile: float = 95) -> tuple[DataFrame, int]:
    """Runs with a score of at least the cutoff, by default that percentile of the scores, and their number; raises if none is."""
    if cutoff is None:
        cutoff = scores.agg(F.percentile("score", F.lit(percentile / 100))).first()[0]  # a row per run
    runs = scores.where(F.col("score") >= F.lit(cutoff)).select("run")
    many = runs.count()
    if not many:
        raise NoRun("no run reaches the silhouette cutoff")
    return runs, many


def consensus_classes(labels: DataFrame, runs: DataFrame, many: int) -> tuple[DataFrame, DataFrame]:
    """Members (ord, node) and classes (node, size, own, labels): ``node`` is the smallest ord of cells that ``runs`` treat
    alike, ``own`` the share of runs in which they are no noise, which is their similarity among themselves."""
    each = labels.join(F.broadcast(runs), "run").groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("run", "label"))).alias("labels"))  # a row per run
    each = kept(each, "vectors")
    classes = each.groupBy("labels").agg(F.min("ord").alias("node"), F.count("*").alias("size"))
    classes = kept(classes.withColumn("key", F.xxhash64("labels")), "classes")
    members = kept(each.join(classes.select("labels", "node"), "labels").select("ord", "node"), "members")
    discard(each)
    real = F.filter("labels", lambda x: x["label"] != -1)
    return members, classes.select("node", "size", (F.size(real) / many).alias("own"), real.alias("labels"))


def class_distances(classes: DataFrame, many: int) -> DataFrame:
    """(a, b, d) with a < b for classes that some run joins: 1 - share of the runs that do. Labels of many classes are split."""
    rows = classes.select("node", F.explode("labels").alias("l")).select("node", "l.run", "l.label")
    size = rows.groupBy("run", "label").agg(F.ceil(F.count("*") / MEET).cast("int").alias("salts"))
    rows = kept(rows.join(size, ["run", "label"]), "class-labels")
    left = rows.select("run", "label", F.col("node").alias("a"), F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"))
    right = rows.select("run", "label", F.col("node").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    pairs = left.join(right, ["run", "label", "salt"]).where("a < b")
    return pairs.groupBy("a", "b").agg((1 - F.count("*") / many).alias("d"))


def cell_distances(labels: DataFrame, runs: DataFrame, many: int) -> DataFrame:
    """(a, b, d) with a < b for pairs of cells that some of ``runs`` joins: blocks of cells meet in tasks that give the pairs in
    bounded batches. There are as many rows as such pairs; they are neither joined nor shuffled."""
    rows = labels.join(F.broadcast(runs), "run").where("label <> -1")  # a row per run
    entries = kept(rows.select(F.col("ord").alias("id"), F.xxhash64("run", "label").alias("col"), F.lit(1).cast("long").alias("n")), "entries")
    left, parallel = entries.count(), 2 * labels.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-left * 16 // (BLOCK_BYTES // 4)), min(parallel, left // MEET))
    packed = kept(_profiles(entries, entries.select("id").distinct().withColumn("size", F.lit(1).cast("long")), blocks), "profiles")
    discard(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip = []
        for batch in batches:
            for row in range(batch.num_rows):
                own, at = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                if at < 0:
                    strip = list(_tiles(_opened(batch, row)))
                    continue
                for d in _tiles(_opened(batch, row)):
                    for q in strip:
                        joint = _joint(q, d)
                        if own == at:  # each pair once
                            joint[q[0][:, None] >= d[0]] = 0
                        i, j = np.nonzero(joint)
                        x, y = q[0][i], d[0][j]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(1 - joint[i, j] / many)], ["a", "b", "d"])

    first = packed.select(F.col("block").alias("q"), F.lit(-1).alias("d"), "ids", "size", "many", "col", "times")
    right = packed.select(F.col("block").alias("q")).crossJoin(packed.select(F.col("block").alias("d"), "ids", "size", "many", "col", "times"))  # a few dozen blocks
    # Of two blocks one meets the other: as many others for each.
    ahead = F.pmod(F.col("d") - F.col("q"), F.lit(blocks))
    right = right.where((2 * ahead < blocks) | ((2 * ahead == blocks) & (F.col("q") < F.col("d"))))
    return first.unionByName(right).repartitionById(blocks, F.col("q")).sortWithinPartitions("q", "d").mapInArrow(run, "a long, b long, d double")


def _inconsistency(height: Column, first: Column, second: Column) -> Column:
    """A link's coefficient from its height and those of its child links, null where a child is no link; 0 without deviation."""
    heights = F.filter(F.array(height, first, second), lambda h: h.isNotNull())
    n, total = F.size(heights), F.aggregate(heights, F.lit(0.0), lambda a, h: a + h)
    mean = total / n
    sd = F.sqrt(F.try_divide(F.aggregate(heights, F.lit(0.0), lambda a, h: a + (h - mean) * (h - mean)), n - 1))
    return F.when(sd > 1e-15, (height - mean) / sd).otherwise(0.0)


def _finished(sums: list[tuple], state: dict[int, tuple], bound: float) -> tuple[dict[int, tuple[int, int | None]], list[tuple]]:
    """The same rounds on plain values: (last cluster, flat) of each cluster, and the last clusters' states (id, size, top, most)."""

    def coefficient(*heights: float | None) -> float:
        h = [x for x in heights if x is not None]
        mean = sum(h) / len(h)
        sd = math.sqrt(sum((x - mean) ** 2 for x in h) / (len(h) - 1)) if len(h) > 1 else 0.0
        return (h[0] - mean) / sd if sd > 1e-15 else 0.0

    near = {(a, b): x for a, b, x in sums}
    parts, flat = {i: [i] for i in state}, dict.fromkeys(state)
    while near:
        best: dict[int, tuple] = {}
        for (a, b), x in near.items():
            e = (round(1 - x / (state[a][0] * state[b][0]), 12), a, b)
            for i in (a, b):
                if i not in best or e < best[i]:
                    best[i] = e
        new = {}
        for d, a, b in {e for e in best.values() if best[e[1]] == e == best[e[2]]}:
            most = max(coefficient(d, state[a][1], state[b][1]), state[a][2], state[b][2])
            for i in (a, b):
                if most > bound >= state[i][2]:
                    flat.update((p, i) for p in parts[i])
            parts[a] += parts.pop(b)
            state[a] = (state[a][0] + state.pop(b)[0], d, most)
            new[b] = a
        old, near = near, {}
        for (a, b), x in old.items():
            a, b = new.get(a, a), new.get(b, b)
            if a != b:
                key = (min(a, b), max(a, b))
                near[key] = near.get(key, 0.0) + x
    return {p: (i, flat[p]) for i, ps in parts.items() for p in ps}, [(i, *x) for i, x in state.items()]


def _begun(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters (id, size, top, most) and members (node, id, flat) before any merge."""
    state = kept(nodes.select(F.col("node").alias("id"), "size", F.when(F.col("size") != 1, 1 - F.col("own")).alias("top"), F.lit(0.0).alias("most")), "clusters")
    return state, kept(nodes.select("node", F.col("node").alias("id"), F.lit(None).cast("long").alias("flat")), "flat")


def _merged(both: DataFrame, state: DataFrame, member: DataFrame, inconsistent: float) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """State, members and (id, new) of the clusters that merge by the pairs ``both`` (d, a, b); None if there are none."""
    c = lambda name: state.select(F.col("id").alias(name), F.col("size").alias(f"{name}_size"), F.col("top").alias(f"{name}_top"), F.col("most").alias(f"{name}_most"))
    merged = both.join(c("a"), "a").join(c("b"), "b")
    most = F.greatest(_inconsistency(F.col("d"), F.col("a_top"), F.col("b_top")), "a_most", "b_most")
    merged = kept(merged.select("a", "b", "d", (F.col("a_size") + F.col("b_size")).alias("size"), most.alias("most"), "a_most", "b_most"), "merged")
    if merged.isEmpty():
        discard(merged)
        return None
    ends = kept(merged.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("a_most").alias("before")), F.struct(F.col("b").alias("id"), F.col("b_most").alias("before")))).alias("x"), F.col("a").alias("new"), "most").select("x.id", "new", ((F.col("most") > inconsistent) & (F.col("x.before") <= inconsistent)).alias("ends")), "ends")
    new_member = kept(member.join(ends, "id", "left").select("node", F.coalesce("new", "id").alias("id"), F.when(F.col("ends"), F.coalesce("flat", "id")).otherwise(F.col("flat")).alias("flat")), "flat")
    grown = merged.select(F.col("a").alias("id"), "size", F.col("d").alias("top"), "most")
    new_state = kept(state.join(ends.select("id"), "id", "left_anti").unionByName(grown), "clusters")
    discard(merged, member, state)
    return new_state, new_member, ends


def _ended(rows: list[tuple], state: DataFrame, member: DataFrame, inconsistent: float) -> tuple[DataFrame, DataFrame]:
    """State and members after the rest of the rounds on the driver, from the sums of the pairs ``rows`` (a, b, s) that are left."""
    spark = state.sparkSession
    ends = spark.createDataFrame([(i,) for i in sorted({i for a, b, _ in rows for i in (a, b)})], "id long")
    here, last = _finished(rows, {r["id"]: (r["size"], r["top"], r["most"]) for r in state.join(ends, "id").collect()}, inconsistent)
    to = spark.createDataFrame([(i, n, f) for i, (n, f) in here.items()], "id long, new long, ends long")
    member = kept(member.join(to, "id", "left").select("node", F.coalesce("new", "id").alias("id"), F.coalesce("flat", "ends").alias("flat")), "flat")
    return kept(state.join(to.select("id"), "id", "left_anti").unionByName(spark.createDataFrame(last, state.schema)), "clusters"), member


def _apart(state: DataFrame, member: DataFrame, inconsistent: float) -> DataFrame:
    """(node, flat) where the clusters left are at distance 1 from each other: they join the first ones by number while no link exceeds the bound."""
    spark = state.sparkSession
    first = state.orderBy("id").limit(2).collect()
    whole = F.col("most") <= inconsistent
    alone = F.when(whole, F.col("id"))
    rest = state.withColumn("solo", alone)
    if len(first) == 2:
        lit = lambda x: F.lit(x).cast("double")
        head = spark.range(1).select(F.greatest(_inconsistency(F.lit(1.0), lit(first[0]["top"]), lit(first[1]["top"])), lit(first[0]["most"]), lit(first[1]["most"])).alias("m")).first()[0]
        if head <= inconsistent:
            bad = F.greatest(_inconsistency(F.lit(1.0), F.lit(1.0), F.col("top")), "most") > inconsistent
            stop = state.where((F.col("id") > first[1]["id"]) & bad).agg(F.min("id")).first()[0]
            rest = state.withColumn("solo", F.when(F.lit(stop is None) | (F.col("id") < F.lit(stop)), F.lit(first[0]["id"])).otherwise(alone))
    return member.join(rest.select("id", "solo"), "id").select("node", F.coalesce("flat", "solo").alias("flat"))


def linked(nodes: DataFrame, pairs: DataFrame, inconsistent: float, small: int = SMALL_EDGES) -> DataFrame:
    """(node, flat) of ``nodes`` (node, size, own): average linkage of ``pairs`` (a, b, d), cut where a link's coefficient exceeds ``inconsistent``.

    Distances between nodes are averages over their cells; pairs that are not listed have distance 1, cells of one node
    1 - own. ``flat`` is the smallest node of the flat cluster: a cluster stays whole if no link in it exceeds the bound.
    Ties go to the smaller pair. Once at most ``small`` pairs are left they are finished on the driver, by the same rounds
    on plain values. What is left without listed pairs merges at distance 1 one after the other by number.
    """
    state, member = _begun(nodes)
    s = lambda name: nodes.select(F.col("node").alias(name), F.col("size").alias(f"{name}_size"))
    sums = kept(pairs.where("d < 1").join(s("a"), "a").join(s("b"), "b").select("a", "b", ((1 - F.col("d")) * F.col("a_size") * F.col("b_size")).alias("s")), "sums")
    for _ in range(ROUNDS):
        s = lambda name: state.select(F.col("id").alias(name), F.col("size").alias(f"{name}_size"))  # noqa: E731, B023
        if sums.count() <= small:
            rows = [tuple(r) for r in sums.collect()]  # at most ``small``
            if rows:
                state, member = _ended(rows, state, member, inconsistent)
            break
        far = sums.join(s("a"), "a").join(s("b"), "b").select(F.round(1 - F.col("s") / (F.col("a_size") * F.col("b_size")), 12).alias("d"), "a", "b")
        best = far.select(F.explode(F.array("a", "b")).alias("id"), F.struct("d", "a", "b").alias("e")).groupBy("id").agg(F.min("e").alias("e"))
        both = best.groupBy("e").agg(F.count("*").alias("n")).where("n = 2").select("e.d", "e.a", "e.b")
        got = _merged(both, state, member, inconsistent)
        if got is None:
            break
        state, member, ends = got
        to = lambda name: ends.select(F.col("id").alias(name), F.col("new").alias(f"{name}_new"))  # noqa: E731, B023
        moved = sums.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_new", "a").alias("x"), F.coalesce("b_new", "b").alias("y"), "s").where("x <> y")
        new_sums = kept(moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("s").alias("s")), "sums")
        discard(ends, sums)
        sums = new_sums
    else:
        raise RuntimeError(f"linkage did not end in {ROUNDS} rounds")
    return _apart(state, member, inconsistent)


def _profiles(entries: DataFrame, state: DataFrame, blocks: int) -> DataFrame:
    """(block, n, ids, size, many, col, times): the clusters of each block, ascending, with how many of their cells have each label."""

    def pack(t: pa.Table) -> pa.Table:
        ids, col = np.asarray(t["id"], np.int64), np.asarray(t["col"], np.int64)
        order = np.lexsort((col, ids))
        own, first, many = np.unique(ids[order], return_index=True, return_counts=True)
        parts = own, np.asarray(t["size"], np.int64)[order][first], many.astype(np.int64), col[order], np.asarray(t["n"], np.int64)[order]
        return pa.Table.from_arrays([pa.array([t["block"][0].as_py()], pa.int32()), pa.array([len(own)], pa.int64()), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts)], ["block", "n", "ids", "size", "many", "col", "times"])

    rows = entries.join(state.select("id", "size"), "id").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return rows.groupBy("block").applyInArrow(pack, "block int, n long, ids binary, size binary, many binary, col binary, times binary")


def _opened(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, ...]:
    """Ids, sizes, and cluster's place, label and count of every entry."""
    ids, size, many, col, times = (np.frombuffer(batch.column(c)[row].as_buffer(), "<i8") for c in range(2, 7))
    return ids, size.astype(float), np.repeat(np.arange(len(ids)), many), col, times.astype(float)


def _joint(q: tuple[np.ndarray, ...], d: tuple[np.ndarray, ...]) -> np.ndarray:
    """How many pairs of cells of each two clusters have one label, over all runs: whole numbers, so no order changes them."""
    out = np.zeros((len(q[0]), len(d[0])))
    shared = np.intersect1d(q[3], d[3])
    for low in range(0, len(shared), COLUMNS):
        cols = shared[low : low + COLUMNS]
        sides = []
        for ids, _, place, col, times in (q, d):
            at = np.minimum(np.searchsorted(cols, col), len(cols) - 1)
            hit = cols[at] == col
            side = np.zeros((len(ids), len(cols)))
            side[place[hit], at[hit]] = times[hit]
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _tiles(c: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """At most MEET clusters at a time."""
    for low in range(0, len(c[0]), MEET):
        some = (c[2] >= low) & (c[2] < low + MEET)
        yield c[0][low : low + MEET], c[1][low : low + MEET], c[2][some] - low, c[3][some], c[4][some]


def _nearest(packed: DataFrame, blocks: int, many: int) -> DataFrame:
    """(id, d, a, b): the least (d, a, b) of each cluster that shares a label with another one. Each block meets all of them in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def end() -> Iterator[pa.RecordBatch]:
            for q, (best, other) in zip(now[1], now[2], strict=True):
                some = np.isfinite(best)
                i, j = q[0][some], other[some]
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(best[some]), pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["id", "d", "a", "b"])

        for batch in batches:
            for row in range(batch.num_rows):
                block, at = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                if at < 0:
                    if now is not None:
                        yield from end()
                    strip = list(_tiles(_opened(batch, row)))
                    now = block, strip, [(np.full(len(q[0]), np.inf), np.zeros(len(q[0]), np.int64)) for q in strip]
                    continue
                for d in _tiles(_opened(batch, row)):
                    for q, (best, other) in zip(now[1], now[2], strict=True):
                        joint = _joint(q, d)
                        far = np.where(joint > 0, np.round(1 - joint / many / (q[1][:, None] * d[1]), 12), np.inf)
                        far[q[0][:, None] == d[0]] = np.inf
                        j = far.argmin(axis=1)  # the first of equals, which is the smaller pair
                        x, to = far[np.arange(len(j)), j], d[0][j]
                        nearer = (x < best) | ((x == best) & np.isfinite(x) & (to < other))
                        best[nearer], other[nearer] = x[nearer], to[nearer]
        if now is not None:
            yield from end()

    left = packed.select(F.col("block").alias("q"), F.lit(-1).alias("d"), "ids", "size", "many", "col", "times")
    right = packed.select("block").withColumnRenamed("block", "q").crossJoin(packed.select(F.col("block").alias("d"), "ids", "size", "many", "col", "times"))  # a few dozen blocks
    return left.unionByName(right).repartitionById(blocks, F.col("q")).sortWithinPartitions("q", "d").mapInArrow(run, "id long, d double, a long, b long")


def linked_classes(classes: DataFrame, many: int, inconsistent: float, small: int = SMALL_EDGES) -> DataFrame:
    """As :func:`linked` of the classes' distances, of which no list is made.

    The similarities of two clusters' cells add up to the products of how many cells of each have a label, over all labels
    of the ``many`` runs. So a cluster is its counts by label; these add when clusters merge, and a round compares the
    clusters block by block. No pair is stored, and counts together are never more than classes times runs.
    """
    state, member = _begun(classes.select("node", "size", "own"))
    rows = classes.select(F.col("node").alias("id"), F.col("size").alias("n"), F.explode("labels").alias("l")).select("id", "l.run", "l.label", "n")
    names = rows.select("run", "label").distinct().select("run", "label", F.xxhash64("run", "label").alias("col"))
    if names.count() != names.select("col").distinct().count():
        raise RuntimeError("two labels have one hash")
    entries = kept(rows.select("id", F.xxhash64("run", "label").alias("col"), "n"), "entries")
    for _ in range(ROUNDS):
        left = entries.count()
        parallel = 2 * classes.sparkSession.sparkContext.defaultParallelism
        blocks = max(1, -(-left * 16 // (BLOCK_BYTES // 4)), min(parallel, left // MEET))
        packed = kept(_profiles(entries, state, blocks), "profiles")
        n = packed.agg(F.sum("n")).first()[0] or 0
        if n * (n - 1) // 2 <= small:
            got = [c for b in packed.toArrow().to_batches() for r in range(b.num_rows) for c in [_opened(b, r)]]  # at most some hundred clusters
            discard(packed, entries)
            pairs = []
            for q in got:
                for d in got:
                    i, j = np.nonzero((joint := _joint(q, d)) * (q[0][:, None] < d[0]))
                    pairs += zip(q[0][i].tolist(), d[0][j].tolist(), (joint[i, j] / many).tolist(), strict=True)
            if pairs:
                state, member = _ended(pairs, state, member, inconsistent)
            break
        both = _nearest(packed, blocks, many).groupBy("d", "a", "b").agg(F.count("*").alias("n")).where("n = 2").select("d", "a", "b")
        merged = _merged(both, state, member, inconsistent)
        discard(packed)
        if merged is None:
            discard(entries)
            break
        state, member, ends = merged
        moved = entries.join(ends.select("id", "new"), "id", "left").groupBy(F.coalesce("new", "id").alias("id"), "col").agg(F.sum("n").alias("n"))
        new_entries = kept(moved, "entries")
        discard(ends, entries)
        entries = new_entries
    else:
        raise RuntimeError(f"linkage did not end in {ROUNDS} rounds")
    return _apart(state, member, inconsistent)


def flat_clusters(nodes: DataFrame, linked: DataFrame, members: DataFrame, min_size: int) -> DataFrame:
    """(ord, label): the flat cluster of each cell by ``linked`` (node, flat), -1 in clusters of fewer than ``min_size`` cells."""
    found = kept(linked, "linked")
    large = found.join(nodes.select("node", "size"), "node").groupBy("flat").agg(F.sum("size").alias("n")).where(F.col("n") >= min_size).select("flat", F.col("flat").alias("label"))
    return members.join(found, "node").join(large, "flat", "left").select("ord", F.coalesce("label", F.lit(-1)).alias("label"))
