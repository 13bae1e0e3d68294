"""Communities of a weighted graph by modularity, in rounds over an edge table.

A level starts with every node alone. In a round each node weighs its own community and those of its neighbours by the
gain in modularity, which needs its links to them and their masses: two aggregations and two joins. Then one half of the
nodes, drawn anew by a hash in each round, moves, so that neighbours seldom swap; of two nodes that are each alone only
the one with the larger number moves to the other. A level ends when rounds no longer pay, its best round becomes a
graph of communities, and levels follow until one gains nothing. At last the nodes of the first graph move once more
between the communities found.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.cells import with_ord
from ..sources.scratch import discard, kept
from .limits import SMALL_EDGES

#: A round pays if it adds so much modularity; a level ends after PATIENCE rounds that do not, or ROUNDS.
LEAST_GAIN, PATIENCE, ROUNDS, LEVELS = 1e-4, 3, 24, 12


def modularity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row (edges, communities, modularity) of ``clusters`` (ord, cluster) on undirected ``edges`` (a, b, w).

    Every edge is listed once. Nodes of no cluster count as nodes of one more. Null without edges.
    """
    c = clusters.select("ord", "cluster")
    rows = edges.join(c.select(F.col("ord").alias("a"), F.col("cluster").alias("x")), "a", "left").join(c.select(F.col("ord").alias("b"), F.col("cluster").alias("y")), "b", "left")
    ends = rows.select(F.explode(F.array(F.struct(F.col("x").alias("c")), F.struct(F.col("y").alias("c")))).alias("e"), "w", F.when(F.col("x").eqNullSafe(F.col("y")), F.col("w")).otherwise(0).alias("inside"))
    per = ends.groupBy("e.c").agg(F.sum("w").cast("double").alias("mass"), F.sum("inside").cast("double").alias("inside"))
    total = F.sum("mass")
    return per.agg((total / 2).alias("weight"), F.count("*").alias("communities"), (F.sum("inside") / total - F.sum(F.col("mass") * F.col("mass")) / (total * total)).alias("modularity"))


def _level(links: DataFrame, nodes: DataFrame, double: float) -> tuple[DataFrame, float, bool]:
    """(node, com) of the best round, its modularity, and whether any node moved. ``links`` (src, dst, w) has both
    directions and no loops, ``nodes`` (node, k, com) the start."""
    now = kept(nodes, "moves")
    best, best_q, start_q, poor = now, -1.0, None, 0
    for turn in range(ROUNDS):
        mass = now.groupBy(F.col("com").alias("to")).agg(F.sum("k").alias("mass"), F.count("*").alias("size"))
        reach = links.join(now.select(F.col("node").alias("dst"), F.col("com").alias("to")), "dst").groupBy(F.col("src").alias("node"), "to").agg(F.sum("w").alias("w"))
        own = now.select("node", F.col("com").alias("to"), F.lit(0.0).alias("w"))
        sums = reach.unionByName(own).groupBy("node", "to").agg(F.sum("w").alias("w"))
        seen = sums.join(now, "node").join(mass, "to")
        home = F.col("to") == F.col("com")
        gain = F.round(F.col("w") - (F.col("mass") - F.when(home, F.col("k")).otherwise(0.0)) * F.col("k") / double, 9)
        order = F.struct(gain.alias("gain"), home.alias("home"), (-F.col("to")).alias("least"))
        pick = seen.groupBy("node").agg(
            F.max_by(F.struct("to", "size"), order).alias("best"), F.max(F.when(home, F.col("com"))).alias("com"), F.max("k").alias("k"),
            F.max(F.when(home, F.col("size"))).alias("crowd"), F.max(F.when(home, F.col("w"))).alias("inside"),
        )
        half = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
        swap = (F.col("crowd") == 1) & (F.col("best.size") == 1) & (F.col("best.to") > F.col("com"))
        goes = half & ~swap & (F.col("best.to") != F.col("com"))
        new = kept(pick.select("node", "k", F.when(goes, F.col("best.to")).otherwise(F.col("com")).alias("com"), "inside", ((F.col("best.to") != F.col("com")) & ~swap).alias("wants")), "moves")
        # ``inside`` belongs to the state before the moves: that is the one that is judged.
        inside, wants = new.agg(F.sum("inside"), F.count(F.when(F.col("wants"), 1))).first()
        squares = mass.agg(F.sum(F.col("mass") * F.col("mass"))).first()[0]
        q = (inside or 0.0) / double - (squares or 0.0) / double**2
        start_q = q if start_q is None else start_q
        poor = 0 if q > best_q + LEAST_GAIN else poor + 1
        if q > best_q:
            if best is not now:
                discard(best)
            best, best_q = now, q
        elif now is not best:
            discard(now)
        now = new.select("node", "k", "com")
        now._scratch = new._scratch
        if not wants or poor >= PATIENCE:
            break
    discard(now)
    return best, best_q, best_q > start_q


def communities(edges: DataFrame, nodes: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """(ord, cluster) for every ord of ``nodes``: communities of undirected ``edges`` (a, b, w), from 1 in order of first member.

    A node without edges is alone. Once a level's graph has at most ``small`` edges it is finished on the driver, in
    node order, by :func:`~cytoloom.operators.cluster.louvain`; with 0 every level is made of rounds.
    """
    from .cluster import louvain

    total = edges.agg(F.sum("w")).first()[0] or 0
    member = nodes.select("ord", F.col("ord").alias("node"))
    graph = kept(edges.where("w > 0").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").cast("double").alias("w")), "graph")
    double, finest = 2.0 * float(total), None
    for _ in range(LEVELS if total else 0):
        if graph.count() <= small:
            t = graph.toArrow()  # at most ``small`` rows
            a, b = np.asarray(t["a"], np.int64), np.asarray(t["b"], np.int64)
            ids = np.unique(np.r_[a, b])
            at = np.lexsort((b, a))
            com = louvain(len(ids), np.searchsorted(ids, a[at]), np.searchsorted(ids, b[at]), np.asarray(t["w"], float)[at])
            first = np.zeros(com.max() + 1, np.int64)
            first[com[::-1]] = ids[::-1]
            step = nodes.sparkSession.createDataFrame(list(zip(ids.tolist(), first[com].tolist(), strict=True)), "node long, com long")
            member = kept(member.join(step, "node", "left").select("ord", F.coalesce("com", "node").alias("node")), "members")
            break
        links = kept(graph.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(graph.where("a <> b").select(F.col("b").alias("src"), F.col("a").alias("dst"), "w")), "links")
        ends = graph.select(F.col("a").alias("node"), "w").unionByName(graph.select(F.col("b").alias("node"), "w"))
        alone = ends.groupBy("node").agg(F.sum("w").alias("k")).withColumn("com", F.col("node"))
        if finest is None:
            finest = (links, alone.drop("com"))
        step, _, better = _level(links, alone, double)
        if better:
            name = step.groupBy("com").agg(F.min("node").alias("least"))
            step = kept(step.join(name, "com").select("node", F.col("least").alias("com")), "step")
            member = kept(member.join(step, "node", "left").select("ord", F.coalesce("com", "node").alias("node")), "members")
            x, y = step.select(F.col("node").alias("a"), F.col("com").alias("x")), step.select(F.col("node").alias("b"), F.col("com").alias("y"))
            graph = kept(graph.join(x, "a").join(y, "b").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")), "graph")
        if finest[0] is not links:
            discard(links)
        if not better:
            break
    if finest is not None:  # nodes of the first graph move once more, between the communities found
        start = finest[1].join(member.select("ord", F.col("node").alias("com")), F.col("node") == F.col("ord")).select("node", "k", "com")
        step, _, better = _level(finest[0], start, double)
        if better:
            member = kept(member.select("ord", "node").join(step.select(F.col("node").alias("ord"), "com"), "ord", "left").select("ord", F.coalesce("com", "node").alias("node")), "members")
        discard(finest[0])
    names = with_ord(member.groupBy("node").agg(F.min("ord").alias("first")), "first").select("node", (F.col("ord") + 1).cast("int").alias("cluster"))
    return member.join(names, "node").select("ord", "cluster")
