"""Clusterings made in distributed rounds against array code, brute force and planted groups."""

import functools
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.operators import cluster, communities, consensus, density, embed
from cytoloom.params import Params
from cytoloom.plans import integration
from tests.test_integration_operators import blobs, cells, panels


def parts(labels):
    labels = np.asarray(labels)
    return {frozenset(np.flatnonzero(labels == v).tolist()) for v in set(labels.tolist())}


def agreement(a, b):
    """Adjusted Rand index."""
    table = np.zeros((len(set(a)), len(set(b))))
    np.add.at(table, (np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]), 1)
    two = lambda x: (x * (x - 1) / 2).sum()
    got, rows, columns, n = two(table), two(table.sum(1)), two(table.sum(0)), len(a) * (len(a) - 1) / 2
    return (got - rows * columns / n) / ((rows + columns) / 2 - rows * columns / n)


# ------------------------------------------------------------------ communities


def test_modularity(spark):
    edges = [(0, 1, 1.0), (1, 2, 2.0), (0, 2, 1.0), (3, 4, 3.0), (2, 3, 1.0), (5, 5, 2.0)]
    label = [1, 1, 1, 2, 2, 3]
    got = communities.modularity(spark.createDataFrame(edges, "a long, b long, w double"), spark.createDataFrame(list(enumerate(label)), "ord long, cluster int")).first()
    m = sum(w for *_, w in edges)
    degree = np.zeros(6)
    for a, b, w in edges:
        degree[a] += w
        degree[b] += w
    want = sum(w for a, b, w in edges if label[a] == label[b]) / m - sum((sum(degree[i] for i in range(6) if label[i] == c) / (2 * m)) ** 2 for c in set(label))
    assert abs(got["modularity"] - want) < 1e-12 and got["communities"] == 3 and got["weight"] == m


def test_communities_in_rounds(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([blobs(20, 1), rng.normal(0, 2, (30, 8))])
    c = cells(spark, x)
    edges = cluster.knn_edges(c, 10).cache()
    by_array, by_rounds = communities.communities(edges, c), communities.communities(edges, c, 0)
    q = [communities.modularity(edges, r).first()["modularity"] for r in (by_array, by_rounds)]
    assert q[1] > q[0] - 0.01 * abs(q[0])
    assert by_rounds.count() == 90 and sorted(r[0] for r in by_rounds.select("cluster").distinct().collect()) == list(range(1, by_rounds.select("cluster").distinct().count() + 1))
    assert by_rounds.where("ord = 0").first()["cluster"] == 1


def test_communities_of_odd_graphs(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "ord long")
    none = spark.createDataFrame([], "a long, b long, w double")
    for small in (0, 100):
        assert sorted(map(tuple, communities.communities(none, nodes, small).collect())) == [(i, i + 1) for i in range(4)]
        pair = spark.createDataFrame([(0, 3, 1.0), (0, 3, 1.0), (3, 0, 1.0)], "a long, b long, w double")
        assert sorted(map(tuple, communities.communities(pair, nodes, small).collect())) == [(0, 1), (1, 2), (2, 3), (3, 1)]


# ------------------------------------------------------------------ density


@pytest.mark.parametrize("metric,samples", [("euclidean", 4), ("correlation", 2)])
def test_tree_is_the_array_codes(spark, metric, samples, monkeypatch):
    """Groups far apart, so that lists of four end inside a group and the exact search has to go on."""
    monkeypatch.setattr(density, "LIST", 4)
    monkeypatch.setattr(density, "FOUND", 2)
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, (15, 4)), rng.normal(50, 1, (12, 4)), rng.normal(-70, 1, (9, 4))]
    x[3] = x[4]
    tree = density.reach_tree(cells(spark, x), samples, metric).toPandas()
    want = cluster.density_tree(cluster.distances(x, metric), samples)
    assert len(tree) == len(x) - 1 and (tree["a"] < tree["b"]).all()
    assert np.allclose(np.sort(tree["d"]), want[:, 2], atol=1e-9)
    label = np.arange(len(x))
    for a, b in zip(tree["a"], tree["b"], strict=True):
        assert label[a] != label[b]  # no cycles
        label[label == label[b]] = label[a]


def test_trees_share_their_rounds(spark, monkeypatch):
    """Both trees are the array code's, no list is made twice, and the largest component is not searched."""
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 1, (30, 4)), rng.normal(50, 1, (5, 4))]
    searched, real = [], density._searched
    monkeypatch.setattr(density, "LIST", 4)
    monkeypatch.setattr(density, "FOUND", 1)
    monkeypatch.setattr(density, "_searched", lambda asked, *rest: (searched.append([tuple(r) for r in asked.select("t", "ord", "comp").collect()]), real(asked, *rest))[1])
    trees = density.reach_trees(cells(spark, x), [2, 4], "euclidean").toPandas()
    for i, samples in enumerate([2, 4]):
        assert np.allclose(np.sort(trees["d"][trees["i"] == i]), cluster.density_tree(cluster.distances(x, "euclidean"), samples)[:, 2], atol=1e-9)
    assert searched and len(searched[-1]) <= 2 * 5 and all(ord_ >= 30 for _, ord_, _ in searched[-1])


def test_grid_beyond_one_task(spark):
    x = blobs(14)
    small = cluster.density_grid(cells(spark, x), [3, 5], [3, 4])
    large = cluster.density_grid(cells(spark, x), [3, 5], [3, 4], most=10)
    assert large.schema.names == small.schema.names and large.count() == 4 * 42
    runs = [{r: [y["label"] for y in g.where(F.col("run") == r).orderBy("ord").collect()] for r in range(4)} for g in (small, large)]
    assert all(parts(runs[0][r]) == parts(runs[1][r]) for r in range(4))


def test_tree_of_odd_tables(spark):
    assert density.reach_tree(cells(spark, [[1.0, 2.0, 4.0]]), 3).count() == 0
    empty = spark.createDataFrame([], "ord long, v array<double>")
    assert density.reach_tree(empty, 3).count() == 0
    flat = cells(spark, [[1.0, 1.0, 1.0], [1.0, 2.0, 4.0], [1.0, 2.0, 4.0], [3.0, 1.0, 0.0]])
    assert sorted((r["a"], r["b"]) for r in density.reach_tree(flat, 2).collect()) == [(1, 2), (1, 3)]


def test_refining_needs_no_matrix_of_pairs():
    """A task of 6,000 cells stays well below the 288 MB of their distances; the results are those of the matrices."""
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (6000, 8))
    tracemalloc.start()
    y = embed.embedded_rows(x, 4, 20, epochs=2)
    tree = cluster.density_tree_of_rows(y, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200e6 and len(tree) == 5999
    few = y[:300]
    assert np.allclose(cluster.density_tree_of_rows(few, 5), cluster.density_tree(cluster.distances(few, "correlation"), 5))


def test_clusters_beyond_one_task_are_refined(spark):
    x = blobs(30)
    truth = [i // 30 for i in range(len(x))]
    given = spark.createDataFrame(list(enumerate(truth)), "ord long, cluster int")
    got = cluster.refined_clusters(cells(spark, x), given.where("ord < 50"), most=25).collect()
    assert sorted(r["ord"] for r in got) == list(range(50)) and all(r["cluster"] in (-1, truth[r["ord"]]) for r in got)


# ------------------------------------------------------------------ consensus


def brute_distance(runs, many):
    """runs: labels of each run by cell."""
    out = {}
    for i in range(len(runs[0])):
        for j in range(i + 1, len(runs[0])):
            same = sum(r[i] == r[j] != -1 for r in runs)
            if same:
                out[i, j] = round(1 - same / many, 9)
    return out


def test_consensus_of_classes(spark, monkeypatch):
    monkeypatch.setattr(consensus, "MEET", 3)
    rng = np.random.default_rng(2)
    runs = [(np.arange(40) // (r + 4) % 5 - (rng.random(40) < 0.1)).tolist() for r in range(4)]
    labels = spark.createDataFrame([(r, i, int(v)) for r, run in enumerate(runs) for i, v in enumerate(run)], "run int, ord long, label int")
    scores = spark.createDataFrame([(r, r / 10) for r in range(4)], "run int, score double")
    got = {(r["a"], r["b"]): round(r["d"], 9) for r in cluster.consensus_distance(labels, scores, 0.1).collect()}
    assert got == brute_distance(runs[1:], 3)
    members, classes = consensus.consensus_classes(labels, *consensus.kept_runs(scores, 0.1))
    assert classes.agg(F.sum("size")).first()[0] == 40 and members.count() == 40
    with pytest.raises(ValueError):
        consensus.kept_runs(scores, 5.0)
    for t in (0.3, 0.8):  # the driver's rounds and the distributed ones take ties alike
        pairs = consensus.class_distances(classes, 3)
        a, b = (sorted(map(tuple, consensus.linked(classes, pairs, t, small).collect())) for small in (0, 1000))
        assert a == b


def test_classes_are_linked_without_pairs(spark, monkeypatch):
    """the distances of all pairs of classes were listed and summed in every round. The cut is that of the list."""
    rng = np.random.default_rng(3)
    runs = [(np.arange(36) // (r + 4) % 4 - (rng.random(36) < 0.1)).tolist() for r in range(3)]
    rows = [(r, i, int(v)) for r, run in enumerate(runs) for i, v in enumerate(run)] + [(r, 36 + i, -1) for r in range(3) for i in range(2)]
    labels = spark.createDataFrame(rows, "run int, ord long, label int")
    scores = spark.createDataFrame([(r, 1.0) for r in range(3)], "run int, score double")
    members, classes = consensus.consensus_classes(labels, *consensus.kept_runs(scores, 0.1))
    pairs = consensus.class_distances(classes, 3)
    want = {t: sorted(map(tuple, consensus.linked(classes, pairs, t).collect())) for t in (0.3, 0.8)}
    monkeypatch.setattr(cluster, "class_distances", None)
    assert cluster.consensus(labels, scores, 0.1, inconsistent=0.8, min_size=1).count() == 38
    monkeypatch.setattr(consensus, "MEET", 7)
    monkeypatch.setattr(consensus, "COLUMNS", 4)
    for t, small in ((0.3, 0), (0.8, 100)):
        assert sorted(map(tuple, consensus.linked_classes(classes, 3, t, small).collect())) == want[t], (t, small)
    none = labels.where("label = -1 and ord >= 36")
    assert [r["cluster"] for r in cluster.consensus(none, scores, 0.1, inconsistent=0.8, min_size=3).collect()] == [-1, -1]


def test_cell_pairs_are_not_shuffled(spark, monkeypatch):
    """pairs of classes were summed by key and joined with their cells, twice."""
    monkeypatch.setattr(consensus, "MEET", 5)
    rng = np.random.default_rng(6)
    runs = [(rng.integers(-1, 6, 90)).tolist() for _ in range(3)]
    labels = spark.createDataFrame([(r, i, int(v)) for r, run in enumerate(runs) for i, v in enumerate(run)], "run int, ord long, label int")
    rows = cluster.consensus_distance(labels, spark.createDataFrame([(r, 1.0) for r in range(3)], "run int, score double"), 0.5)
    got = [tuple(r) for r in rows.collect()]
    assert {(a, b): round(d, 9) for a, b, d in got} == brute_distance(runs, 3) and len(got) == len(brute_distance(runs, 3))
    above = rows._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert "Exchange" not in above and "Join" not in above


@pytest.mark.parametrize("small", [0, 10_000])
def test_linkage_is_the_array_codes(spark, small):
    rng = np.random.default_rng(1)
    n = 24 if small == 0 else 500
    d = rng.random((n, n)) * 0.9
    d[rng.random((n, n)) < 0.6] = 1
    d = np.minimum(d, d.T)
    np.fill_diagonal(d, 0)
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(n) for j in range(i + 1, n) if d[i, j] < 1], "a long, b long, d double")
    nodes = spark.range(n).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("own"))
    for t in (0.3, 0.9):
        want = cluster.inconsistency_cut(cluster.average_linkage(d), n, t)
        got = consensus.linked(nodes, pairs, t, small * 100).toPandas().sort_values("node")["flat"].to_numpy()
        assert parts(got) == parts(want)


def test_weighted_classes_merge_as_their_cells(spark):
    """Cells of one class, written out with their distances, are cut as the class is."""
    rng = np.random.default_rng(4)
    size, own = [1, 3, 1, 2, 4, 1, 2], [0.5, 0.95, 1.0, 0.97, 1.0, 0.9, 0.96]
    d = np.maximum(rng.random((7, 7)) * 0.8 + 0.1, 0)
    d = np.maximum(d, d.T)
    who = np.repeat(np.arange(7), size)
    full = d[who][:, who]
    same = who[:, None] == who[None]
    full[same] = (1 - np.array(own))[who].repeat(len(who)).reshape(len(who), -1)[same]
    np.fill_diagonal(full, 0)
    nodes = spark.createDataFrame([(i, size[i], own[i]) for i in range(7)], "node long, size long, own double")
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(7) for j in range(i + 1, 7)], "a long, b long, d double")
    for t in (0.5, 0.8, 2.0):
        want = cluster.inconsistency_cut(cluster.average_linkage(full), len(who), t)
        got = consensus.linked(nodes, pairs, t).toPandas().sort_values("node")["flat"].to_numpy()
        assert parts(got[who]) == parts(want)


# ------------------------------------------------------------------ plans


def test_options_find_planted_groups(spark):
    truth, c = np.repeat([0, 1, 2], 40), cells(spark, blobs())
    few = {"min_sizes": [5, 9], "min_samples": [5, 10]}
    found = [(f"query {o}", integration.cluster_cells(c, o, 12, **(few if o == 2 else {}))) for o in (1, 2, 3, 5)]
    found += [(f"reference {o}", integration.cluster_reference(c, o, **(few if o < 3 else {}))) for o in (2, 3)]
    for name, rows in found:
        got = np.array([r["cluster"] for r in rows.orderBy("ord").collect()])
        real = got != -1
        if name in ("query 1", "query 3"):
            assert agreement(got[real], truth[real]) > 0.9 and (real.all() if name == "query 1" else real.any()), name
        else:  # density may split a group: no cluster mixes two
            assert all(len(set(truth[got == k])) == 1 for k in set(got.tolist()) - {-1}) and real.any(), name


def test_density_options_beyond_one_task(spark, monkeypatch):
    """F8, F9: more cells than one task lays out and clusters raised an error."""
    monkeypatch.setattr(integration, "neighbour_embedding", functools.partial(embed.neighbour_embedding, most=10, epochs=16))
    monkeypatch.setattr(cluster, "density_grid", functools.partial(cluster.density_grid, most=10))
    truth, c = np.repeat([0, 1, 2], 40), cells(spark, blobs())
    for rows in (integration.cluster_cells(c, 5), integration.cluster_reference(c, 3)):
        got = {r["ord"]: r["cluster"] for r in rows.collect()}
        assert sorted(got) == list(range(120))
        got = np.array([got[i] for i in range(120)])
        assert all(len(set(truth[got == k])) == 1 for k in set(got.tolist()) - {-1}) and (got != -1).any()


def test_query_without_structure(spark):
    """a query in which no run of the scan reaches the cutoff ended with an error; it has no clusters."""
    c, few = cells(spark, blobs()), {"min_sizes": [5, 9], "min_samples": [4, 6]}
    with pytest.warns(UserWarning, match="no run reaches"):
        got = integration.cluster_cells(c, 2, p=Params(query_silhouette_cutoff=1.0), **few)
    assert sorted(map(tuple, got.collect())) == [(i, -1) for i in range(120)] and dict(got.dtypes) == {"ord": "bigint", "cluster": "int"}
    with pytest.raises(ValueError, match="no run reaches"):
        integration.cluster_reference(c, 1, p=Params(silhouette_cutoff=1.0), **few)


def test_pipeline_has_its_own_thresholds(spark, monkeypatch):
    seen = {}

    def reference(rows, option=1, p=None, **grid):
        seen.update(option=option, cutoff=p.silhouette_cutoff, size=p.min_cluster_size)
        return rows

    monkeypatch.setattr(integration, "cluster_reference", reference)
    from tests.test_integration_operators import small

    r, _, q, _ = panels(40)
    names = [f"m{i}" for i in range(10)]
    out = integration.pipeline(cells(spark, q), names, cells(spark, r), names, prepared=True, p=small(), option=4, markers=[(0, 0.2)])
    assert not seen and set(x["cluster"] for x in out.query_clusters.collect()) == {-1, 1}
    assert out.reference_clusters is not None and seen == {"option": 1, "cutoff": 0.114, "size": 10}


def test_near_query_keeps_and_drops(spark):
    from cytoloom import catalog

    rows = catalog.QUERIES["near_pipeline"](spark, "/root/testdata/sf0.001").collect()
    kept = [r for r in rows if r["keep"]]
    assert len(kept) >= 100 and len(rows) - len(kept) >= 50
    assert all((r["cluster"] is not None) == r["keep"] for r in rows)


# ------------------------------------------------------------------ layout in blocks


def test_pushes_are_the_layouts():
    rng = np.random.default_rng(0)
    y, o, a, b = rng.normal(size=(2, 5, 3)), rng.normal(size=(2, 7, 3)), 1.6, 0.9
    o[0, 0] = y[0, 0] + 0.02  # near enough to be clipped
    o[1, 1] = y[1, 1]
    d = y[:, :, None] - o[:, None]
    r = (d * d).sum(axis=-1, keepdims=True)
    want = np.clip((2 * b * (r > 0)) / ((0.001 + r) * (1 + a * r**b)) * d, -4, 4).sum(axis=2)
    assert np.allclose(embed.pushes(y, o, a, b), want)


def test_layout_beyond_one_task(spark):
    """more cells than one task lays out raised an error. Groups stay together, whatever the partitions."""
    x = blobs(100)
    got = embed.neighbour_embedding(cells(spark, x), 2, 15, epochs=60, negatives=5, most=10)
    y = {r["ord"]: r["v"] for r in got.collect()}
    again = {r["ord"]: r["v"] for r in embed.neighbour_embedding(cells(spark, x).repartition(5), 2, 15, epochs=60, negatives=5, most=10).collect()}
    assert y == again and len(y) == len(x)

    def apart(y):
        """The share of points whose nearest point is of their group."""
        far = np.linalg.norm(y[:, None] - y[None], axis=2) + 1e9 * np.eye(len(x))
        return (far.argmin(axis=1) // 100 == np.arange(len(x)) // 100).mean()

    whole = {r["ord"]: r["v"] for r in embed.neighbour_embedding(cells(spark, x), 2, 15, epochs=60, negatives=5).collect()}
    blocks, array = (apart(np.array([v[i] for i in range(len(x))])) for v in (y, whole))
    assert blocks > 0.9 and blocks >= array - 0.02, (blocks, array)
