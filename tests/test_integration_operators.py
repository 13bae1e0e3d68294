"""Expected values, hand-made cases, differentials and invariants of the integration operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.operators import anchors as A
from cytoloom.operators import annotate, cca, clean, cluster, correct, gates, knn, transfer
from cytoloom.plans import integration

# A published example, whose row 0 has the neighbours 0, 8, 7, 3, 9.
EXAMPLE = [
    [0.12077515, 0.48107759, 0.87388194, 0.24158751],
    [0.90204987, 0.41464509, 0.52640825, 0.18158962],
    [0.19345103, 0.04797827, 0.38439081, 0.93312622],
    [0.58445907, 0.22734591, 0.9730414, 0.02516982],
    [0.59758854, 0.39400318, 0.84912261, 0.68797172],
    [0.65016248, 0.26449771, 0.46336556, 0.68900643],
    [0.32512395, 0.19546936, 0.04230138, 0.73893109],
    [0.4916712, 0.38076017, 0.95395779, 0.58217801],
    [0.40467036, 0.67843771, 0.90606747, 0.54219517],
    [0.28174246, 0.07971738, 0.89442353, 0.69026102],
]


def cells(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "ord long, v array<double>")


def values(df):
    return np.array([r["v"] for r in df.orderBy("ord").collect()])


def brute(q, d, k, metric):
    out = set()
    for i, a in enumerate(q):
        dist = [(round(1 - np.corrcoef(a, b)[0, 1], 12) if metric == "correlation" else round(float(np.linalg.norm(a - b)), 12), j) for j, b in enumerate(d)]
        out |= {(i, j, r) for r, (_, j) in enumerate(sorted(dist)[:k], 1)}
    return out


def test_correlation_example(spark):
    c = cells(spark, EXAMPLE)
    got = knn.knn(c, c, 5).where("src = 0").orderBy("rank").collect()
    assert [r["dst"] for r in got] == [0, 8, 7, 3, 9]


@pytest.mark.parametrize("metric", ["correlation", "euclidean"])
@pytest.mark.parametrize("block", [1 << 20, 600])
def test_knn_blocks(spark, metric, block):
    rng = np.random.default_rng(1)
    q, d = rng.normal(size=(23, 6)), rng.normal(size=(40, 6))
    d[7] = d[3]
    got = knn.knn(cells(spark, q), knn.Vectors(cells(spark, d), block), 9, metric)
    assert {(r["src"], r["dst"], r["rank"]) for r in got.collect()} == brute(q, d, 9, metric)


def test_copies_do_not_grow_with_small_blocks(spark):
    """blocks of 600 bytes of 3,000 rows were 1,000 a side, each copied 1,000 times."""
    rng = np.random.default_rng(2)
    q, d = cells(spark, rng.normal(size=(300, 6))), cells(spark, rng.normal(size=(3000, 6)))
    rows = knn.strips(q, knn.Vectors(d, 600), 9).groupBy("q").count().collect()
    parallel = 2 * spark.sparkContext.defaultParallelism
    assert len(rows) <= parallel and all(r["count"] <= 1 + parallel for r in rows)
    assert knn.knn(q, knn.Vectors(d, 600), 9).exceptAll(knn.knn(q, d, 9)).count() == 0


def on_disk(spark):
    """Bytes of shuffle files that are there."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))


def test_blocks_are_on_disk_once(spark):
    """every strip had a copy of all data blocks in its shuffle."""
    rng = np.random.default_rng(4)
    q, d = cells(spark, rng.normal(size=(300, 6))), cells(spark, rng.normal(size=(6000, 6)))
    for kk in (1, 9):
        before = on_disk(spark)
        knn.strips(q, knn.Vectors(d, 600), kk).write.format("noop").mode("overwrite").save()
        assert on_disk(spark) - before < 6000 * 6 * 8 / 2


def test_tables_that_are_kept_leave_no_shuffles(spark):
    """F4 to F6: shuffles of tables that were long written stayed until the driver collected its garbage."""
    from cytoloom.sources import scratch

    before = on_disk(spark)
    rows = spark.range(100_000).repartition(3, "id").select("id", F.rand(1).alias("x"))
    table = scratch.kept(rows)
    again = scratch.settled(table.repartition(5, "id"))
    assert on_disk(spark) - before < 10_000
    assert again.count() == table.count() == 100_000 and again.exceptAll(table).count() == 0
    scratch.discard(table)


def test_distance_matrix_ranks_nothing(spark, monkeypatch):
    """the matrix was made of neighbour lists as long as the data side."""
    rng = np.random.default_rng(3)
    q, d = rng.normal(size=(7, 5)), np.r_[rng.normal(size=(30, 5)), np.ones((1, 5))]
    monkeypatch.setattr(knn, "knn", None)
    got = {(r["src"], r["dst"]): r["dist"] for r in knn.distances_to(cells(spark, q), cells(spark, d)).collect()}
    want = 1 - knn.unit(q) @ knn.unit(d[:30]).T
    assert len(got) == 7 * 30 and all(abs(got[i, j] - want[i, j]) < 1e-9 for i in range(7) for j in range(30))
    assert knn.distances_to(cells(spark, q), cells(spark, d).limit(0)).count() == 0


def test_knn_edges_of_input(spark):
    flat = cells(spark, [[1, 1, 1], [1, 2, 3], [3, 2, 1]])
    got = knn.knn(flat, flat, 5).collect()
    assert {r["src"] for r in got} == {1, 2} and {r["dst"] for r in got} == {1, 2}
    assert {(r["src"], r["dst"]) for r in knn.knn(flat, flat, 1, drop_self=True).collect()} == {(1, 2), (2, 1)}
    none = cells(spark, [[0.0]]).limit(0)
    assert knn.knn(none, flat, 2).count() == 0 and knn.knn(flat, none, 2).count() == 0
    with pytest.raises(ValueError):
        knn.knn(flat, flat, 0)


def test_indicator(spark):
    rows = spark.createDataFrame([(i, j, r, 0.0) for i, js in enumerate([(0, 1, 2), (1, 0, 2), (2, 0, 1)]) for r, j in enumerate(js)], knn.KNN)
    for move in (0, 1):
        assert {(r["i"], r["j"]) for r in knn.indicator(rows, 0, move).collect()} == {(i, j + move) for i in range(3) for j in range(3)}


def test_transfer_rows_sum_to_one(spark):
    x = cells(spark, [[1, 2, 3], [10, 9, 7], [1, 2, 4]])
    w = transfer.transfer_weights(x, x, 3, 0.2)
    assert all(abs(r["s"] - 1) < 1e-8 for r in w.groupBy("src").agg(F.sum("w").alias("s")).collect())
    assert transfer.automatic_k(10) == 1 and transfer.automatic_k(999) == 19 and transfer.automatic_k(1000) == 2


def test_transfer_ties_and_mask(spark):
    w = spark.createDataFrame([(0, 0, 0.1, 0.5), (0, 1, 0.1, 0.5), (1, 0, 0.9, 1.0)], "src long, dst long, dist double, w double")
    labels = spark.createDataFrame([(0, 10), (1, 9)], "ord long, label int")
    got = {r["src"]: r["label"] for r in transfer.transfer_labels(w, labels).collect()}
    assert got == {0: "9", 1: "10"}
    masked = transfer.masked_labels(transfer.transfer_labels(w, labels), transfer.query_mask(w))
    assert {r["src"]: r["label"] for r in masked.collect()} == {0: "9", 1: "Not Assigned"}


@pytest.mark.parametrize("block_bytes", [knn.SEND_BYTES, 600])
def test_labels_without_a_row_per_neighbour(spark, monkeypatch, block_bytes):
    """the weights, a row per neighbour and as many as the square of the query's share, were written and shuffled."""
    rng = np.random.default_rng(5)
    q, d = cells(spark, rng.normal(size=(60, 6)).round(1)), cells(spark, rng.normal(size=(200, 6)).round(1))
    labels = spark.createDataFrame([(i, f"t{i % 7}") for i in range(190)] + [(3, "t0"), (5, None)], "ord long, label string")
    w = transfer.transfer_weights(q, d, 20)
    for threshold in (0.5, 0.2):
        want = transfer.masked_labels(transfer.transfer_labels(w, labels), transfer.query_mask(w, threshold)).collect()
        monkeypatch.setattr(knn.Vectors.__init__, "__defaults__", (block_bytes,))
        got = transfer.labelled(q, d, labels, 20, threshold=threshold).collect()
        key = lambda r: (r["src"], r["label"], round(r["mean_dist"], 10), r["keep"])
        assert len(got) == 60 and sorted(map(key, got)) == sorted(map(key, want)) and got[0].asDict().keys() == want[0].asDict().keys()
    means = {r["src"]: r["dist"] for r in transfer.mean_distances(q, d, 20).collect()}
    assert all(abs(r["mean_dist"] - means[r["src"]]) < 1e-12 for r in want)


def test_correction_by_the_anchors_cells(spark):
    """Weights and differences meet by the cell that an anchor stands at, many anchors together: the sums are those of arrays."""
    x = np.random.default_rng(6).normal(size=(200, 100))
    diffs = correct.numbered(spark.createDataFrame([(i % 20, i // 20, r.tolist()) for i, r in enumerate(x)], "cellr long, cellq long, dv array<double>"))
    cell = spark.range(2000).withColumnRenamed("id", "c").withColumn("cellq", F.col("c") % 10)
    w = diffs.select("anchor_id", "cellq").join(cell, "cellq").select(F.col("c").alias("cellq"), "anchor_id", F.lit(0.05).alias("w"))
    got = {r["ord"]: r["v"] for r in correct.corrected(cells(spark, np.zeros((2000, 100))), w, diffs.select("anchor_id", "dv")).collect()}
    assert len(got) == 2000 and all(np.allclose(v, -x.reshape(10, 20, 100)[i % 10].mean(axis=0)) for i, v in got.items())


def test_pipeline_makes_no_weights(spark, monkeypatch):
    """the pipeline wrote a row for each neighbour, only to average their distances for the mask."""
    never = spark.range(1).select(F.raise_error(F.lit("weights were made")).cast("long").alias("src"))
    monkeypatch.setattr(transfer, "transfer_weights", lambda *_: never)
    r, _, q, _ = panels(40)
    names = [f"m{i}" for i in range(10)]
    out = integration.pipeline(cells(spark, q), names, cells(spark, r), names, prepared=True, p=small(), option=4, markers=[(0, 0.2)])
    assert out.mask.count() == 40 and out.query_clusters.count() == out.mask.where("keep").count() > 0


def test_anchor_scores(spark):
    nn = spark.createDataFrame([("rr", 0, 0, 1, 0.0), ("rr", 1, 1, 1, 0.0), ("qq", 0, 0, 1, 0.0), ("qq", 1, 1, 1, 0.0), ("rq", 0, 0, 1, 0.0), ("rq", 1, 1, 1, 0.0), ("qr", 0, 0, 1, 0.0), ("qr", 1, 0, 1, 0.0)], "kind string, src long, dst long, rank int, dist double")
    pairs = A.mutual(nn, 1)
    assert {tuple(r) for r in pairs.collect()} == {(0, 0)}
    counts = A.shared_counts(nn, spark.createDataFrame([(0, 0), (1, 1), (1, 0)], "cellr long, cellq long"), 1)
    assert {tuple(r) for r in counts.collect()} == {(0, 0, 2), (1, 1, 1)}  # (1, 0) shares nothing and goes
    assert {r["score"] for r in A.rescaled(counts.where("shared = 2")).collect()} == {1.0}


def test_filter_rejects(spark):
    ref, q = cells(spark, [[1, 2, 3], [3, 2, 1], [1, 3, 2]]), cells(spark, [[1, 2, 3.1], [3, 2, 1.1]])
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "cellr long, cellq long")
    assert {tuple(r) for r in A.filtered(pairs, ref, q, 1).collect()} == {(0, 0), (1, 1)}


def test_weights(spark):
    rng = np.random.default_rng(3)
    q = cells(spark, rng.normal(size=(12, 5)))
    found = correct.numbered(spark.createDataFrame([(i, i % 12, (i % 5) / 4) for i in range(20)], "cellr long, cellq long, score double"))
    w = correct.anchor_weights(found, q, 6)
    sums = [r["s"] for r in w.groupBy("cellq").agg(F.sum("w").alias("s")).collect()]
    assert all(abs(s - 1) < 1e-9 or math.isnan(s) for s in sums)
    zero = correct.numbered(spark.createDataFrame([(0, 0, 0.0), (1, 1, 0.0)], "cellr long, cellq long, score double"))
    assert all(math.isnan(r["w"]) for r in correct.anchor_weights(zero, q, 2).collect())
    assert correct.anchor_weights(zero, q, 2, zero="keep").count() == 0


def test_degenerate_rows_are_dropped(spark):
    rows = [[-10.0] * 4 + [float(i)] for i in range(3)]  # equal up to scale: all correlations are 1
    found = correct.numbered(spark.createDataFrame([(i, i, 1.0) for i in range(3)], "cellr long, cellq long, score double"))
    w = correct.anchor_weights(found, cells(spark, rows), 2)
    assert w.count() == 3 and all(r["w"] == 1.0 for r in w.collect())  # the k-th anchor alone is moved by delta
    out = correct.corrected(cells(spark, rows), w.withColumn("w", F.lit(float("nan"))), spark.createDataFrame([(r["anchor_id"], [1.0] * 5) for r in found.collect()], "anchor_id long, dv array<double>"))
    assert gates.drop_nan(out).count() == 0


def test_correction_matches_matrix_product(spark):
    rng = np.random.default_rng(4)
    q, r = rng.normal(size=(9, 4)), rng.normal(size=(7, 4))
    found = correct.numbered(spark.createDataFrame([(i % 7, i % 9, 0.2 + i / 40) for i in range(15)], "cellr long, cellq long, score double"))
    w = correct.anchor_weights(found, cells(spark, q), 5)
    d = found.select("anchor_id", "cellr", "cellq").join(correct.differences(found.select("cellr", "cellq"), cells(spark, r), cells(spark, q)), ["cellr", "cellq"])
    want = q.copy()
    at = {x["anchor_id"]: np.array(x["dv"]) for x in d.collect()}
    for x in w.collect():
        want[x["cellq"]] -= x["w"] * at[x["anchor_id"]]
    assert np.allclose(values(correct.corrected(cells(spark, q), w, d.select("anchor_id", "dv"))), want)


def test_cca_matches_svd(spark):
    rng = np.random.default_rng(5)
    r, q = rng.normal(size=(30, 6)), rng.normal(size=(25, 6))
    re, qe, s = cca.cca(cells(spark, r), cells(spark, q), 5)
    u, t, v = np.linalg.svd(cca.standardize_rows(r) @ cca.standardize_rows(q).T)
    sign = np.where(u[0, :5] < 0, -1, 1)
    assert np.allclose(s, t[:5]) and np.allclose(values(re), u[:, :5] * sign, atol=1e-8) and np.allclose(values(qe), v[:5].T * sign, atol=1e-8)
    x = r - r.mean(axis=0)
    _, _, w = np.linalg.svd(x)
    assert np.allclose(np.abs(values(cca.pca(cells(spark, r), 2))), np.abs(x @ w[:2].T), atol=1e-8)


def test_gates(spark):
    rows = spark.createDataFrame([(0, 15.0, 218.0, 9.0), (1, 1.0, 1.0, 6.0), (2, 4000.0, 1.0, 6.0)], "ord long, x double, y double, z double")
    assert tuple(gates.unit_convert(rows).where("ord = 0").first()[1:]) == (2820.0, 40984.0, 8100.0)
    assert gates.border_filter(gates.unit_convert(rows)).count() == 2 and gates.border_filter(rows, 0).count() == 3
    assert gates.common_panel(["b", "x", "a"], ["a", "b"]) == ["b", "a"]
    with pytest.raises(ValueError):
        gates.common_panel(["a"], ["a"])
    spots = spark.createDataFrame([(0, 1000.0, [-1200.0, -2000.0]), (1, 25000.0, [-2000.0, -2000.0]), (2, 999.0, [0.0, 0.0]), (3, 2000.0, [6001.0, 0.0])], "ord long, size double, blanks array<double>")
    assert [r["ord"] for r in gates.blank_size_gate(spots, (1000, 25000), (-1200, -1200), (6000, 2500)).collect()] == [0]
    c = cells(spark, [[5, 1], [4, 9], [5, 8], [1, 7]])
    got = {r["ord"]: r["cluster"] for r in gates.marker_gate(c, [(0, 0.5), ((0, 1), (0.75, 0.5))]).collect()}
    assert got == {0: 1, 1: 2, 2: 2, 3: -1}
    assert gates.take_subset(c, 2).count() == 2 and gates.take_subset(c, -1).count() == 4
    assert {r["ord"] for r in gates.top_k(c.withColumn("g", F.lit(1)).withColumn("x", F.get("v", F.lit(0))), "x", 2, "g").collect()} == {3, 1}


def test_cleaning(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, 3000), rng.normal(8, 1.5, 1500)])
    rows = spark.createDataFrame([("m", float(v)) for v in x], "feature string, value double")
    fit = clean.gaussian_fits(rows).first()
    assert abs(fit["mean"] - 8) < 0.2 and abs(fit["sd"] - 1.5) < 0.15
    n = np.concatenate([rng.negative_binomial(2, 2 / 7, 4000), rng.negative_binomial(8, 8 / 58, 2000)])
    counts = spark.createDataFrame([("m", float(v)) for v in n], "feature string, value double")
    fit = clean.nb_fits(counts).first()
    assert abs(fit["mean"] - 50) < 5 and fit["sse"] < 5e-4
    assert clean.nb_mixture(np.array([r["p"] for r in clean.count_pmf(counts).orderBy("value").collect()]), clean.STARTS[:1])[1] < 1e-2
    scaled = clean.total_normalize(cells(spark, [[1, 3], [0, 0], [2, 2]]))
    assert np.allclose(values(scaled), np.array([[0.25, 0.75], [0, 0], [0.5, 0.5]]) * 8 / 3)
    assert np.allclose(values(clean.reference_normalize(cells(spark, [[1, 3], [0, 0], [2, 2]]))), [[0, 1], [1, 0]])
    counts = np.stack([n[:500], n[-500:]], 1)
    out, fits = clean.clean_reference(cells(spark, counts))
    got = values(out)
    assert got.min() == 0 and got.max() == 1 and fits.count() == 2
    assert clean.clean_query(cells(spark, counts)).count() == 500


def test_reference_cleaning_query_takes_every_feature(spark, tmp_path):
    from cytoloom import catalog

    x = np.random.default_rng(16).normal(0, 0.4, (60, 12))
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["ord"], r["feature"]): r["value"] for r in catalog.QUERIES["negative_binomial_clean"](spark, str(tmp_path)).collect()}
    want = values(clean.clean_reference(cells(spark, np.floor(np.abs(x) * 20)))[0])
    assert set(got) == {(i, j) for i in range(60) for j in range(12)}
    assert np.allclose([[got[i, j] for j in range(12)] for i in range(60)], want, atol=1e-6)


def test_annotation(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "Not Assigned")], "truth string, label string")
    got = {r["type"]: (r["tpr"], r["tnr"]) for r in annotate.rates(rows).collect()}
    assert got["a"] == (0.5, 1.0) and got["b"][0] == 1.0 and abs(got["b"][1] - 2 / 3) < 1e-12 and got["c"] == (0.0, 1.0)
    assert {(r["truth"], r["label"]) for r in annotate.majority(rows, "truth", "label").collect()} == {("a", "a"), ("b", "b"), ("c", "Not Assigned")}
    assert annotate.agreement(rows).where("agree").count() == 2
    names = spark.createDataFrame([(1, "T"), (-1, "x")], "cluster int, name string")
    c = spark.createDataFrame([(0, 1), (1, -1), (2, 5)], "ord long, cluster int")
    assert {r["ord"]: r["name"] for r in annotate.named(c, names).collect()} == {0: "T", 1: "", 2: ""}


# ------------------------------------------------------------------ clustering


def blobs(n=40, seed=7):
    rng = np.random.default_rng(seed)
    centres = np.eye(3, 8) * 6
    return np.concatenate([c + rng.normal(0, 0.5, (n, 8)) for c in centres])


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_louvain(spark):
    truth = np.repeat([0, 1, 2], 40)
    got = cluster.graph_clusters(cells(spark, blobs()), 12).orderBy("ord").collect()
    assert same_partition([r["cluster"] for r in got], truth)
    again = cluster.graph_clusters(cells(spark, blobs()).repartition(5), 12).orderBy("ord").collect()
    assert got == again
    edge = cluster.knn_edges(cells(spark, blobs()), 12)
    assert edge.where("a >= b").count() == 0 and edge.agg(F.sum("w")).first()[0] == 120 * 11


def test_density(spark):
    truth = np.repeat([0, 1, 2], 40)
    labels, scores = cluster.parameter_scan(cells(spark, blobs()), [5, 10], [4, 6])
    assert scores.count() == 4 and [r["run"] for r in labels.select("run").distinct().orderBy("run").collect()] == [0, 1, 2, 3]
    got = [r["cluster"] for r in cluster.best_run(labels, scores).orderBy("ord").collect()]
    kept = [i for i, c in enumerate(got) if c >= 0]
    assert len(kept) > 100 and same_partition([got[i] for i in kept], truth[kept])
    pairs = cluster.consensus_distance(labels, scores, None, 50)
    final = [r["cluster"] for r in cluster.consensus_clusters(cells(spark, blobs()), pairs, 1.1, 5).orderBy("ord").collect()]
    assert all(len({truth[i] for i, c in enumerate(final) if c == k}) == 1 for k in set(final) - {-1})
    with pytest.raises(ValueError):
        cluster.consensus_distance(labels, scores, 2.0)
    refined = cluster.refined_clusters(cells(spark, blobs()), spark.createDataFrame([(i, int(t)) for i, t in enumerate(truth)], "ord long, cluster int"))
    assert all(r["cluster"] in (-1, truth[r["ord"]]) for r in refined.collect())


def test_neighbour_embedding(spark):
    from cytoloom.operators import embed

    a, b = embed.curve(0.1)
    assert abs(a - 1.577) < 0.05 and abs(b - 0.895) < 0.03  # the known fit for these settings
    strength = embed.membership(np.sort(np.random.default_rng(0).random((20, 15)), axis=1))
    assert np.allclose(strength.sum(axis=1), np.log2(15), atol=1e-3)
    got = embed.neighbour_embedding(cells(spark, blobs()), 2, 15)
    y, truth = values(got), np.repeat([0, 1, 2], 40)
    d = np.linalg.norm(y[:, None] - y[None], axis=2) + np.eye(120) * 1e9
    assert (truth[d.argmin(axis=1)] == truth).mean() > 0.97
    assert np.array_equal(values(embed.neighbour_embedding(cells(spark, blobs()).repartition(5), 2, 15)), y)


def test_silhouette(spark):
    x, truth = blobs(10), np.repeat([0, 1, 2], 10)
    truth[0] = 9  # a singleton
    d = cluster.distances(x, "correlation")
    want = []
    for i in range(30):
        own = [j for j in range(30) if truth[j] == truth[i] and j != i]
        b = min(d[i, truth == c].mean() for c in set(truth) - {truth[i]})
        want.append((b - d[i, own].mean()) / max(b, d[i, own].mean()) if own else 0.0)
    got = cluster.silhouettes(cells(spark, x), spark.createDataFrame([(i, int(t)) for i, t in enumerate(truth)], "ord long, label int")).first()[0]
    assert abs(got - np.mean(want)) < 1e-9


def test_linkage_and_relabel(spark):
    x = np.array([0.0, 0.1, 0.3, 5.0, 5.2, 9.0])
    tree = cluster.average_linkage(np.abs(x[:, None] - x[None]))
    assert np.allclose(tree[:, 2], [0.1, 0.2, 0.25, 3.9, 6.4 - 0.4 / 3]) and tree[-1, 3] == 6
    assert len(set(cluster.inconsistency_cut(tree, 6, 10))) == 1
    label = cluster.inconsistency_cut(tree, 6, 0.8)
    assert label[0] == label[1] and label[3] == label[4] and label[0] != label[3]
    rows = spark.createDataFrame([(0, 3), (1, 7), (2, 3)], "ord long, label int")
    assert {r["ord"]: r["cluster"] for r in cluster.relabel(rows).collect()} == {0: 1, 1: 2, 2: 1}
    assert {r["ord"]: r["cluster"] for r in cluster.relabel(rows, legacy=True).collect()} == {0: -1, 1: 1, 2: -1}


# ------------------------------------------------------------------ whole


def panels(n=60, seed=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 2, (3, 10))
    kind = rng.integers(0, 3, (2, n))
    shift = rng.normal(0, 0.5, 10)
    return centres[kind[0]] + rng.normal(0, 0.3, (n, 10)), kind[0], centres[kind[1]] + shift + rng.normal(0, 0.3, (n, 10)), kind[1]


def small():
    from cytoloom.params import Params

    return Params(k_find_nn=20, k_find_anchor=5, k_filter_anchor=20, k_score_anchor=10, k_find_weights=15)


def test_integration(spark):
    r, rk, q, qk = panels()
    ref, query = cells(spark, r), cells(spark, q)
    labels = spark.createDataFrame([(i, f"type{k}") for i, k in enumerate(rk)], "ord long, label string")
    got = integration.integrate(query, ref, labels, p=small(), k=5).collect()
    right = [r["label"] == f"type{qk[r['src']]}" for r in got if r["keep"]]
    assert len(right) > 50 and np.mean(right) > 0.95
    again = integration.integrate(query.repartition(7), ref.repartition(3), labels, p=small(), k=5).collect()
    assert sorted((x["src"], x["label"]) for x in again) == sorted((x["src"], x["label"]) for x in got)


def test_pipeline(spark):
    r, _, q, _ = panels(80)
    to = lambda x: np.floor(np.abs(x) * 8)
    query = cells(spark, to(q)).withColumn("blanks", F.array(*[F.lit(0.0)] * 4)).withColumn("size", F.lit(2000.0))
    names = [f"m{i}" for i in range(10)]
    out = integration.pipeline(query, names, cells(spark, to(r)), names[::-1], p=small())
    kept = out.mask.where("keep").count()
    assert 0 < out.corrected.count() <= 80 and out.query_clusters.count() == out.kept.count() == kept
    assert {name: t.count() for name, t in out.tables.items() if name != "weights"} == dict.fromkeys(("query", "cleaned", "panel"), kept)
    moved = {r["ord"]: r["v"] for r in out.corrected.collect()}
    assert all(r["v"] == moved[r["ord"]] for r in out.kept.collect())  # the corrected cells are clustered
    prepared = integration.pipeline(cells(spark, q), names, cells(spark, r), names, amount_query=60, prepared=True, p=small())
    assert prepared.corrected.count() <= 60
    few = {"min_sizes": [5, 9], "min_samples": [5, 10]}
    for option in (1, 2, 3, 5):
        assert integration.cluster_cells(cells(spark, blobs()), option, 12, **(few if option == 2 else {})).count() == 120
    for option in (1, 2, 3):
        assert integration.cluster_reference(cells(spark, blobs()), option, **(few if option < 3 else {})).count() == 120
    with pytest.raises(ValueError):
        integration.cluster_cells(cells(spark, r), 9)


def test_files(spark, tmp_path):
    from cytoloom.sources import cells as S

    def csv(name, head, rows):
        (tmp_path / name).write_text("\n".join([",".join(["", *head]), *(",".join(map(str, r)) for r in rows)]) + "\n")
        return str(tmp_path / name)

    n = 6
    protein = csv("p.csv", ["CD16.32", "B220"], [(f"c{i}", i, 2 * i) for i in range(n)])
    blanks = csv("b.csv", ["b1"], [(f"c{i}", -i) for i in range(n)])
    size = csv("s.csv", ["x"], [(f"c{i}", 1000 + i) for i in range(n)])
    spatial = csv("xy.csv", ["x", "y", "z"], [(f"c{i}", 10 + 600 * i, 5, 7) for i in range(n)])
    c, panel = S.read_cells(spark, protein)
    assert panel == ["CD16.32", "B220"] and [(r["ord"], r["cell_id"], r["v"]) for r in c.orderBy("ord").collect()] == [(i, f"c{i}", [i, 2 * i]) for i in range(n)]
    assert S.read_cells(spark, protein, ["B220"])[0].orderBy("ord").collect()[3]["v"] == [6.0]
    q, _ = S.read_query(spark, blanks, protein, size, spatial, convert=True)
    assert sorted(r["cell_id"] for r in q.collect()) == [f"c{i}" for i in range(5)]  # x = 1 + 600 i voxels; the sixth is beyond
    assert set(S.read_reference(spark, protein, protein, protein)) == {"latent", "protein", "mrna"}
    (tmp_path / "names.txt").write_text("T cells: 1\nB2 cells: 3, 12\n")
    assert {tuple(r) for r in S.read_cluster_names(spark, str(tmp_path / "names.txt")).collect()} == {(1, "T cells"), (3, "B2 cells"), (12, "B2 cells")}
    assert S.read_labels(spark, size).count() == n
    S.write_wide(c, panel, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["cell_id", *panel]
    wide = spark.createDataFrame([("b", 2.0), ("a", 1.0)], "id string, f double")
    assert [(r["ord"], r["cell_id"]) for r in S.from_wide(wide, "id", ["f"]).orderBy("ord").collect()] == [(0, "b"), (1, "a")]  # the table's order
    numbered = S.with_ord(spark.range(1000).repartition(7), "id").collect()
    assert sorted((r["ord"], r["id"]) for r in numbered) == [(i, i) for i in range(1000)]


def test_stream(spark, tmp_path):
    from cytoloom.streaming.score import score_stream

    r, rk, q, _ = panels(30)
    ref = cells(spark, r)
    labels = spark.createDataFrame([(i, f"type{k}") for i, k in enumerate(rk)], "ord long, label string")
    cells(spark, q).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ord long, v array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = score_stream(stream, ref, labels, 5).writeStream.format("memory").queryName("scored").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    w = transfer.transfer_weights(cells(spark, q), ref, 5)
    want = transfer.masked_labels(transfer.transfer_labels(w, labels), transfer.query_mask(w))
    assert {(x["ord"], x["label"]) for x in spark.table("scored").collect()} == {(x["src"], x["label"]) for x in want.collect()}


def test_anchor_weights_search_cells_not_anchors(spark, monkeypatch):
    """many anchors of one cell were as many rows of the neighbour search."""
    seen = []
    monkeypatch.setattr(correct, "knn", lambda q, d, k: seen.append(d.count()) or knn.knn(q, d, k))
    query = cells(spark, np.random.default_rng(5).normal(size=(12, 6)))
    found = correct.numbered(spark.createDataFrame([(r, q, 0.5 + r / 40) for q in (1, 4, 9) for r in range(7)], "cellr long, cellq long, score double"))
    got = {(r["cellq"], r["anchor_id"]) for r in correct.anchor_weights(found, query, 10).collect()}
    assert seen == [3]
    ids = {(r["cellq"], r["cellr"]): r["anchor_id"] for r in found.collect()}
    x = knn.unit(np.array([r["v"] for r in query.orderBy("ord").collect()]))
    for c in range(12):
        d = sorted((round(float(1 - x[c] @ x[q]), 12), q) for q in (1, 4, 9))
        first = [(q, r) for _, q in d for r in range(7)][:10]
        want = {(c, ids[a]) for a in first if round(float(1 - x[c] @ x[a[0]]), 12) < d[1][0]}  # those at the last distance weigh 0
        assert {g for g in got if g[0] == c} == want


@pytest.mark.parametrize("metric", ["correlation", "euclidean"])
def test_neighbours_are_sifted_without_loss(metric):
    """Far from the origin products lose the distances' digits: results are those of the distances pair by pair, ties by number."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(6000, 5))
    rows[3000:3400] = rows[:400]
    for x in (rows, rows * 1e-3 + 1e6 * (metric == "euclidean"), np.round(rows), rows * 1e-25):
        q, d, k = x[:30], x, 25
        if metric == "correlation":
            q, d = knn.unit(q), knn.unit(d)
            far = np.array([[np.round(1 - a @ b, 12) for b in d] for a in q])
        else:
            far = np.round(np.sqrt(((q[:, None] - d[None]) ** 2).sum(axis=2)), 12)
        ords = rng.permutation(len(d))
        best = knn.Closest(q, k, metric)
        for low in range(0, len(d), 2500):
            best.see(ords[low : low + 2500], d[low : low + 2500])
        got = [b.to_pydict() for b in best.found(np.arange(len(q)))]
        dst, dist = (np.concatenate([b[c] for b in got]) for c in ("dst", "dist"))
        good = [i for i in range(len(q)) if np.isfinite(far[i]).any()]
        order = [np.lexsort((ords, np.where(np.isnan(far[i]), np.inf, far[i])))[:k] for i in good]
        assert np.allclose(dist, np.concatenate([far[i][o] for i, o in zip(good, order, strict=True)]), rtol=1e-9, atol=2e-12)
        if metric == "euclidean":
            assert dst.tolist() == np.concatenate([ords[o] for o in order]).tolist()


def test_silhouettes_of_runs_send_no_vector_for_each_run(spark):
    """Many clusters and runs, noise, singletons, missing cells and text labels: brute force; vectors are not copied for each run."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 5))
    labels = [(r, i, f"c{i % (3 + 5 * r)}" if i % 7 else "noise") for r in range(4) for i in range(60) if r != 2 or i % 3]
    rows = spark.createDataFrame(labels, "run int, ord long, label string")
    out = cluster.silhouettes(cells(spark, x), rows, ["run"])
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["run"]: r["score"] for r in out.collect()}
    for run in range(4):
        of = {i: c for r, i, c in labels if r == run}
        scores = []
        for i, c in of.items():
            far = {}
            for j, d in of.items():
                if i != j:
                    far.setdefault(d, []).append(1 - np.corrcoef(x[i], x[j])[0, 1])
            b = min(np.mean(v) for d, v in far.items() if d != c)
            scores.append((b - np.mean(far[c])) / max(np.mean(far[c]), b) if c in far else 0.0)
        assert abs(got[run] - np.mean(scores)) < 1e-9
    assert cluster.silhouettes(cells(spark, x), rows.where("false"), ["run"]).count() == 0
    assert cluster.silhouettes(cells(spark, x), rows.where("run = 9")).first()[0] is None
