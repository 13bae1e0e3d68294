"""Neighbours through a partition of space agree with all pairs, or keep the stated bound."""

import numpy as np
import pytest

from cytoloom.operators.knn import four_way, knn
from cytoloom.operators.pivots import Index


def frame(spark, x, start=0):
    return spark.createDataFrame([(i + start, [float(y) for y in r]) for i, r in enumerate(x)], "ord long, v array<double>").repartition(5)


def rows(df):
    return {(r["src"], r["rank"]): (r["dst"], round(r["dist"], 9)) for r in df.collect()}


def blobs(n, seed, d=6, many=15):
    rng = np.random.default_rng(1)
    at = rng.normal(size=(many, d)) * 20
    rng = np.random.default_rng(seed)
    return at[rng.integers(0, many, n)] + rng.normal(size=(n, d))


@pytest.mark.parametrize("metric", ["euclidean", "correlation"])
def test_exact(spark, metric):
    x, q = blobs(600, 2), blobs(200, 3)
    x[300:330] = x[0]  # ties: 31 equal rows
    data, asked = frame(spark, x), frame(spark, q)
    index = Index(data, metric, block_bytes=6 * 8 * 4 * 40)  # blocks of 40 rows
    assert rows(index.search(asked, 12)) == rows(knn(asked, data, 12, metric))
    assert index.share < (0.5 if metric == "euclidean" else 0.9)
    assert rows(index.search(data, 7, drop_self=True)) == rows(knn(data, data, 7, metric, drop_self=True))


def test_eps(spark):
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(1500, 8)), rng.normal(size=(150, 8))
    data, asked = frame(spark, x), frame(spark, q)
    exact, index = rows(knn(asked, data, 10, "euclidean")), Index(data)
    shares, recalls = [], []
    for eps in (0.0, 0.1, 1.0):
        got = rows(index.search(asked, 10, eps))
        shares.append(index.share)
        assert got.keys() == exact.keys() and all(d <= exact[key][1] * (1 + eps) + 1e-9 for key, (_, d) in got.items())
        true = {(s, o) for (s, _), (o, _) in exact.items()}
        recalls.append(len(true & {(s, o) for (s, _), (o, _) in got.items()}) / len(true))
    assert recalls[0] == 1 and recalls[1] >= 0.9 and shares[0] >= shares[1] >= shares[2]
    print("shares", shares, "recalls", recalls)


def test_odd_inputs(spark):
    data = frame(spark, [[1, 1, 1], [1, 2, 3], [np.nan, 0, 1], [1, 2, 3]])
    assert rows(Index(data, "correlation").search(data, 5)) == {(1, 1): (1, 0.0), (1, 2): (3, 0.0), (3, 1): (1, 0.0), (3, 2): (3, 0.0)}
    got = rows(Index(data).search(frame(spark, [[1, 2, 3]], 9), 9))
    assert {key: v[0] for key, v in got.items()} == {(9, 1): 1, (9, 2): 3, (9, 3): 0}
    empty = spark.createDataFrame([], "ord long, v array<double>")
    assert Index(empty).search(data, 2).count() == 0 and Index(data).search(empty, 2).count() == 0
    with pytest.raises(ValueError):
        Index(data).search(data, 0)
    with pytest.raises(ValueError):
        Index(data, "cosine")


def test_eps_in_neighbour_joins(spark):
    x, q = frame(spark, blobs(200, 6)), frame(spark, blobs(80, 7))
    exact = {(r["kind"], r["src"], r["rank"]): r["dist"] for r in four_way(x, q, x, 6).collect()}
    got = {(r["kind"], r["src"], r["rank"]): r["dist"] for r in four_way(x, q, x, 6, eps=0.5).collect()}
    assert got.keys() == exact.keys() and all(d <= exact[key] * 1.5 + 1e-9 for key, d in got.items())
    with pytest.raises(ValueError):
        knn(q, x, 3, eps=0.1)


def test_other_cells_are_searched_without_copies_of_rows(spark, monkeypatch):
    """A row is copied for the cells it meets first, not for all others; the result stays the exact one."""
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(300, 8)), rng.normal(size=(40, 8))
    visits, real = [], Index._visits
    monkeypatch.setattr(Index, "_visits", lambda self, *a: (visits.append(real(self, *a)), visits[-1])[1])
    index = Index(frame(spark, x), cells=30)
    got = index.search(frame(spark, q), 5)
    want = knn(frame(spark, q), frame(spark, x), 5, "euclidean")
    assert rows(got) == rows(want)
    assert sum(v.count() for v in visits) < 40 * 10 and index.share > 0.8
