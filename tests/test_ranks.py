"""Order statistics by selection agree with sorting, on every kind of distribution."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.operators import gates, ranks


@pytest.fixture(autouse=True)
def few(monkeypatch):
    monkeypatch.setattr(ranks, "FEW", 5)
    monkeypatch.setattr(ranks, "ACCURACY", 50)


@pytest.mark.parametrize("kind", ["normal", "heavy", "two", "one", "long"])
def test_quantiles(spark, kind):
    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(size=3001), "heavy": np.exp(rng.normal(size=3001) * 100), "two": (rng.random(3001) < 0.3).astype(float), "one": np.full(3001, 7.5), "long": rng.integers(0, 900, 3001).astype(float)}[kind]
    shares = (0.0, 0.002, 0.025, 0.3, 0.5, 0.7, 0.99, 0.995, 1.0)
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(7)
    got = ranks.quantiles(rows, [(F.col("x"), shares), (-F.col("x"), (0.1,))])
    assert np.allclose(got[0], np.quantile(x, shares), rtol=1e-12) and np.isclose(got[1][0], np.quantile(-x, 0.1), rtol=1e-12)
    exact = rows.where(~F.isnan("x")).agg(F.percentile("x", [*shares])).first()[0]
    assert got[0] == exact  # the same numbers, not only near ones
    whole = [0, 17, 1500, 3000, 3001, -1]
    assert ranks.ranked(rows, [(F.col("x"), whole)])[0] == [*np.sort(x)[whole[:4]], None, None]


def test_no_values(spark):
    rows = spark.createDataFrame([(None, 1)], "x double, y long")
    assert ranks.quantiles(rows, [(F.col("x"), (0.5, 1.0)), (F.col("y"), (0.5,))]) == [[None, None], [1.0]]
    empty = spark.createDataFrame([], "blanks array<double>, size double")
    assert gates.blank_size_gate(empty, None, None, None).count() == 0


@pytest.mark.parametrize("parts", [1, 6])
def test_marker_gate_against_sorting(spark, parts):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(400, 3)), 1)  # many ties
    v[::17, 0] = np.nan
    v[:, 2] = 1.0
    cells = spark.createDataFrame([(i, [float(y) for y in v[i]]) for i in range(400)], "ord long, v array<double>").repartition(parts)
    given = [(0, 0.1), (1, 0.333), ((1, 2), (0.5, 0.4)), (2, 0.05), (0, 0.0), ((0, 1), (1.0, 0.02))]
    top = {}
    for f in range(3):
        order = sorted(range(400), key=lambda i: (-(np.inf if np.isnan(v[i, f]) else v[i, f]), i))
        for t in (0.0, 0.02, 0.05, 0.1, 0.333, 0.4, 0.5, 1.0):
            top[f, t] = set(order[: int(t * 400)])
    want = {}
    for i in range(400):
        want[i] = -1
        for g, (f, t) in enumerate(given, 1):
            if all(i in top[a, b] for a, b in zip(*((f, t) if isinstance(f, tuple) else ((f,), (t,))), strict=True)):
                want[i] = g
    assert {r["ord"]: r["cluster"] for r in gates.marker_gate(cells, given).collect()} == want
    assert gates.marker_gate(cells, []).where("cluster = -1").count() == 400
    assert gates.marker_gate(cells.limit(0), given).count() == 0
