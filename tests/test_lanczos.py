"""The restarted bidiagonalisation agrees with the Gram path, and with the decomposition of the formed cross-product."""

import numpy as np
import pytest

from cytoloom.operators import lanczos
from cytoloom.operators.cca import cca, standardize_rows


def frame(spark, x):
    return spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "ord long, v array<double>").repartition(3).cache()


def vectors(df):
    return np.array([r["v"] for r in df.orderBy("ord").collect()])


def test_against_gram_path(spark):
    rng = np.random.default_rng(6)
    shared = rng.normal(size=(4, 20))
    r = rng.normal(size=(50, 4)) @ shared * 2 + rng.normal(size=(50, 20))
    q = rng.normal(size=(40, 4)) @ shared * 2 + rng.normal(size=(40, 20))
    ref, query = frame(spark, r), frame(spark, q)
    a, b, s = lanczos.cca_by_lanczos(ref, query, 3, extra=4)
    c, d, t = cca(ref, query, 3)
    true = np.linalg.svd(standardize_rows(r) @ standardize_rows(q).T)[1]
    assert np.allclose(s, t, rtol=1e-9) and np.allclose(s, true[:3], rtol=1e-9)
    assert np.allclose(vectors(a), vectors(c), atol=1e-6) and np.allclose(vectors(b), vectors(d), atol=1e-6)


def test_near_values(spark):
    """Where all values are near each other, what rounding leaves along the constant must not grow."""
    rng = np.random.default_rng(3)
    x = np.tile(np.concatenate([np.eye(24), -np.eye(24)]), (3, 1))
    x += 0.03 * rng.normal(size=x.shape)
    cells = frame(spark, x)
    s = lanczos.cca_by_lanczos(cells, cells, 1)[2]
    assert np.allclose(s, np.linalg.svd(standardize_rows(x) @ standardize_rows(x).T)[1][:1], rtol=1e-9)


def test_rank_below_width(spark, monkeypatch):
    """The same for directions that no row of a set has, on either side."""
    rng = np.random.default_rng(4)
    r, q = (rng.normal(size=(300, 20)) @ np.linalg.qr(rng.normal(size=(40, 20)))[0].T for _ in range(2))
    monkeypatch.setattr(lanczos, "gram_times", lambda cells, c, standardize=True: cells_of[id(cells)].T @ (cells_of[id(cells)] @ c))
    ref, query = frame(spark, r), frame(spark, q)
    cells_of = {id(ref): standardize_rows(r), id(query): standardize_rows(q)}
    for a, b in ((ref, query), (ref, ref), (query, query)):
        s = lanczos.cca_by_lanczos(a, b, 2)[2]
        assert np.allclose(s, np.linalg.svd(cells_of[id(a)] @ cells_of[id(b)].T)[1][:2], rtol=1e-9)


def test_low_rank_and_odd_inputs(spark):
    rng = np.random.default_rng(7)
    r, q = rng.normal(size=(30, 2)) @ rng.normal(size=(2, 9)), rng.normal(size=(20, 2)) @ rng.normal(size=(2, 9))
    ref, query = frame(spark, r), frame(spark, q)
    _, _, s = lanczos.cca_by_lanczos(ref, query, 5, standardize=False)
    assert len(s) == 2 and np.allclose(s, np.linalg.svd(r @ q.T)[1][:2], rtol=1e-8)
    flat, empty = frame(spark, np.ones((3, 9))), spark.createDataFrame([], "ord long, v array<double>")
    for bad in (flat, empty):
        with pytest.raises(ValueError):
            lanczos.cca_by_lanczos(ref, bad, 2)
        with pytest.raises(ValueError):
            lanczos.cca_by_lanczos(bad, query, 2)
    with pytest.raises(ValueError):
        lanczos.cca_by_lanczos(ref, query, 0)
