"""Denoising: total-intensity scaling, Gaussian mixtures of the query, negative binomial mixtures of the reference.

Fits see a histogram of bounded size per feature, never the cells: values go to at most ``BINS`` equal bins whose
count and mean come from one aggregation that combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distributions import nb_median, nb_pmf, normal_cdf
from ..sources.scratch import settled
from .gates import row_sum

BINS = 65_536
#: The five starts (mean 1, mean 2, 1 / size 1, 1 / size 2, share of the first).
STARTS = ((10, 60, 2, 0.5, 0.5), (4.8, 50, 0.5, 2, 0.5), (2, 18, 0.5, 2, 0.5), (1, 3, 2, 2, 0.5), (1, 3, 0.5, 2, 0.5))


def total_normalize(cells: DataFrame) -> DataFrame:
    """Subtract the least entry of all; scale rows to the mean row sum (zero rows count in it and stay zero)."""
    low = cells.agg(F.min(F.array_min("v")).alias("_lo"))
    rows = cells.crossJoin(F.broadcast(low)).withColumn("v", F.transform("v", lambda x: x - F.col("_lo"))).drop("_lo")  # one row
    rows = rows.withColumn("_s", row_sum())
    mean = rows.agg(F.avg("_s").alias("_m"))
    rows = rows.crossJoin(F.broadcast(mean))  # one row
    scaled = F.when(F.col("_s") != 0, F.transform("v", lambda x: F.try_divide(x, F.col("_s")) * F.col("_m"))).otherwise(F.col("v"))
    return rows.withColumn("v", scaled).drop("_s", "_m")


def reference_normalize(cells: DataFrame) -> DataFrame:
    """Drop rows whose sum is 0; divide by it, then scale every feature to 0..1 (a constant one becomes 0)."""
    rows = cells.withColumn("_s", row_sum()).where("_s <> 0").withColumn("v", F.transform("v", lambda x: F.try_divide(x, F.col("_s")))).drop("_s")
    each = rows.select(F.posexplode("v").alias("j", "x")).groupBy("j").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    limits = each.agg(F.array_sort(F.collect_list(F.struct("j", "lo", "hi"))).alias("_l"))  # one row of panel size
    rows = rows.crossJoin(F.broadcast(limits))
    return rows.withColumn("v", F.zip_with("v", "_l", lambda x, r: F.coalesce(F.try_divide(x - r["lo"], r["hi"] - r["lo"]), F.lit(0.0)))).drop("_l")


def long_form(cells: DataFrame) -> DataFrame:
    """(ord, feature, value)."""
    return cells.select("ord", F.posexplode("v").alias("feature", "value"))


def wide_form(rows: DataFrame, value: str = "value") -> DataFrame:
    """Back to (ord, v) in feature order."""
    return rows.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", F.col(value).alias("x")))), lambda s: s["x"]).alias("v"))


def binned(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """(feature, n, x): count and mean of each used bin between the feature's least and largest value."""
    limits = rows.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = F.floor(F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * (bins - 1))
    return rows.join(F.broadcast(limits), "feature").groupBy("feature", at.alias("bin")).agg(F.count("*").alias("n"), F.avg("value").alias("x")).drop("bin")  # a row per feature


def gaussian_pair(x: np.ndarray, n: np.ndarray, tol: float = 1e-3, steps: int = 100, floor: float = 1e-6) -> tuple[float, float]:
    """Mean and variance of the component with the larger mean of a two-component mixture, by EM from a 2-means split."""
    n = n / n.sum()
    a, b = float(x.min()), float(x.max())
    for _ in range(100):
        right = np.abs(x - b) < np.abs(x - a)
        if not right.any() or right.all():
            break
        na, nb = (x[~right] @ n[~right]) / n[~right].sum(), (x[right] @ n[right]) / n[right].sum()
        if na == a and nb == b:
            break
        a, b = na, nb
    r = np.c_[np.abs(x - b) >= np.abs(x - a), np.abs(x - b) < np.abs(x - a)].astype(float)
    before = -np.inf
    mean = var = None
    for _ in range(steps):
        w = r * n[:, None]
        mass = w.sum(axis=0) + 1e-15
        mean = (w * x[:, None]).sum(axis=0) / mass
        var = (w * (x[:, None] - mean) ** 2).sum(axis=0) / mass + floor
        log = np.log(mass / mass.sum()) - 0.5 * np.log(2 * np.pi * var) - (x[:, None] - mean) ** 2 / (2 * var)
        top = log.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
        r = np.exp(log - total[:, None])
        now = float(total @ n)
        if abs(now - before) < tol:
            break
        before = now
    k = int(np.argmax(mean))
    return float(mean[k]), float(var[k])


def gaussian_fits(rows: DataFrame) -> DataFrame:
    """(feature, mean, sd) of each feature's signal component; rows are (feature, value)."""

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        mean, var = gaussian_pair(pdf["x"].to_numpy(), pdf["n"].to_numpy(float))
        return pd.DataFrame({"feature": [key[0]], "mean": [mean], "sd": [var**0.5]})

    kind = rows.schema["feature"].dataType.simpleString()
    return binned(rows).groupBy("feature").applyInPandas(fit, f"feature {kind}, mean double, sd double")


def clean_query(cells: DataFrame) -> DataFrame:
    """(ord, v): every scaled value replaced by its probability under the feature's signal component."""
    rows = long_form(total_normalize(cells))
    fits = settled(gaussian_fits(rows.select("feature", "value")))
    return wide_form(rows.join(F.broadcast(fits), "feature").select("ord", "feature", normal_cdf("value", "mean", "sd").alias("value")))  # a row per feature


def count_pmf(rows: DataFrame) -> DataFrame:
    """(feature, value, n, p): share of every count from 0 to the feature's largest. Counts must be whole and not negative."""
    known = rows.groupBy("feature", F.col("value").cast("long").alias("value")).agg(F.count("*").alias("n"))
    top = known.groupBy("feature").agg(F.max("value").alias("hi"), F.sum("n").alias("total"))
    every = top.select("feature", "total", F.explode(F.sequence(F.lit(0).cast("long"), "hi")).alias("value"))
    out = every.join(known, ["feature", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("feature", "value", "n", (F.col("n") / F.col("total")).alias("p"))


def sse(args: Sequence[float], p_obs: np.ndarray) -> float:
    """Squared distance between observed shares and the mixture; at most 2^31 - 1."""
    mu1, mu2, r1, r2, share = args
    k = np.arange(len(p_obs), dtype=float)
    p = share * nb_pmf(k, 1 / r1, mu1) + (1 - share) * nb_pmf(k, 1 / r2, mu2)
    value = float(((p - p_obs) ** 2).sum())
    return min(value, 2147483647.0) if np.isfinite(value) else 2147483647.0


def nb_mixture(p_obs: np.ndarray, starts: Sequence[Sequence[float]] | None = None, steps: int = 500, tol: float = 1e-9) -> tuple[np.ndarray, float]:
    """Best parameters over the starts (the first on ties) and their SSE: quasi-Newton steps on logarithms and a logit."""
    best: tuple[np.ndarray, float] | None = None
    back = lambda t: np.r_[np.exp(np.clip(t[:4], -18, 18)), 1 / (1 + np.exp(-np.clip(t[4], -18, 18)))]
    f = lambda t: sse(back(t), p_obs)
    for start in starts or STARTS:
        s = np.asarray(start, float)
        t = np.r_[np.log(s[:4]), np.log(s[4] / (1 - s[4]))]
        grad = lambda t: np.array([(f(t + h) - f(t - h)) / 2e-5 for h in np.eye(5) * 1e-5])
        now, g, inv = f(t), grad(t), np.eye(5)
        for _ in range(steps):
            step = -inv @ g
            if step @ g >= 0:
                inv, step = np.eye(5), -g
            size = 1.0 if np.abs(step).max() < 2 else 2 / np.abs(step).max()
            while size > 1e-10 and f(t + size * step) > now + 1e-4 * size * (step @ g):
                size /= 2
            if size <= 1e-10:
                break
            move = size * step
            new, fresh = f(t + move), grad(t + move)
            y = fresh - g
            if (sy := move @ y) > 1e-14:
                a = np.eye(5) - np.outer(move, y) / sy
                inv = a @ inv @ a.T + np.outer(move, move) / sy
            done = now - new <= tol * max(abs(now), abs(new), 1e-12)
            t, now, g = t + move, new, fresh
            if done:
                break
        if best is None or now < best[1]:
            best = back(t), now
    return best


def nb_fits(rows: DataFrame, starts: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """(feature, size, mean, sse) of each feature's signal component: the one with the larger median, the first on ties."""

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        args, score = nb_mixture(pdf.sort_values("value")["p"].to_numpy(), starts)
        k = int(np.argmax([nb_median(1 / args[2], args[0]), nb_median(1 / args[3], args[1])]))
        return pd.DataFrame({"feature": [key[0]], "size": [1 / args[2 + k]], "mean": [args[k]], "sse": [score]})

    kind = rows.schema["feature"].dataType.simpleString()
    return count_pmf(rows).groupBy("feature").applyInPandas(fit, f"feature {kind}, size double, mean double, sse double")


def nb_cdf_table(pmf: DataFrame, fits: DataFrame) -> DataFrame:
    """(feature, value, cdf): cumulative probability of every count of ``pmf`` under the feature's component."""
    from ..functions.distributions import log_gamma

    k, size, mean = F.col("value").cast("double"), F.col("size"), F.col("mean")
    p = F.exp(log_gamma(k + size) - log_gamma(k + 1) - log_gamma(size) + size * F.log(size / (size + mean)) + k * F.log(mean / (size + mean)))
    up = Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return pmf.join(F.broadcast(fits), "feature").withColumn("_p", p).select("feature", "value", F.least(F.sum("_p").over(up), F.lit(1.0)).alias("cdf"))  # a row per feature


def clean_reference(cells: DataFrame, starts: Sequence[Sequence[float]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Cleaned cells (ord, v) and the fits (their sse summed is the total). Zero-sum rows are dropped; drop them in the other tables too."""
    rows = long_form(cells).select("ord", "feature", F.col("value").cast("long").alias("value"))
    fits = settled(nb_fits(rows.select("feature", "value"), starts))
    table = nb_cdf_table(count_pmf(rows.select("feature", "value")), fits)
    clean = settled(wide_form(rows.join(table, ["feature", "value"]), "cdf"))
    sums = cells.select("ord", row_sum().alias("s")).where("s <> 0")
    scaled = clean.join(sums, "ord").withColumn("v", F.transform("v", lambda x: F.try_divide(x, F.col("s")))).select("ord", "v")
    each = long_form(scaled).groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    limits = each.agg(F.array_sort(F.collect_list(F.struct("feature", "lo", "hi"))).alias("_l"))  # one row of panel size
    out = scaled.crossJoin(F.broadcast(limits)).select("ord", F.zip_with("v", "_l", lambda x, r: F.coalesce(F.try_divide(x - r["lo"], r["hi"] - r["lo"]), F.lit(0.0))).alias("v"))
    return out, fits
