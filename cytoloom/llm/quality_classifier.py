"""Ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - w.x) with one weight vector over hashed text features and ordered
thresholds. It is fitted on a bounded, hash-chosen sample of the rated documents; every document is then
scored in one pass with its expected grade and the probability of the top grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, SPACE_WORDS, mix, slices, utf8_of, words_of

BITS = 17
#: At most so many rated documents are fitted on.
SAMPLE = 12_000


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, value, start of each row): words by presence, and shares of word shapes, endings, repeats and lengths."""
    raw, at = utf8_of(column)
    rows = len(at) - 1
    word, before, _, _ = words_of(raw, at, ALNUM_WORDS)
    n = np.diff(before)
    row = np.repeat(np.arange(rows), n)
    keep = np.uint64((1 << BITS) - 1)
    key, many = np.unique((row.astype(np.uint64) << np.uint64(BITS)) | (word & keep), return_counts=True)
    wrow = (key >> np.uint64(BITS)).astype(np.int64)
    wval = 1 + np.log(many)
    norm = np.sqrt(np.bincount(wrow, wval**2, rows))
    wval = 4 * wval / norm[wrow]
    # Shapes of space-separated words: kinds of the first two bytes, and the last two bytes where they are symbols.
    _, sb, s, e = words_of(raw, at, SPACE_WORDS)
    kind = np.full(256, 3, np.uint64)
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = 0, 1, 2, 1
    second = kind[raw[np.minimum(s + 1, e - 1)]] if len(s) else np.zeros(0, np.uint64)
    tail = np.zeros(len(s), np.uint64)
    if len(s):
        odd = kind[raw[e - 1]] == 3
        tail = np.where(odd, raw[e - 1].astype(np.uint64) + np.uint64(256) * np.where(kind[raw[np.maximum(e - 2, s)]] == 3, raw[np.maximum(e - 2, s)], 0).astype(np.uint64), np.uint64(0))
    srow = np.repeat(np.arange(rows), np.diff(sb))
    shape = mix((kind[raw[s]] * np.uint64(4) + second + np.uint64(1 << 40)) if len(s) else tail) & keep
    tail = mix(tail + np.uint64(1 << 41)) & keep
    both = np.concatenate([(srow.astype(np.uint64) << np.uint64(BITS)) | x for x in (shape, tail)])
    skey, smany = np.unique(both, return_counts=True)
    rkey = (skey >> np.uint64(BITS)).astype(np.int64)
    sval = 3 * smany / np.maximum(np.diff(sb), 1)[rkey]
    # Bins of the share of different words, of repeated three-word windows and of the length.
    share = np.bincount(wrow, minlength=rows) / np.maximum(n, 1)
    three = word[:-2] * np.uint64(3) + word[1:-1] * np.uint64(5) + word[2:] * np.uint64(7) if len(word) > 2 else np.zeros(0, np.uint64)
    inside = row[:-2] == row[2:] if len(word) > 2 else np.zeros(0, bool)
    trow = row[:-2][inside] if len(word) > 2 else np.zeros(0, np.int64)
    different = np.unique((trow.astype(np.uint64) << np.uint64(44)) | (mix(three[inside]) >> np.uint64(20)))
    windows = np.bincount(trow, minlength=rows)
    repeats = 1 - np.bincount((different >> np.uint64(44)).astype(np.int64), minlength=rows) / np.maximum(windows, 1)
    repeats[windows == 0] = 0
    bins = np.stack([(share * 20).astype(np.uint64), (repeats * 20).astype(np.uint64) + np.uint64(100), np.log2(n + 1.0).astype(np.uint64) + np.uint64(200)], 1)
    bkey = mix(bins + np.uint64(1 << 42)).reshape(-1) & keep
    brow = np.repeat(np.arange(rows), 3)
    every = np.concatenate([wrow, rkey, brow])
    order = np.argsort(every, kind="stable")
    bucket = np.concatenate([(key & keep).astype(np.int64), (skey & keep).astype(np.int64), bkey.astype(np.int64)])[order]
    value = np.concatenate([wval, sval, np.ones(len(brow))])[order]
    return bucket, value, np.searchsorted(every[order], np.arange(rows + 1))


@dataclass
class Ordinal:
    """Weights, ordered thresholds and the selection cutoff on the top grade's probability."""

    weights: np.ndarray
    thresholds: np.ndarray
    cutoff: float = 0.5

    def below(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for every k but the last."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -30, 30)))

    def score(self, bucket: np.ndarray, value: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Each row's sum by itself, so that it does not depend on the rows beside it."""
        rows = np.repeat(np.arange(len(start) - 1), np.diff(start))
        return np.bincount(rows, self.weights[bucket] * value, len(start) - 1)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, grades: int, epochs: int = 8, rate: float = 0.15, l2: float = 1e-5, seed: int = 3) -> Ordinal:
    """Adagrad on the ordinal log-likelihood; a fifth of the rows is held out to set the cutoff:
    of those that keep 99 % of its top-grade rows, the one with the largest sum of recalls."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, train = order[: len(rows) // 5], order[len(rows) // 5 :]
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / max(1, len(grade)), 0.01, 0.99)
    first, steps = np.log(share / (1 - share))[0], np.log(np.maximum(np.diff(np.log(share / (1 - share))), 0.05))
    w, gw = np.zeros(1 << BITS), np.full(1 << BITS, 1e-4)
    free = np.r_[first, steps]
    gf = np.full(len(free), 1e-2)
    weight = len(grade) / (grades * np.maximum(np.bincount(grade, minlength=grades), 1))
    weight = np.sqrt(weight)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // 32)):
            if not len(batch):
                continue
            theta = np.cumsum(np.r_[free[0], np.exp(free[1:])])
            b = np.concatenate([rows[i][0] for i in batch])
            v = np.concatenate([rows[i][1] for i in batch])
            at = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            score = np.bincount(at, w[b] * v, len(batch))
            cdf = np.c_[np.zeros(len(batch)), 1 / (1 + np.exp(-np.clip(theta[None] - score[:, None], -30, 30))), np.ones(len(batch))]
            y = grade[batch]
            each = np.arange(len(batch))
            hi, lo = cdf[each, y + 1], cdf[each, y]
            p = np.maximum(hi - lo, 1e-9)
            dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
            g = weight[y] * (dhi - dlo) / len(batch)  # of -log p by the score
            dt = np.zeros(grades - 1)
            np.add.at(dt, y[y < grades - 1], -(weight[y] * dhi)[y < grades - 1] / len(batch))
            np.add.at(dt, y[y > 0] - 1, (weight[y] * dlo)[y > 0] / len(batch))
            df = np.r_[dt.sum(), [dt[k:].sum() * np.exp(free[k]) for k in range(1, grades - 1)]]
            gf += df**2
            free -= rate * df / np.sqrt(gf)
            u, inverse = np.unique(b, return_inverse=True)
            grad = np.bincount(inverse, g[at] * v) + l2 * w[u]
            gw[u] += grad**2
            w[u] -= rate * grad / np.sqrt(gw[u])
    model = Ordinal(w, np.cumsum(np.r_[free[0], np.exp(free[1:])]))
    if len(held):
        p = 1 - model.below(np.array([float((w[b] * v).sum()) for b, v in (rows[i] for i in held)]))[:, -1]
        good = grade[held] == grades - 1
        if good.any() and (~good).any():
            cuts = np.unique(np.quantile(p, np.linspace(0, 1, 201)))
            gain = [(p[good] >= c).mean() + (p[~good] < c).mean() - 2 * ((p[good] >= c).mean() < 0.99) for c in cuts]
            model.cutoff = float(cuts[int(np.argmax(gain))])
    return model


def rated(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Features and grades of at most ``sample`` rated documents, those whose ids hash lowest. ``ratings`` has the id and grade;
    of several grades of an id the worst counts, of several texts the one whose features come first in binary order."""
    best = ratings.where(F.col("grade").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("grade").cast("int").alias("g"))
    best = best.orderBy(F.xxhash64(id_col), id_col).limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            k, v, at = features(b.column(2))
            cut = lambda x, t: pa.array([x[a:z].astype(t).tobytes() for a, z in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cut(k, "<u4"), cut(v, "<f4")], ["i", "g", "k", "v"])

    rows = docs.select(docs[id_col], docs[text_col].alias("t")).join(F.broadcast(best), id_col).select(F.col(id_col).cast("string").alias("i"), "g", "t")  # at most ``sample`` pairs of numbers
    got = rows.mapInArrow(run, "i string, g int, k binary, v binary").groupBy("i").agg(F.min(F.struct("k", "v", "g")).alias("x")).select("i", "x.*").toPandas().sort_values("i")
    return [(np.frombuffer(k, "<u4").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for k, v in zip(got["k"], got["v"], strict=True)], got["g"].to_numpy(np.int64)


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 for bad quality, 1 for good but toxic, 2 for good; a missing mark gives no grade."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))


def classify(docs: DataFrame, ratings: DataFrame, grades: int = 3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, expected_grade, top_probability and selected.

    Null and empty texts are scored as texts without words. Without two different grades among the ratings all
    rows get the thresholds' prior. Repeated rows each give a row. A text's features take some 100 bytes a word.
    """
    rows, grade = rated(docs, ratings, sample, id_col, text_col)
    model = fit(rows, grade, grades) if len(rows) else Ordinal(np.zeros(1 << BITS), np.log(np.arange(1, grades) / (grades - np.arange(1, grades))), 0.0)
    data = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = data.value
        for b in slices(batches, "t"):
            below = m.below(m.score(*features(b.column(1))))
            top = 1 - below[:, -1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((1 - below).sum(axis=1)), pa.array(top), pa.array(top >= m.cutoff)], ["i", "expected_grade", "top_probability", "selected"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).mapInArrow(run, f"i {kind}, expected_grade double, top_probability double, selected boolean")
    return out.withColumnRenamed("i", id_col)
