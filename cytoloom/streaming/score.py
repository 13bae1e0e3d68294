"""Labels for a stream of new query cells against a frozen reference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.knn import BLOCK_BYTES, Vectors, matrix, nearest, unit
from ..operators.transfer import UNASSIGNED, masked_labels, query_mask, transfer_labels, transfer_weights
from ..sources.scratch import discard, kept


def score_stream(cells: DataFrame, ref: DataFrame, labels: DataFrame, k: int, c: float = 0.1, threshold: float = 0.5) -> DataFrame:
    """(ord, label, mean_dist, keep) for each row (ord, v), as the batch operators give it; no state, so any output mode works.

    The reference must be small enough to broadcast; a larger one is served by :func:`label_batches`.
    """
    data = Vectors(ref)
    if not data.small:
        raise ValueError(f"the reference exceeds {BLOCK_BYTES} bytes")
    ords, d = data.broadcast().value
    name = {r["ord"]: r["label"] for r in labels.select("ord", "label").collect()}  # one block's rows
    d = unit(d)
    good = ~np.isnan(d).any(axis=1)
    sent = cells.sparkSession.sparkContext.broadcast((ords[good], d[good], name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, vectors, label_of = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.asarray(b.column(0), np.int64)
            rows = []
            for i, o, x in nearest(unit(matrix(b.column(1))), vectors, at, k, "correlation"):
                w = np.exp(-x / c)
                w /= w.sum()
                score: dict = {}
                for j, v in zip(o.tolist(), w.tolist(), strict=True):
                    score[label_of[j]] = score.get(label_of[j], 0.0) + v
                best = min(score, key=lambda s: (-round(score[s], 12), s))
                mean = float(x.mean())
                rows.append((int(ids[i]), str(best) if mean < threshold else UNASSIGNED, mean, mean < threshold))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.bool_()), strict=True)], ["ord", "label", "mean_dist", "keep"])

    return cells.select("ord", "v").mapInArrow(run, "ord long, label string, mean_dist double, keep boolean")


def label_batches(cells: DataFrame, ref: DataFrame, labels: DataFrame, path: str, offsets: str, k: int, c: float = 0.1, threshold: float = 0.5) -> StreamingQuery:
    """Labels of a stream (ord, v) by the batch operators, with a reference of any size; runs until what is there is done.

    Batch ``i`` is written to ``path``/batch=i, over what an earlier try left there, and ``offsets`` logs what was read: a
    run that was stopped goes on where it was, and a batch that is run again leaves the same rows. Read the result by
    ``spark.read.parquet(path)``: src, label, mean_dist, keep and batch. Both folders must be shared by driver and executors.
    """
    data = Vectors(ref)

    def write(batch: DataFrame, i: int) -> None:
        weights = kept(transfer_weights(batch, data, k, c), "weights")
        rows = masked_labels(transfer_labels(weights, labels), query_mask(weights, threshold))
        rows.write.mode("overwrite").parquet(f"{path}/batch={i}")
        discard(weights)

    return cells.select("ord", "v").writeStream.foreachBatch(write).option("checkpointLocation", offsets).trigger(availableNow=True).start()
