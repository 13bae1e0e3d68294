"""Harmonic packing of documents into sequences of a fixed capacity.

Reciprocal-capacity classes: class j holds pieces of length in (capacity/(j+1), capacity/j], and each of its
sequences takes exactly j of them. A document longer than the capacity gives whole sequences first. What is
left is cut at the next class boundary ``capacity // j`` down to ``finest`` classes, so those classes fill
their sequences to within j tokens; the last short piece goes to one of the coarser tail classes.

Workers cut and classify on their own. A piece's number in its class is its worker's offset (a prefix sum over
one count per worker and class) plus its local rank, so only the last pieces of each class, fewer than a
sequence takes, are left however many workers there are; those of all classes are packed together, longest first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import slices, written
from .tokens import tokenizer, with_end

#: Pieces per sequence in the tail classes.
TAIL = (18, 20, 22, 24, 28, 32, 40, 48, 64, 96, 128, 192, 256, 384, 512, 1024, 2048)


def classes(capacity: int, finest: int = 16) -> list[int]:
    """Every class's number of pieces per sequence, ascending."""
    return [*range(1, min(finest, capacity) + 1), *(j for j in TAIL if finest < j < capacity), *([capacity] if capacity > finest else [])]


def cuts(length: int, capacity: int, finest: int = 16) -> list[tuple[int, int]]:
    """(piece length, class) in order, tail classes as negative numbers; the lengths add up to ``length``."""
    out = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        j = -(-capacity // rest)  # the first class whose pieces are not longer than rest
        if capacity // j > rest:
            j += 1
        if j <= finest and capacity // j > 0:
            out.append((capacity // j, j))
            rest -= capacity // j
            continue
        fits = capacity // rest
        out.append((rest, -max(k for k in classes(capacity, finest) if k <= fits)))
        break
    return out


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, finest: int = 16, id_col: str = "doc_id", text_col: str = "text", tokens: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``tokens``, the ids).

    Null and empty texts are documents of the end id alone. Repeated rows are packed each on its own; a null id
    stays null. Every id of a document lies in exactly one piece; offsets in a sequence have no gaps. Which
    sequence holds a piece depends on the input's partitions, the pieces themselves do not.
    """
    spark = docs.sparkSession
    table: dict[int, list[tuple[int, int]]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker, local = TaskContext.get().partitionId(), {}
        tok = tokenizer(path)
        for b in slices(batches, "t"):
            cols: list[list] = [[] for _ in range(9)]
            ids, ends = with_end(*tok.encode_column(b.column(1)), end_id)
            data = memoryview(ids.astype("<u4", copy=False)).cast("B")
            at = 0
            for key, stop in zip(b.column(0).to_pylist(), ends.tolist(), strict=True):
                n, start, raw, at = stop - at, 0, data[4 * at : 4 * stop], stop
                if n not in table:
                    table[n] = cuts(n, capacity, finest)
                for length, j in table[n]:
                    part = raw[4 * start : 4 * (start + length)]
                    rank = local.get(j, 0)
                    local[j] = rank + 1
                    for c, v in zip(cols, (key, start, length, zlib.crc32(part), n, worker, j, rank, bytes(part) if tokens else None), strict=True):
                        c.append(v)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    schema = T.StructType([T.StructField("i", docs.schema[id_col].dataType)]).add("start", "long").add("length", "long").add("ids_crc32", "long").add("doc_tokens", "long").add("worker", "integer").add("j", "integer").add("rank", "long").add("tokens", "binary")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    pieces = written(docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).mapInArrow(run, schema), "pieces")
    # One row per worker and class: far fewer than pieces, so one task orders them.
    count = pieces.groupBy("worker", "j").agg(F.count("*").alias("n"))
    before = Window.partitionBy("j").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    count = count.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    bins = count.groupBy("j").agg(F.floor(F.sum("n") / F.abs("j")).cast("long").alias("bins"))
    every = Window.partitionBy(F.lit(0))
    first = bins.select("j", "bins", F.coalesce(F.sum("bins").over(every.orderBy("j").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"), F.sum("bins").over(every).alias("full"))
    offsets = count.join(first, "j").select("worker", "j", "base", "bins", "first", "full")
    placed = pieces.join(offsets, ["worker", "j"])
    number = F.col("base") + F.col("rank")
    slot = F.pmod(number, F.abs("j"))
    placed = placed.select("*", number.alias("number"), (F.col("first") + F.floor(number / F.abs("j"))).cast("long").alias("sequence_id"), slot.alias("slot"))
    whole = F.floor(F.col("number") / F.abs("j")) < F.col("bins")
    exact = F.col("j") > 0
    names = [F.col("i").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["tokens"] if tokens else [])]
    # Pieces of the cut classes have one length, so the slot gives the offset; only tail pieces meet in a window of j rows.
    head = placed.where(whole & exact).withColumn("offset", F.col("slot") * F.col("length"))
    tail = placed.where(whole & ~exact).withColumn("offset", F.coalesce(F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # What no full sequence took, fewer than j pieces of each class: some 5,500 rows at most, whatever the input.
    left = placed.where(~whole).select("worker", "j", "rank", "length", "full").withColumn("g", F.lit(0)).groupBy("g").applyInPandas(_first_fit(capacity), "worker int, j int, rank long, sequence_id long, offset long")
    left = placed.where(~whole).drop("sequence_id").join(left, ["worker", "j", "rank"])
    return head.select(*names).unionByName(tail.select(*names)).unionByName(left.select(*names))


def _first_fit(capacity: int):
    def run(pdf):
        """Longest first into the first sequence with room."""
        pdf = pdf.sort_values(["length", "j", "worker", "rank"], ascending=[False, True, True, True])
        used: list[int] = []
        at, offset = [], []
        for n in pdf["length"].tolist():
            k = next((i for i, u in enumerate(used) if u + n <= capacity), len(used))
            if k == len(used):
                used.append(0)
            at.append(k)
            offset.append(used[k])
            used[k] += n
        return pdf.assign(sequence_id=pdf["full"] + at, offset=offset)[["worker", "j", "rank", "sequence_id", "offset"]]

    return run
