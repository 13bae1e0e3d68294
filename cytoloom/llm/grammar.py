"""Token-id shards compressed by a Re-Pair grammar, with random access.

A shard is a run of documents in ascending id order. Rounds of pair replacement shorten its id array until no pair
of adjacent symbols is frequent: a round counts the adjacent pairs, gives each frequent one a nonterminal and
replaces its occurrences (the more frequent pair wins where two overlap, the left one in a run). Only pairs with a
symbol of the round before can have become frequent, so later rounds count those alone. No pair spans two documents,
so a document is a range of symbols. Rules and their expansion lengths are stored: a reader finds id number n by a
cumulative sum.

A file is a sequence of frames, each ending with a line feed, so that Spark's text writer with its commit
protocol writes it to any store and the binary reader reads it. Integers are little-endian::

    magic "CLRP2\\n" | u32 sizes[6]: docs, rules, symbols, byte length of the body, partition, frame number
    body: i64 doc id[docs] | u8 id is null[docs] | u32 symbols of each document[docs]
          u32 left[rules] | u32 right[rules] | u32 expansion length[rules]
          u32 first nonterminal | u8 bits of a symbol beyond 16 | u16 low half of each symbol[symbols]
          and for each bit beyond 16, lowest first: that bit of all symbols, eight in a byte
    u32 crc32 of the body | "\\n"
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, scratch_path, slices, written
from .tokens import tokenizer, with_end

MAGIC = b"CLRP2\n"
#: A pair seen so often is frequent: its rule costs 12 bytes, each replacement saves 2.
FREQUENT = 24


def _counted(key: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys seen ``least`` times or more, ascending, and how often."""
    value = np.sort(key)
    first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, len(value)])
    top = times >= least
    return value[first[top]], times[top]


def _number(key: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Each key's number in ``pairs`` (ascending), or -1: by a table of hashed pairs, the few that share a slot by search."""
    bits = 18
    slot = lambda x: (x * x.dtype.type(0x9E3779B1 if x.itemsize == 4 else 0x9E3779B97F4A7C15) >> x.dtype.type(8 * x.itemsize - bits)).astype(np.int32)
    own = slot(pairs)
    table = np.full(1 << bits, -1, np.int32)
    table[own] = np.arange(len(pairs), dtype=np.int32)
    shared = np.zeros(1 << bits, bool)
    shared[own[table[own] != np.arange(len(pairs))]] = True
    at = slot(key)
    out = table[at]
    other = np.flatnonzero((out >= 0) & (pairs[out] != key))
    again = other[shared[at[other]]]
    out[other] = -1
    if len(again):
        k = np.minimum(np.searchsorted(pairs, key[again]), len(pairs) - 1)
        out[again] = np.where(pairs[k] == key[again], k, -1)
    return out


def _apart(place: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the ascending ``place`` to replace, so that no two are adjacent: smaller ranks first, in a run of one rank every second."""
    left = np.arange(len(place), dtype=np.int32)
    taken = []
    for turn in range(len(place)):
        if not len(left):
            break
        p, r = place[left], rank[left]
        near = p[1:] == p[:-1] + 1
        take = np.ones(len(p), bool)
        if turn < 3:  # the first of a run alone: most runs are short
            take[1:] &= ~(near & (r[1:] >= r[:-1]))
            take[:-1] &= ~(near & (r[:-1] > r[1:]))
        else:
            begin = np.r_[True, ~near | (r[1:] != r[:-1])]
            first = np.flatnonzero(begin)
            before = np.r_[True, ~near | (r[:-1] > r[1:])][first]  # nothing better in front of the run
            after = np.r_[~near | (r[1:] > r[:-1]), True][np.r_[first[1:], len(p)] - 1]
            run = np.cumsum(begin) - 1
            take = (before & after)[run] & ((np.arange(len(p)) - first[run]) % 2 == 0)
        taken.append(left[take])
        stay = ~take
        stay[1:] &= ~(near & take[:-1])
        stay[:-1] &= ~(near & take[1:])
        left = left[stay]
    return np.sort(np.concatenate(taken)) if taken else left


def compress(ids: np.ndarray, ends: np.ndarray, least: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbol ends of documents, left, right): nonterminal r is ``base + r`` with base the largest id + 1.

    ``ends`` are the documents' ends in ``ids``, ascending. Ends when no pair is seen ``least`` times, or none of
    those would be replaced eight times (overlaps with better pairs take the rest).
    """
    sym = ids.astype(np.uint32)
    base = int(sym.max()) + 1 if len(sym) else 1
    last = np.zeros(len(sym), bool)
    last[np.asarray(ends)[np.diff(np.r_[0, ends]) > 0] - 1] = True
    left, right = [], []
    made, low = 0, 0  # low: symbols from here on are of the round before
    while len(sym) > 1:
        open_ = ~last[:-1]
        if low:
            fresh = sym >= low
            open_ &= fresh[:-1] | fresh[1:]
        place = np.flatnonzero(open_).astype(np.int32)
        narrow = base + made <= 1 << 16  # pairs then fit 32 bits
        half, kind = (16, np.uint32) if narrow else (32, np.uint64)
        key = (sym[place].astype(kind) << kind(half)) | sym[place + 1].astype(kind)
        pairs, times = _counted(key, least)
        used = np.zeros(0, np.int64)
        if len(pairs):
            rank_of = np.empty(len(pairs), np.int32)
            rank_of[np.argsort(-times, kind="stable")] = np.arange(len(pairs), dtype=np.int32)
            number = _number(key, pairs)
            seen = np.flatnonzero(number >= 0)
            place, number = place[seen], number[seen]
            for again in (False, True):  # again without the pairs that others leave too little of
                take = _apart(place, rank_of[number])
                used = np.bincount(number[take], minlength=len(pairs))
                few = used < 8
                if again or not (few & (used > 0)).any():
                    break
                enough = ~few[number]
                place, number = place[enough], number[enough]
        good = np.flatnonzero(used >= 8)
        if not len(good):
            if not low:
                break
            low = 0  # a last look at all pairs
            continue
        renumber = np.full(len(pairs), -1, np.int64)
        renumber[good] = np.arange(len(good))
        new = renumber[number[take]]
        take, new = place[take][new >= 0], new[new >= 0]
        left.append((pairs[good] >> kind(half)).astype(np.uint32))
        right.append((pairs[good] & kind((1 << half) - 1)).astype(np.uint32))
        last[take] = last[take + 1]
        low = base + made
        sym[take] = (low + new).astype(np.uint32)
        keep = np.ones(len(sym), bool)
        keep[take + 1] = False
        sym, last = sym[keep], last[keep]
        made += len(good)
    ends_now = np.zeros(len(ends), np.int64)
    filled = np.diff(np.r_[0, ends]) > 0
    ends_now[filled] = np.flatnonzero(last) + 1
    ends_now = np.maximum.accumulate(ends_now) if len(ends) else ends_now
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint32)
    return sym, ends_now, cat(left), cat(right)


def lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Expansion length of every rule; a rule refers only to earlier ones."""
    out: list[int] = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        out.append((out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1))
    return np.array(out, np.uint32)


def frame(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray, partition: int, number: int) -> bytes:
    sym, at, left, right = compress(ids, ends)
    base = int(ids.max()) + 1 if len(ids) else 1
    planes = max(0, (base + len(left) - 1).bit_length() - 16)
    body = b"".join((
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is None for x in doc_ids], "u1").tobytes(),
        np.diff(np.r_[0, at]).astype("<u4").tobytes(),
        left.astype("<u4").tobytes(),
        right.astype("<u4").tobytes(),
        lengths(left, right, base).astype("<u4").tobytes(),
        struct.pack("<IB", base, planes),
        sym.astype("<u2").tobytes(),
        *(np.packbits(sym >> np.uint32(16 + k) & np.uint32(1)).tobytes() for k in range(planes)),
    ))
    return MAGIC + struct.pack("<6I", len(doc_ids), len(left), len(sym), len(body), partition, number) + body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """One frame, decoded on demand."""

    def __init__(self, raw: bytes, at: int = 0):
        if raw[at : at + 6] != MAGIC:
            raise ValueError(f"no frame at byte {at}")
        docs, rules, symbols, size, self.partition, self.number = struct.unpack_from("<6I", raw, at + 6)
        p = at + 30
        if zlib.crc32(memoryview(raw)[p : p + size]) != struct.unpack_from("<I", raw, p + size)[0]:
            raise ValueError(f"the frame at byte {at} is damaged")
        self.end = p + size + 5

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal p
            out = np.frombuffer(raw, kind, n, p)
            p += out.nbytes
            return out

        ids, null, per = take("<i8", docs), take("u1", docs), take("<u4", docs)
        self.doc_ids = [None if z else x for x, z in zip(ids.tolist(), null.tolist(), strict=True)]
        self.left, self.right, self.length = take("<u4", rules), take("<u4", rules), take("<u4", rules)
        self.base, planes = struct.unpack_from("<IB", raw, p)
        p += 5
        self._flat: tuple[np.ndarray, np.ndarray] | None = None
        self.symbols = take("<u2", symbols).astype(np.int64)
        for k in range(planes):
            self.symbols |= np.unpackbits(take("u1", -(-symbols // 8)), count=symbols).astype(np.int64) << (16 + k)
        self.at = np.r_[0, np.cumsum(per, dtype=np.int64)]

    def _rules(self) -> tuple[np.ndarray, np.ndarray]:
        """Every rule's ids, one after the other, and where each begins."""
        if self._flat is None:
            sym = np.stack([self.left, self.right], 1).reshape(-1).astype(np.int64)
            while (big := sym >= self.base).any():  # a level of all rules at once
                at = np.cumsum(1 + big) - (1 + big)
                out = np.empty(len(sym) + int(big.sum()), np.int64)
                out[at] = sym
                rule = sym[big] - self.base
                out[at[big]], out[at[big] + 1] = self.left[rule], self.right[rule]
                sym = out
            start = self.base + np.cumsum(self.length, dtype=np.int64) - self.length
            self._flat = np.r_[np.arange(self.base), sym].astype(np.uint32), np.r_[np.arange(self.base), start]
        return self._flat

    def expand(self, sym: np.ndarray) -> np.ndarray:
        """The ids that ``sym`` stands for."""
        flat, start = self._rules()
        size = np.ones(len(start), np.int64)
        size[self.base :] = self.length
        size = size[sym]
        move = start[sym] - (np.cumsum(size) - size)
        return flat[np.repeat(move, size) + np.arange(int(size.sum()))]

    def sizes(self) -> np.ndarray:
        """Ids that each symbol stands for."""
        out = np.ones(len(self.symbols), np.int64)
        big = self.symbols >= self.base
        out[big] = self.length[self.symbols[big] - self.base]
        return out

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.at[k] : self.at[k + 1]])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids number ``start`` to ``stop`` of the shard, expanding only the symbols that hold them."""
        ends = np.cumsum(self.sizes())
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
        before = int(ends[a - 1]) if a else 0
        return self.expand(self.symbols[a : b + 1])[start - before : stop - before]


def shards(raw: bytes) -> Iterator[Shard]:
    at = 0
    while at < len(raw):
        s = Shard(raw, at)
        yield s
        at = s.end


def encoded(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """i, h (a hash of the text, for ties) and ids (little-endian, 4 bytes each, 2 where all ids fit) of every document with its end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        kind = "<u4" if tok.wide or end_id >= 1 << 16 else "<u2"
        for b in slices(batches, "t"):
            ids, ends = with_end(*tok.encode_column(b.column(2)), end_id)
            raw, at = ids.astype(kind), np.r_[0, ends] * int(kind[2])
            data = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), data.cast(pa.binary())], ["i", "h", "ids"])

    rows = docs.select(docs[id_col].cast("long").alias("i"), F.xxhash64(docs[text_col]).alias("h"), F.coalesce(docs[text_col], F.lit("")).alias("t"))
    return rows.mapInArrow(run, "i long, h long, ids binary")


def write_ids(docs: DataFrame, path: str, to: str, end_id: int = 0, shard_ids: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the folder ``to``: part files in ascending id order (nulls first, ties by text).

    Null and empty texts are documents of the end id alone. A frame holds about ``shard_ids`` ids; one longer
    document has a frame of its own. Ids, not texts, are shuffled; they are written first, as a range shuffle
    reads its input twice.
    """
    coded = written(encoded(docs, path, end_id, id_col, text_col), "coded")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = coded.repartitionByRange(n, F.col("i").asc_nulls_first(), "h").sortWithinPartitions(F.col("i").asc_nulls_first(), "h", "ids").select("i", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        kind = np.dtype("<u4" if tokenizer(path).wide or end_id >= 1 << 16 else "<u2")
        keys: list[int | None] = []
        raw: list[bytes] = []
        held = 0

        def full() -> pa.RecordBatch:
            sizes = np.array([len(x) // kind.itemsize for x in raw], np.int64)
            out = frame(keys, np.frombuffer(b"".join(raw), kind), np.cumsum(sizes), part, number)
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["frame"])

        for b in batches:
            for key, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                many = len(x) // kind.itemsize
                if held and held + many > shard_ids:
                    yield full()
                    number, held = number + 1, 0
                    keys, raw = [], []
                keys.append(key)
                raw.append(x)
                held += many
        if keys:
            yield full()

    out = rows.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    out.write.option("maxRecordsPerFile", 32).text(to)
    forget(coded)


def read_ids(spark, path: str) -> DataFrame:
    """Every document of the files under ``path``, decoded: partition, frame, place, doc_id, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                for s in shards(b.column(0)[k].as_py()):
                    ids = s.expand(s.symbols).astype("<u4", copy=False)
                    ends = np.r_[0, np.cumsum(s.sizes())][s.at]
                    sums = [zlib.crc32(ids[a:z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    n = len(s.doc_ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s.partition] * n, pa.int32()), pa.array([s.number] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(sums, pa.int64())],
                        ["part", "frame", "place", "doc_id", "n_tokens", "ids_crc32"],
                    )

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, "part int, frame int, place int, doc_id long, n_tokens long, ids_crc32 long")


def with_starts(rows: DataFrame) -> DataFrame:
    """Add start, the ids before each document: a sum over frames (one small row each), then within a frame."""
    per = rows.groupBy("part", "frame").agg(F.sum("n_tokens").alias("n"))
    parts = per.groupBy("part").agg(F.sum("n").alias("n"))
    running = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", running(Window.partitionBy(F.lit(0)).orderBy("part")).alias("part_base"))
    per = per.select("part", "frame", running(Window.partitionBy("part").orderBy("frame")).alias("frame_base"))
    base = per.join(parts, "part").select("part", "frame", (F.col("part_base") + F.col("frame_base")).alias("base"))
    inner = Window.partitionBy("part", "frame").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    return rows.join(base, ["part", "frame"]).withColumn("start", F.col("base") + F.col("inner"))


def round_trip(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` to the shared folder and read the files back."""
    spark = docs.sparkSession
    to = scratch_path(spark, "ids")
    write_ids(docs, path, to, end_id)
    return with_starts(written(read_ids(spark, to), "decoded")).select("doc_id", "start", "n_tokens", "ids_crc32")
