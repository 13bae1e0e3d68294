"""Shared pieces: scratch tables in the cluster's shared folder, Arrow text access, hashed words."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset a temporary one in local mode, on a cluster an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="cytoloom-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/cytoloom/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    # What the query has shuffled is deleted when it ends, not when the driver happens to collect its garbage.
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing reads any more."""
    for t in tables:
        _made.remove((t.sparkSession, t._scratch))
        _delete(t.sparkSession, t._scratch)


def clear_scratch() -> None:
    """Delete every scratch folder that is left; results that read them must have been consumed."""
    while _made:
        try:
            _delete(*_made.pop())
        except Exception:  # the JVM may be gone at exit
            return


atexit.register(clear_scratch)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and its row offsets, without making Python strings; null: no bytes."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds about ``limit`` bytes of text (one longer row stays whole) and at most ``rows`` rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8_of(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = min(max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1), start + rows)
            yield batch.slice(start, stop - start)
            start = stop


# ------------------------------------------------------------------ hashed words

_B = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_R = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # only A-Z
_RLOW = _R[_FOLD]
#: Bytes hashed at once: the two tables of powers that a worker keeps have this many entries (2 MB each).
_STEP = 1 << 18
_pow: list[np.ndarray] = []


def _is_space() -> np.ndarray:
    t = np.ones(256, bool)
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return t


def _is_alnum() -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z are lowered."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    return t


SPACE_WORDS, ALNUM_WORDS = _is_space(), _is_alnum()


def _powers() -> list[np.ndarray]:
    """The first _STEP powers of the base and of its inverse."""
    if not _pow:
        for base in (_B, pow(_B, -1, 1 << 64)):
            p = np.full(_STEP, base & _MASK, np.uint64)
            p[0] = 1
            _pow.append(np.cumprod(p, dtype=np.uint64))
    return _pow


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hashed(raw: np.ndarray, s: np.ndarray, e: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the byte spans ``raw[s:e]`` (ascending, apart); with ``fold`` A-Z count as a-z.

    The hash is a polynomial over random 64-bit values of the bytes, then mixed: two of a corpus's n spans
    clash with probability about n^2 / 2^65. Bytes are taken _STEP at a time, however long a span is.
    """
    table, (p, q) = _RLOW if fold else _R, _powers()
    out = np.empty(len(s), np.uint64)
    k = 0
    while k < len(s):
        stop = int(np.searchsorted(e, s[k] + _STEP, "right"))
        if stop > k:
            a, b = int(s[k]), int(e[stop - 1])
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(table[raw[a:b]] * p[: b - a], out=total[1:])
            x, y = s[k:stop] - a, e[k:stop] - a
            out[k:stop] = (total[y] - total[x]) * q[x] + (y - x).astype(np.uint64)
            k = stop
        else:  # one span longer than a step
            acc, up = 0, pow(_B, _STEP, 1 << 64)
            for a in reversed(range(int(s[k]), int(e[k]), _STEP)):
                block = table[raw[a : min(a + _STEP, int(e[k]))]]
                acc = (acc * up + int((block * p[: len(block)]).sum(dtype=np.uint64))) & _MASK
            out[k] = (acc + int(e[k] - s[k])) & _MASK
            k += 1
    return mix(out)


def words_of(raw: np.ndarray, at: np.ndarray, kind: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows at once: 64-bit hashes, words before each row, and byte starts and ends.

    A word is a longest run of bytes of ``kind`` inside one row; with ``fold`` A-Z count as a-z.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = kind[raw]
    change = np.empty(n + 1, bool)
    change[0] = change[n] = False
    np.not_equal(inside[1:], inside[:-1], out=change[1:n])
    change[at] = True  # also the end
    begins = change[:n] & inside
    change[1:] &= inside
    change[0] = False
    s, e = np.flatnonzero(begins), np.flatnonzero(change)
    return hashed(raw, s, e, fold), np.searchsorted(s, at), s, e


def shingles_of(h: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` words in a row and the row of each; a row of fewer words, but not none, has one of all its words."""
    count = np.diff(before)
    starts = np.maximum(count - (k - 1), 0)
    starts[(count > 0) & (count < k)] = 1
    rows = np.repeat(np.arange(len(count), dtype=np.int32), starts)
    out = np.zeros(len(rows), np.uint64)
    whole = np.repeat(count >= k, starts)
    if whole.any():
        m = len(h) - k + 1
        acc = h[:m].copy()
        for j in range(1, k):
            acc *= np.uint64(_B)
            acc += h[j : j + m]
        inside = np.ones(len(h), bool)  # windows that end in their row
        for j in range(1, k):
            inside[np.maximum(before[1:] - j, before[:-1])[count > 0]] = False
        out[whole] = mix(acc[inside[:m]] + np.uint64(k))
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        one = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            one[has] = one[has] * np.uint64(_B) + h[before[short[has]] + j]
        out[~whole] = mix(one + count[short].astype(np.uint64))
    return out, rows


def signed(h: np.ndarray) -> np.ndarray:
    """As Spark's longs."""
    return h.view(np.int64)
