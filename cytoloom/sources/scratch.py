"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set a temporary one in local mode, on a cluster an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            at = tempfile.mkdtemp(prefix="cytoloom-")
        sc.setCheckpointDir(at)
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; what is written there is deleted at exit."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


@contextmanager
def _without_shuffles(spark: SparkSession) -> Iterator[None]:
    """What a query made here has shuffled is deleted when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder: later plans start there, and lost executors lose nothing."""
    shared_folder(df.sparkSession)
    with _without_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def kept(df: DataFrame, name: str = "table", most: int = 0) -> DataFrame:
    """As :func:`settled`, but as Parquet, which keeps statistics and which :func:`discard` can delete; at most ``most`` rows a file."""
    path = fresh_path(df.sparkSession, name)
    with _without_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").option("maxRecordsPerFile", most).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`kept` that nothing reads any more."""
    for t in tables:
        _made.remove((t.sparkSession, t._scratch))
        _delete(t.sparkSession, t._scratch)


def clear_scratch() -> None:
    """Delete every folder of :func:`fresh_path` that is left; results that read them must have been consumed."""
    while _made:
        try:
            _delete(*_made.pop())
        except Exception:  # the JVM may be gone at exit
            return


atexit.register(clear_scratch)
