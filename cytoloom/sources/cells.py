"""Reading and writing cell tables: (ord, cell_id, v) with a panel of feature names kept beside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scratch import settled


def with_ord(rows: DataFrame, key: str | None = None) -> DataFrame:
    """Add a dense ord from 0: by ``key`` if given, else in reading order.

    Rows are numbered in their partitions and moved by the counts of the partitions before, so no task sees all rows;
    they are kept in the shared folder first, as numbers must not change when a partition is read again.
    """
    rows = settled(rows if key is None else rows.orderBy(key))
    rows = rows.withColumn("_n", F.monotonically_increasing_id())  # partition number << 33 | number in it
    part = F.shiftright("_n", 33)
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_c")).select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))  # a row per partition
    names = [c for c in rows.columns if c != "_n"]
    return rows.withColumn("_p", part).join(F.broadcast(base), "_p").select((F.col("_b") + F.col("_n").bitwiseAND((1 << 33) - 1)).alias("ord"), *names)


def read_cells(spark: SparkSession, path: str, features: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """A CSV with a header and the cell id in its first column: cells (ord, cell_id, v double) and the panel.

    Only the header is read to get the names; every value is parsed as a double (others become null, then NaN).
    """
    names = spark.read.option("header", True).csv(path).columns
    panel = names[1:]
    schema = T.StructType([T.StructField("cell_id", T.StringType()), *(T.StructField(f"f{i}", T.DoubleType()) for i in range(len(panel)))])
    rows = spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(path)
    keep = [panel.index(f) for f in features] if features else range(len(panel))
    v = F.array(*(F.coalesce(F.col(f"f{i}"), F.lit(float("nan"))) for i in keep))
    return with_ord(rows.select("cell_id", v.alias("v"))), [panel[i] for i in keep]


def read_reference(spark: SparkSession, latent: str, protein: str, mrna: str) -> dict[str, tuple[DataFrame, list[str]]]:
    """The reference set's three tables by name."""
    return {name: read_cells(spark, path) for name, path in (("latent", latent), ("protein", protein), ("mrna", mrna))}


def read_query(spark: SparkSession, blanks: str, protein: str, size: str, spatial: str, convert: bool = False, border: float = 564000) -> tuple[DataFrame, list[str]]:
    """The query set as one table (ord, cell_id, v, blanks, size, x, y, z), converted to nm and cut at the border on request."""
    from ..operators.gates import border_filter, unit_convert

    cells, panel = read_cells(spark, protein)
    part = lambda path, name: read_cells(spark, path)[0].select("cell_id", F.col("v").alias(name))
    rows = cells.join(part(blanks, "blanks"), "cell_id").join(part(size, "s"), "cell_id").join(part(spatial, "p"), "cell_id")
    rows = rows.select("ord", "cell_id", "v", "blanks", F.get("s", F.lit(0)).alias("size"), *(F.get("p", F.lit(i)).alias(c) for i, c in enumerate("xyz")))
    return border_filter(unit_convert(rows) if convert else rows, border), panel


def from_wide(rows: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Cells from an in-memory table with one column per feature, numbered in the table's order."""
    return with_ord(rows.select(F.col(key).cast("string").alias("cell_id"), F.array(*(F.col(f"`{f}`").cast("double") for f in features)).alias("v")))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id, label) of a CSV with a header."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col(rows.columns[0]).alias("cell_id"), F.col(rows.columns[1]).alias("label"))


def read_cluster_names(spark: SparkSession, path: str) -> DataFrame:
    """(cluster int, name) of lines ``name: i, j, k``."""
    line = spark.read.text(path).where(F.contains("value", F.lit(":")))
    parts = F.split("value", ":", 2)
    return line.select(F.trim(F.get(parts, F.lit(0))).alias("name"), F.explode(F.split(F.get(parts, F.lit(1)), ",")).alias("i")).where(F.trim("i") != "").select(F.trim("i").cast("int").alias("cluster"), "name")


def write_wide(cells: DataFrame, panel: list[str], path: str) -> None:
    """A CSV with a header: cell_id, then one column per feature."""
    cells.select("cell_id", *(F.get("v", F.lit(i)).alias(f) for i, f in enumerate(panel))).write.option("header", True).csv(path)
