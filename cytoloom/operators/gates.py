"""Projections, filters, subsets and marker gates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import quantiles, ranked


def unit_convert(rows: DataFrame, xy: float = 188, z: float = 900) -> DataFrame:
    """Voxels to nm: x and y from 1 at their global minimum (before any filter) times ``xy``, z times ``z``."""
    low = rows.agg(F.min("x").alias("_mx"), F.min("y").alias("_my"))
    out = rows.crossJoin(F.broadcast(low))  # one row
    out = out.withColumn("x", (F.col("x") - (F.col("_mx") - 1)) * xy).withColumn("y", (F.col("y") - (F.col("_my") - 1)) * xy)
    return out.withColumn("z", F.col("z") * z).drop("_mx", "_my")


def border_filter(rows: DataFrame, border: float = 564000) -> DataFrame:
    """x and y both below the border; a border of 0 or less keeps all."""
    return rows.where((F.col("x") < border) & (F.col("y") < border)) if border > 0 else rows


def common_panel(query: Sequence[str], ref: Sequence[str]) -> list[str]:
    """Features of both, in the query's order; at least two are needed."""
    have = set(ref)
    out = [f for f in query if f in have]
    if len(out) < 2:
        raise ValueError("the two panels share fewer than two features")
    return out


def select_panel(cells: DataFrame, panel: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """``cells`` with v reduced to the wanted features, in their order."""
    at = {f: i for i, f in enumerate(panel)}
    return cells.withColumn("v", F.array(*(F.get("v", F.lit(at[f])) for f in wanted)))


def blank_size_gate(rows: DataFrame, size_limits: Sequence[float] | None = (1000, 25000), lower: Sequence[float] | None = (-1200,) * 4, upper: Sequence[float] | None = (6000, 2500, 5000, 2500)) -> DataFrame:
    """Keep rows with any blank at or above its lower limit, all at or below their upper ones, and size in the limits.

    A missing limit is an exact quantile: 0.002 and 0.995 per blank, 0.025 and 0.99 of the size; so is a size
    range whose lower end is not below its upper one. Quantiles are found in rounds over the rows (see ``ranks``); null
    and NaN do not count for them. Without any value there is no limit to keep to, and no row is kept.
    """
    derive = size_limits is None or size_limits[0] >= size_limits[1]
    n = len(lower or upper or ()) or rows.select(F.max(F.size("blanks"))).first()[0] or 0
    if n < 1:
        return rows.where(F.lit(False))  # no blank reaches a limit
    if lower is None or upper is None or derive:
        wanted = [(F.get("blanks", F.lit(i)), (0.002, 0.995)) for i in range(n)] if lower is None or upper is None else []
        got = quantiles(rows, wanted + ([(F.col("size"), (0.025, 0.99))] if derive else []))
        if any(x is None for of in got for x in of):
            return rows.where(F.lit(False))
        lower = [got[i][0] for i in range(n)] if lower is None else lower
        upper = [got[i][1] for i in range(n)] if upper is None else upper
        size_limits = tuple(got[-1]) if derive else size_limits
    blank = lambda i: F.get("blanks", F.lit(i))
    some = reduce(lambda a, b: a | b, (blank(i) >= lower[i] for i in range(n)))
    every = reduce(lambda a, b: a & b, (blank(i) <= upper[i] for i in range(n)))
    return rows.where(some & every & F.col("size").between(*size_limits))


def take_subset(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows by ord; all of them for n <= 0."""
    return rows.where(F.col("ord") < n) if n > 0 else rows


def drop_nan(cells: DataFrame) -> DataFrame:
    """Rows whose values are all numbers."""
    return cells.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))


Gate = tuple[int | tuple[int, ...], float | tuple[float, ...]]


def marker_gate(cells: DataFrame, gates: Sequence[Gate]) -> DataFrame:
    """(ord, cluster): gate i (from 1) holds the top floor(t n) cells of a feature (ties: smaller ord); later gates win, else -1.

    A gate of several features is the intersection of their top sets, each with its own share. NaN stands highest, null
    lowest. The k-th value of a feature, and the largest ord of the cells that tie with it and are still in, are found by
    selection (see ``ranks``): cells are neither sorted, joined nor shuffled, whatever their number.
    """
    n = cells.count()
    pairs = [list(zip(*((f, t) if isinstance(f, tuple) else ((f,), (t,))), strict=True)) for f, t in gates]
    tops = sorted({(f, int(t * n)) for of in pairs for f, t in of})
    level = {f: F.when(F.isnan(x), F.lit(float("inf"))).otherwise(F.coalesce(x, F.lit(float("-inf")))) for f, _ in tops for x in [F.get("v", F.lit(f)).cast("double")]}
    some = [(f, k) for f, k in tops if 0 < k < n]
    edge = dict(zip(some, (v[0] for v in ranked(cells, [(level[f], [n - k]) for f, k in some], [n] * len(some))), strict=True))
    # Of the cells at the k-th value only the first by ord are in.
    above = cells.agg(*(F.count_if(level[f] > F.lit(x)) for (f, _), x in edge.items()), *(F.count_if(level[f] == F.lit(x)) for (f, _), x in edge.items())).first() if edge else []
    room = [k - above[i] for i, (_, k) in enumerate(edge)]
    ties = [F.when(level[f] == F.lit(x), F.col("ord")) for (f, _), x in edge.items()]
    last = dict(zip(edge, (v[0] for v in ranked(cells, [(t, [r - 1]) for t, r in zip(ties, room, strict=True)], above[len(edge) :])), strict=True))
    inside = {(f, k): F.lit(k >= n) if (f, k) not in edge else (level[f] > F.lit(edge[f, k])) | ((level[f] == F.lit(edge[f, k])) & (F.col("ord") <= F.lit(last[f, k]))) for f, k in tops}
    label = F.lit(-1)
    for i, of in enumerate(pairs, 1):
        label = F.when(reduce(lambda a, b: a & b, (inside[f, int(t * n)] for f, t in of)), F.lit(i)).otherwise(label)
    return cells.select("ord", label.cast("int").alias("cluster"))


def row_sum() -> Column:
    return F.aggregate("v", F.lit(0.0), lambda a, x: a + x)


def top_k(rows: DataFrame, by: str, k: int, partition: str) -> DataFrame:
    """The ``k`` smallest rows per partition, ties by ord."""
    w = Window.partitionBy(partition).orderBy(by, "ord")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
