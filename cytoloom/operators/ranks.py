"""Exact order statistics in rounds, without keeping the values in one task.

A round takes a bounded quantile sketch of the values that are still in question and counts, exactly, how many lie
below, at, between and above two of its values around the wanted rank. The part that holds the rank goes on; some 5000
times fewer values each round, whatever their distribution. At most ``FEW`` values are sorted in the end. Each
round is two aggregations over the rows, so a table that is dear to compute should be written first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many values in question are collected and sorted.
FEW = 4096
#: The sketch is off by at most one rank in so many.
ACCURACY = 10_000


class _Target:
    """One wanted rank (from 0) of one column: the range it lies in, and the rank within."""

    def __init__(self, x: Column, rank: int, count: int):
        self.x, self.rank, self.count = x, rank, count
        self.inside = [x.isNotNull()]
        self.value = None

    def part(self) -> Column:
        return F.when(reduce(lambda a, b: a & b, self.inside), self.x)

    def sketch(self) -> Column:
        at = (self.rank + 0.5) / self.count
        return F.percentile_approx(self.part(), [max(0.0, at - 2 / ACCURACY), min(1.0, at + 2 / ACCURACY)], ACCURACY)

    def zones(self, lo, hi) -> list[tuple[Column, float | None]]:
        """Conditions that split the range in ascending order, and the value of those that hold one value only."""
        x = self.x
        one = [(x < F.lit(lo), None), (x == F.lit(lo), lo)]
        return one + ([(x > F.lit(hi), None)] if lo == hi else [((x > F.lit(lo)) & (x < F.lit(hi)), None), (x == F.lit(hi), hi), (x > F.lit(hi), None)])

    def narrow(self, zones: list[tuple[Column, float | None]], counts: Sequence[int]) -> None:
        before = self.count
        for (condition, value), n in zip(zones, counts, strict=True):
            if self.rank < n:
                self.inside.append(condition)
                self.count, self.value = n, value
                break
            self.rank -= n
        if self.value is None and self.count == before:
            raise ValueError("values too close to be told apart as doubles")


def ranked(rows: DataFrame, wanted: Sequence[tuple[Column, Sequence[int]]], counts: Sequence[int] | None = None) -> list[list]:
    """For each (number column, ranks from 0) the values at these ranks in ascending order; null and NaN have no rank.

    Ranks beyond the values give None. Equal values take as many ranks as there are; the order of rows does not matter.
    ``counts`` are the columns' numbers of values, if known.
    """
    columns = [F.nanvl(x.cast("double"), F.lit(None).cast("double")) if _floating(rows, x) else x for x, _ in wanted]
    if counts is None:
        counts = rows.agg(*(F.count(x) for x in columns)).first() if columns else []
    targets = [[_Target(x, r, n) if 0 <= r < n else None for r in ranks] for x, (_, ranks), n in zip(columns, wanted, counts, strict=True)]
    todo = [t for of in targets for t in of if t]
    while todo:
        large = [t for t in todo if t.count > FEW]
        if large:
            # One pass gives the sketches, one the counts.
            bounds = rows.agg(*(t.sketch() for t in large)).first()
            zones = [t.zones(*b) for t, b in zip(large, bounds, strict=True)]
            flat = rows.agg(*(F.count_if(reduce(lambda a, b: a & b, t.inside) & c) for t, z in zip(large, zones, strict=True) for c, _ in z)).first()
            at = 0
            for t, z in zip(large, zones, strict=True):
                t.narrow(z, flat[at : at + len(z)])
                at += len(z)
        small = [t for t in todo if t.value is None and t.count <= FEW]
        if small:
            got = rows.agg(*(F.get(F.array_sort(F.collect_list(t.part())), F.lit(t.rank)) for t in small)).first()
            for t, x in zip(small, got, strict=True):
                t.value = x
        todo = [t for t in todo if t.value is None]
    return [[t.value if t else None for t in of] for of in targets]


def _floating(rows: DataFrame, x: Column) -> bool:
    return rows.select(x.alias("x")).schema["x"].dataType.simpleString() in ("float", "double")


def quantiles(rows: DataFrame, wanted: Sequence[tuple[Column, Sequence[float]]]) -> list[list[float | None]]:
    """For each (number column, shares) its exact quantiles, linear between ranks; None where the column has no values.

    The same numbers as ``percentile`` gives, which keeps every different value in one task. NaN is left out.
    """
    columns = [F.nanvl(x.cast("double"), F.lit(None).cast("double")) for x, _ in wanted]
    counts = rows.agg(*(F.count(x) for x in columns)).first()
    places = [[q * (n - 1) for q in shares] if n else [] for (_, shares), n in zip(wanted, counts, strict=True)]
    ranks = [sorted({r for p in of for r in (int(p), min(int(p) + 1, n - 1))}) for of, n in zip(places, counts, strict=True)]
    found = ranked(rows, list(zip(columns, ranks, strict=True)), counts)
    out = []
    for (_, shares), of, r, v in zip(wanted, places, ranks, found, strict=True):
        value = dict(zip(r, v, strict=True))
        out.append([value[int(p)] if p == int(p) else (int(p) + 1 - p) * value[int(p)] + (p - int(p)) * value[int(p) + 1] for p in of] or [None] * len(shares))
    return out
