"""Exact quantiles of columns of any number of distinct values, by selection.

Order statistics are found by narrowing: a mergeable sketch proposes two values around a rank, one exact count says between which
of them it lies, and so on with what is left; an interval of few rows is sorted whole. Each pass serves all columns and
ranks together, and the interval shrinks by orders of magnitude whatever the distribution, so two or three passes do for any
table. No task and no buffer holds the distinct values of a column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of an interval that are sorted whole.
FEW = 20_000
#: The sketch's rank error is 1 / ACCURACY of the rows it sees.
ACCURACY = 10_000


@dataclass(frozen=True)
class _Interval:
    """Values above ``low`` and below ``high`` (None: no bound), ``inside`` of them, with ``below`` values up to ``low``."""

    column: str
    low: float | None
    high: float | None
    below: int
    inside: int

    def holds(self, v: Column) -> Column:
        low = F.lit(True) if self.low is None else v > F.lit(self.low)
        return v.isNotNull() & low & (F.lit(True) if self.high is None else v < F.lit(self.high))


def _values(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column(i).drop_null().to_numpy(zero_copy_only=False)


def _counted(rows: DataFrame, cuts: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For sorted values of some columns (by number): how many rows lie below each, and how many are equal to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {i: np.zeros(2 * len(vs) + 1, np.int64) for i, vs in cuts.items()}
        for batch in batches:
            for i, vs in cuts.items():
                x = _values(batch, i)
                low = np.searchsorted(vs, x, "left")
                sums[i] += np.bincount(low + np.searchsorted(vs, x, "right"), minlength=2 * len(vs) + 1)
        for i, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, np.int32)), pa.array(some), pa.array(n[some])], names=["i", "slot", "n"])

    out = {i: np.zeros(2 * len(vs) + 1, np.int64) for i, vs in cuts.items()}
    for r in rows.mapInArrow(run, "i int, slot long, n long").groupBy("i", "slot").agg(F.sum("n").alias("n")).collect():
        out[r.i][r.slot] = r.n
    # even slots lie between two values, odd ones are a value
    return {i: (np.cumsum(n)[:-1:2], n[1::2]) for i, n in out.items()}


def _inside(rows: DataFrame, intervals: list[tuple[int, _Interval]]) -> list[np.ndarray]:
    """All values of intervals (with their column's number), sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {i: np.sort(_values(batch, i)) for i in {i for i, _ in intervals}}
            at, values = [], []
            for j, (i, y) in enumerate(intervals):
                a = 0 if y.low is None else np.searchsorted(x[i], y.low, "right")
                b = len(x[i]) if y.high is None else np.searchsorted(x[i], y.high, "left")
                if b > a:
                    at.append(j)
                    values.append(x[i][a:b])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(values, pa.list_(pa.float64()))], names=["at", "x"])

    parts: list[list[np.ndarray]] = [[] for _ in intervals]
    got = rows.mapInArrow(run, "at int, x array<double>").toArrow()
    for j, x in zip(got.column("at").to_pylist(), got.column("x"), strict=True):
        parts[j].append(x.values.to_numpy(zero_copy_only=False))
    return [np.sort(np.concatenate(p)) for p in parts]


def order_statistics(df: DataFrame, ranks: dict[str, Sequence[int]], sizes: dict[str, int], few: int = FEW, accuracy: int = ACCURACY) -> dict[tuple[str, int], float]:
    """The values of given ranks (from 0) of numeric columns; sizes: how many values that are not null a column has."""
    value = {c: F.col(f"`{c}`").cast("double") for c in ranks}
    number = {c: i for i, c in enumerate(ranks)}
    rows = df.select(*(value[c].alias(f"v{i}") for c, i in number.items()))
    todo: dict[tuple[str, int], _Interval] = {(c, r): _Interval(c, None, None, 0, sizes[c]) for c, rs in ranks.items() for r in rs}
    found: dict[tuple[str, int], float] = {}
    while todo:
        wanted: dict[_Interval, list[int]] = {}
        for (_, r), x in todo.items():
            wanted.setdefault(x, []).append(r)
        # each interval: all of its values if they are few, else values that the sketch puts around each of its ranks
        small = [x for x in wanted if x.inside <= few]
        if small:
            for x, values in zip(small, _inside(rows, [(number[x.column], x) for x in small]), strict=True):
                for r in wanted[x]:
                    found[x.column, r] = float(values[r - x.below])
                    del todo[x.column, r]
        large = [x for x in wanted if x.inside > few]
        if not large:
            continue
        near = [sorted({min(1.0, max(0.0, (r - x.below + d) / x.inside + e)) for r in wanted[x] for d, e in ((0, -2 / accuracy), (1, 2 / accuracy))}) for x in large]
        row = df.agg(*(F.percentile_approx(F.when(x.holds(value[x.column]), value[x.column]), ps, accuracy).alias(f"v{j}") for j, (x, ps) in enumerate(zip(large, near, strict=True)))).first()
        cuts: dict[int, np.ndarray] = {}
        for j, x in enumerate(large):
            i = number[x.column]
            cuts[i] = np.unique(np.concatenate([cuts.get(i, np.zeros(0)), np.array(row[f"v{j}"], float)]))
        counted = _counted(rows, cuts)
        for x in large:
            vs, (lesses, sames) = cuts[number[x.column]], counted[number[x.column]]
            for r in wanted[x]:
                # the last value with no more than r rows below it: r is one of its rows, or lies between it and the next
                k = int(np.searchsorted(lesses, r, "right")) - 1
                if k >= 0 and r < lesses[k] + sames[k]:
                    found[x.column, r] = float(vs[k])
                    del todo[x.column, r]
                    continue
                low, below = (x.low, x.below) if k < 0 else (float(vs[k]), int(lesses[k] + sames[k]))
                high, upto = (x.high, x.below + x.inside) if k + 1 >= len(vs) else (float(vs[k + 1]), int(lesses[k + 1]))
                if below < x.below:
                    low, below = x.low, x.below
                if upto > x.below + x.inside:
                    high, upto = x.high, x.below + x.inside
                todo[x.column, r] = _Interval(x.column, low, high, below, upto - below)
    return found


def quantiles(df: DataFrame, columns: Sequence[str], fractions: Sequence[float], few: int = FEW, accuracy: int = ACCURACY) -> dict[tuple[str, float], float | None]:
    """Continuous quantiles (between the two nearest values, by distance) of numeric columns; None for a column without values. NaN is above all numbers."""
    row = df.agg(*(F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns))).first()
    sizes = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    at = {(c, f): f * (sizes[c] - 1) for c in columns for f in fractions if sizes[c]}
    ranks: dict[str, list[int]] = {}
    for (c, _), p in at.items():
        ranks.setdefault(c, []).extend({math.floor(p), math.ceil(p)})
    found = order_statistics(df, {c: sorted(set(r)) for c, r in ranks.items()}, sizes, few, accuracy)
    out: dict[tuple[str, float], float | None] = {(c, f): None for c in columns for f in fractions}
    for (c, f), p in at.items():
        a, b = found[c, math.floor(p)], found[c, math.ceil(p)]
        out[c, f] = a if a == b else a + (b - a) * (p - math.floor(p))
    return out
