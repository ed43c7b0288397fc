"""Boosted trees on binned features, for 0/1 labels, with missing values as such.

Columns are cut at exact quantiles; a missing value (null, NaN) has a bin of its own, and each split learns on which side missing
values go. Rows of equal bins are one cell with its positives and negatives. One job a level: every task adds up gradients per
(node, column, bin) of its cells, and what comes to the driver is bounded by nodes x columns x bins, not by rows. Gradients are
whole multiples of 2**-30, so sums, trees and scores are the same at every partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidemark.operators.quantiles import quantiles

UNIT = float(1 << 30)
#: Trees whose values are added to the cells' margins at a time.
CHUNK = 10
#: Beyond so many tasks their sums are added up in Spark before the driver gets them.
TASKS = 64
#: Cells of a partition, where there are fewer in all than its partitions could hold.
CELLS = 10_000


@dataclass
class Tree:
    """Nodes as in a heap: the root is 1, the children of i are 2 i and 2 i + 1."""

    depth: int
    column: np.ndarray = field(init=False)  # of the split; -1: a leaf
    cut: np.ndarray = field(init=False)  # bins up to it go left
    missing_left: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = 2 << self.depth
        self.column, self.cut = np.full(n, -1), np.zeros(n, np.int64)
        self.missing_left, self.value = np.zeros(n, bool), np.zeros(n)

    def node(self, bins: np.ndarray) -> np.ndarray:
        """Where rows of bins (columns x rows; 0 is missing) end."""
        at = np.ones(bins.shape[1], np.int64)
        for _ in range(self.depth):
            c = self.column[at]
            b = bins[np.maximum(c, 0), np.arange(len(at))]
            left = np.where(b == 0, self.missing_left[at], b <= self.cut[at])
            at = np.where(c < 0, at, 2 * at + 1 - left)
        return at


def gradients(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a positive, of a negative, and the second derivative, in units."""
    p = 1 / (1 + np.exp(-margin))
    return tuple(np.rint(x * UNIT).astype(np.int64) for x in (p - 1, p, p * (1 - p)))


@dataclass
class Boosted:
    """A fitted model: binned columns with their edges, trees, and the gain of each column's splits."""

    columns: list[str]
    edges: list[np.ndarray]
    start: float
    rate: float
    trees: list[Tree]
    gain: np.ndarray

    @property
    def importance(self) -> dict[str, float]:
        """Shares of the gain; all 0 where nothing was split."""
        total = self.gain.sum()
        return {c: float(g / total) if total else 0.0 for c, g in zip(self.columns, self.gain, strict=True)}

    def score(self) -> Column:
        """The probability of label 1, as a column over ``columns``."""
        edges, trees, start = self.edges, self.trees, self.start

        def run(*values: pd.Series) -> pd.Series:
            bins = np.stack([binned(v.to_numpy(np.float64, na_value=np.nan), e) for v, e in zip(values, edges, strict=True)])
            margin = np.full(bins.shape[1], start)
            for t in trees:
                margin += t.value[t.node(bins)]
            return pd.Series(1 / (1 + np.exp(-margin)))

        return F.pandas_udf(run, "double")(*(F.col(c).cast("double") for c in self.columns))


def binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """0 for a missing value, else 1 and the number of edges below it."""
    return np.where(np.isnan(values), 0, 1 + np.searchsorted(edges, values, "left"))


def _bin(c: str, edges: np.ndarray) -> Column:
    """``binned`` in Spark: a search in a sorted array."""
    v = F.col(c).cast("double")
    above = F.lit(1)
    if len(edges):
        above = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e < v)) + 1
    return F.when(v.isNull() | F.isnan(v), 0).otherwise(above).cast("short")


def _best(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[float, int, int, bool] | None:
    """The split of one node (columns x bins of sums in units): gain, column, cut, side of missing values. Of equal ones the first."""
    n = g.shape[1]
    total_g, total_h = int(g[0].sum()), int(h[0].sum())
    gl, hl = np.cumsum(g[:, 1:], axis=1)[:, :-1], np.cumsum(h[:, 1:], axis=1)[:, :-1]
    gl, hl = (np.stack([x + m[:, :1], x], axis=2) for x, m in ((gl, g), (hl, h)))  # with missing values on the left, and not
    # missing values against all others
    gl, hl = (np.concatenate([x, np.stack([m[:, 0], m[:, 0]], axis=1)[:, None, :]], axis=1) for x, m in ((gl, g), (hl, h)))
    gr, hr = total_g - gl, total_h - hl
    gain = _weight(gl, hl, l2) + _weight(gr, hr, l2) - _weight(np.array(total_g), np.array(total_h), l2)
    gain[(hl < least * UNIT) | (hr < least * UNIT)] = -1.0
    i = int(np.argmax(gain))
    if gain.flat[i] <= 0:
        return None
    column, cut, side = np.unravel_index(i, gain.shape)
    return float(gain.flat[i]), int(column), 0 if cut == n - 2 else int(cut) + 1, cut == n - 2 or side == 0


def _weight(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return (g / UNIT) ** 2 / (h / UNIT + l2)


def fit(rows: DataFrame, columns: Sequence[str], label: str = "label", trees: int = 100, depth: int = 5, bins: int = 64, rate: float = 0.1, l2: float = 1.0, least: float = 1.0) -> Boosted:
    """Fit to rows with a 0/1 label (another is an error).

    ``rate`` scales each tree, ``l2`` shrinks leaves, ``least`` is the sum of second derivatives that both sides of a split must have. A
    column without values, and one with a single value and none missing, is never split. Labels of one kind give a model without
    trees. No rows are an error.
    """
    columns = list(columns)
    named = rows.select(*(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)), F.col(label).cast("int").alias("y")).persist()
    known = [F.when(~F.isnan(f"v{i}"), F.col(f"v{i}")).alias(f"v{i}") for i in range(len(columns))]
    found = quantiles(named.select(*known), [f"v{i}" for i in range(len(columns))], [j / bins for j in range(1, bins)])
    edges = [np.array(sorted({found[f"v{i}", j / bins] for j in range(1, bins)} - {None})) for i in range(len(columns))]
    y = F.when(F.col("y").isNull() | ~F.col("y").isin(0, 1), F.raise_error(F.lit("a label is neither 0 nor 1"))).otherwise(F.col("y"))
    cells = named.select(*(_bin(f"v{i}", e).alias(f"b{i}") for i, e in enumerate(edges)), y.cast("long").alias("y"))
    cells = cells.groupBy(*(f"b{i}" for i in range(len(columns)))).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).persist()
    try:
        cells.count()
        named.unpersist()
        total = cells.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
        if total.pos is None:
            raise ValueError("no rows to fit to")
        model = Boosted(columns, edges, 0.0, rate, [], np.zeros(len(columns)))
        if not total.pos or not total.neg:
            model.start = float(np.log((total.pos + 0.5) / (total.neg + 0.5)))
            return model
        model.start = float(np.log(total.pos / total.neg))
        blocks = _blocks(cells, len(columns))
        held = _held(blocks, model)
        while len(model.trees) < trees:
            tree = _grow(held, model.trees[len(model.trees) // CHUNK * CHUNK :], model, depth, l2, least)
            if tree is None:
                break
            model.trees.append(tree)
            if len(model.trees) % CHUNK == 0 and len(model.trees) < trees:
                last = held
                held = _held(blocks, model)
                last.unpersist()
        held.unpersist()
        return model
    finally:
        cells.unpersist()


def _blocks(cells: DataFrame, n: int) -> RDD:
    """Cells as arrays: bins (columns x cells), positives, negatives. Few cells are in few partitions: each level is a job of its own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_numpy().astype("<i8").tobytes() for i in range(n + 2)]
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(columns)], pa.binary())], names=["x"])

    def unpack(row: Row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.frombuffer(row.x, "<i8").reshape(n + 2, -1)
        return x[:n].astype(np.int16), x[n], x[n + 1]

    blocks = cells.mapInArrow(pack, "x binary").rdd
    few = max(1, -(-cells.count() // CELLS))
    return (blocks.coalesce(few) if few < blocks.getNumPartitions() else blocks).map(unpack)


def _held(blocks: RDD, model: Boosted) -> RDD:
    """Cells with their margins by the trees there are, kept. What is lost is computed from the cells again."""
    trees, start = list(model.trees), model.start

    def run(block: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
        bins = block[0]
        margin = np.full(bins.shape[1], start)
        for t in trees:
            margin += t.value[t.node(bins)]
        return *block, margin

    return blocks.map(run).persist(StorageLevel.MEMORY_AND_DISK)


def _grow(held: RDD, done: list[Tree], model: Boosted, depth: int, l2: float, least: float) -> Tree | None:
    """One more tree; None if not even its root can be split. ``done``: trees that the cells' margins do not have yet."""
    n, width = len(model.edges), 2 + max((len(e) for e in model.edges), default=0)
    tree, open_nodes = Tree(depth), [1]
    for level in range(depth):
        size = (1 << level) * n * width
        first = 1 << level

        def run(blocks: Iterator[tuple[np.ndarray, ...]], first: int = first, size: int = size) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            g, h = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for bins, pos, neg, margin in blocks:
                margin = margin.copy()
                for t in done:
                    margin += t.value[t.node(bins)]
                node = tree.node(bins) - first
                of_pos, of_neg, second = gradients(margin)
                here = node >= 0  # others are in leaves above
                for c in range(n):
                    slot = ((node * n + c) * width + bins[c])[here]
                    np.add.at(g, slot, (pos * of_pos + neg * of_neg)[here])
                    np.add.at(h, slot, ((pos + neg) * second)[here])
            yield g, h

        def add(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            return a[0] + b[0], a[1] + b[1]

        sums = held.mapPartitions(run)
        g, h = sums.treeReduce(add) if held.getNumPartitions() > TASKS else reduce(add, sums.collect())
        g, h = (x.reshape(first, n, width) for x in (g, h))
        further = []
        for i in open_nodes:
            split = _best(g[i - first], h[i - first], l2, least)
            if split is None:
                continue
            gain, c, cut, left = split
            tree.column[i], tree.cut[i], tree.missing_left[i] = c, cut, left
            model.gain[c] += gain
            of_g, of_h = g[i - first, c], h[i - first, c]
            goes = np.arange(width) <= cut
            goes[0] = left
            for child, side in ((2 * i, goes), (2 * i + 1, ~goes)):
                a, b = int(of_g[side].sum()), int(of_h[side].sum())
                tree.value[child] = -model.rate * (a / UNIT) / (b / UNIT + l2)
                further.append(child)
        if not further:
            break
        open_nodes = further
    return tree if tree.column[1] >= 0 else None
