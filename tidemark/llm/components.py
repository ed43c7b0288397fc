"""Connected components of a graph in a DataFrame, without a step on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .scratch import Scratch

#: Edges that a task looks at together, and edges a task of the rounds gets at least.
CHUNK_EDGES, TASK_EDGES = 1_000_000, 250_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the same components as edges (a, b), each from a node to the smallest one of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends.ravel()[: len(a)], ends.ravel()[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(p[apart], q[apart]), np.minimum(p[apart], q[apart]))
        while (root[root] != root).any():
            root = root[root]
    keep = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[keep], nodes[root[keep]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (a > b) with those that a task sees together replaced by stars: long paths get short before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            a, b = stars(t.column(0).to_numpy(), t.column(1).to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= CHUNK_EDGES:
                yield out()
                held = []
        if held:
            yield out()
        bt.release()

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node that links reach. Loops count for nothing.

    First each task replaces its edges by stars. Then large-star steps (a node's larger neighbours go to its smallest
    neighbour) and small-star steps (its smaller neighbours do) alternate, each a group-by minimum and a join, until
    nothing changes; rounds grow with the logarithm of the longest path. Every round is written to the shared folder,
    by as many tasks as there are edges for.
    """
    # an edge is kept from its larger to its smaller end
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    given = scratch.keep(f"{name}-given", down)
    tasks = max(1, given.count() // TASK_EDGES)
    now = scratch.keep(f"{name}-0", _contracted(given.coalesce(tasks)))
    scratch.drop(f"{name}-given")
    # edges are distinct, so their number and two sums of hashes tell whether anything changed
    state = [F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))]
    before = now.agg(*state).first()
    for i in range(1, rounds + 1):
        around = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = around.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.keep(f"{name}-{i}-large", large.coalesce(tasks))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).distinct()
        after = scratch.keep(f"{name}-{i}", small.coalesce(tasks))
        # stars: every node has one edge, to a node that has none of its own
        found = after.agg(*state).first()
        scratch.drop(f"{name}-{i - 1}", f"{name}-{i}-large")
        now = after
        if found == before:
            break
        before = found
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
