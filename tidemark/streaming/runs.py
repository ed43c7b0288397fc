"""The online evaluator: sorted runs of an entity's events with running sums, answered by binary search.

It shares no window and no frame with the batch build, so that comparing the two says something. ``EntityRun`` is one
entity in memory, for lookups without a Spark job; ``sorted_runs`` and ``look_up`` are the same for a whole store: runs are cut into
segments of bounded length, each end of a window goes to the one segment that can hold its answer, and segments and questions
stream by in order.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeutil import from_micros, micros, whole_seconds
from tidemark.operators.asof import asof_join
from tidemark.operators.carry import BUCKET_ROWS, HOT_ROWS, dealt
from tidemark.operators.features import prefix_sums
from tidemark.plans.catalog import FeatureCatalog

#: Events of a segment.
SEGMENT = 4096


class EntityRun:
    """One entity's events by instant; [cutoff - window, cutoff) is a pair of places found by bisection."""

    def __init__(self, events: Iterable[tuple[int, float]] = ()):
        rows = sorted(events)
        self.times = [us for us, _ in rows]
        self.sums = [0.0, *accumulate(a for _, a in rows)]

    def __len__(self) -> int:
        return len(self.times)

    def add(self, us: int, amount: float) -> None:
        at = bisect_right(self.times, us)
        self.times.insert(at, us)
        self.sums[at + 1 :] = [self.sums[at] + amount, *(s + amount for s in self.sums[at + 1 :])]

    def values(self, catalog: FeatureCatalog, us: int) -> list:
        """The catalog's features as of an instant, in its order."""
        end = bisect_left(self.times, us)
        out: list = []
        for f in catalog.features:
            low = bisect_left(self.times, us - f.window_us, 0, end)
            if f.aggregation == "count":
                out.append(end - low if end > low else int(f.default_value))
            elif end == low:
                out.append(None if f.default_value is None else float(f.default_value))
            elif f.aggregation == "sum":
                out.append(self.sums[end] - self.sums[low])
            else:
                out.append(float(us // 1_000_000 - self.times[end - 1] // 1_000_000))
        return out


def sorted_runs(events: DataFrame, segment: int = SEGMENT, hot_rows: int | None = HOT_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """uid, segment, first, times, sums, counts: for events (uid, us, amount), sums and counts up to each instant, in order of time."""
    facts = events.filter("uid is not null").select("uid", from_micros(F.col("us")).alias("feature_ts"), F.col("amount").cast("double").alias("amount"), F.lit(0).cast("long").alias("event_id"))
    sums = prefix_sums(facts, hot_rows, bucket_rows)
    row = F.struct(micros(F.col("feature_ts")).alias("us"), F.coalesce("cumulative_amount", F.lit(0.0)).alias("a"), F.col("cumulative_count").alias("n"))
    cut = sums.select("uid", F.floor((F.col("cumulative_count") - 1) / segment).alias("segment"), row.alias("r"))
    runs = cut.groupBy("uid", "segment").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return runs.select("uid", "segment", F.col("r")[0]["us"].alias("first"), F.col("r.us").alias("times"), F.col("r.a").alias("sums"), F.col("r.n").alias("counts"))


def look_up(points: DataFrame, runs: DataFrame, catalog: FeatureCatalog, hot_rows: int | None = HOT_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """points (label_id, uid, cutoff_ts) with the catalog's features over ``runs`` (as ``sorted_runs`` gives them); a point without an entity gets defaults.

    Questions are dealt by their number, so that more of them make more tasks, not greater ones; ``points`` are counted for that.
    """
    windows = sorted({0, *(f.window_us for f in catalog.features)})
    k = F.struct("label_id", "uid", "cutoff_ts").alias("k")
    asked = points.select(k, "uid", F.explode(F.array(*(F.lit(w) for w in windows))).alias("back"))
    asked = asked.withColumn("x", micros(F.col("k.cutoff_ts")) - F.col("back"))
    n = points.count() * len(windows)
    routed = asof_join(asked, runs.select("uid", "first", "segment"), "uid", "x", "first", ["segment"], hot_rows=hot_rows, bucket_rows=bucket_rows, about=n)
    lists = ("times", "sums", "counts")
    both = runs.select("uid", "segment", F.lit(0).alias("question"), *lists).unionByName(routed.filter("segment is not null").select("uid", "segment", F.lit(1).alias("question"), "k", "back", "x"), allowMissingColumns=True)
    lined = dealt(both.repartition("uid", "segment"), n, "uid", "segment").sortWithinPartitions("uid", "segment", "question").select("question", "k", "back", "x", *lists)
    schema = both.select("k", "back", F.lit(0.0).alias("a"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("last")).schema

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, sums, counts = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for batch in batches:
            question, x = batch.column("question").to_numpy(), batch.column("x").to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(question == 0).tolist()
            a, n, last = np.zeros(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            begin = 0
            for end in [*heads, len(x)]:
                if end > begin:
                    # the segment begins before the instant asked for, so there is a place before it
                    at = np.searchsorted(times, x[begin:end].astype(np.int64), "left") - 1
                    a[begin:end], n[begin:end], last[begin:end] = sums[at], counts[at], times[at]
                if end < len(x):
                    times, sums, counts = (batch.column(c)[end].values.to_numpy(zero_copy_only=False) for c in lists)
                begin = end + 1
            out = pa.RecordBatch.from_arrays([batch.column("k"), batch.column("back"), pa.array(a), pa.array(n), pa.array(last)], names=schema.names)
            yield out.filter(pa.array(question == 1))

    none = routed.filter("segment is null").select("k", "back", F.lit(0.0).alias("a"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("last"))
    found = dealt(lined.mapInArrow(answer, schema).unionByName(none), n, "k")
    # equal points have equal answers: they are counted, and come out as often as they came in; plain numbers, no structs, need no sort
    per = found.groupBy("k").agg(F.count_if(F.col("back") == 0).cast("int").alias("copies"), *(F.max(F.when(F.col("back") == w, F.col(c))).alias(f"{c}{w}") for w in windows for c in ("a", "n", "last")))
    sec = whole_seconds(micros(F.col("k.cutoff_ts")))
    values = []
    for f in catalog.features:
        w = f.window_us
        some = F.col("n0") > F.col(f"n{w}")
        v = {"sum": F.col("a0") - F.col(f"a{w}"), "count": F.col("n0") - F.col(f"n{w}"), "time_since_last": sec - whole_seconds(F.col("last0"))}[f.aggregation]
        values.append(F.when(some, v).otherwise(F.lit(f.default_value)).cast("long" if f.aggregation == "count" else "double").alias(f.name))
    out = per.select("k.label_id", "k.uid", "k.cutoff_ts", *values, F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copies"))
    return out.drop("copies")
