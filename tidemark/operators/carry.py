"""Ordered work over keys of any number of rows, spread over many tasks.

A window puts all rows of a key in one task. Here the rows of a hot key are dealt to buckets of time, each a window of its
own, and every bucket gets one row more: what the buckets before it carry into it (a sum, a last state). These rows come
from one pass over one row a bucket, so a hot key meets in one task only as its buckets. Keys that are not hot
stay one bucket and get no such row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows from which a key is hot, and rows that a bucket should have at most.
HOT_ROWS, BUCKET_ROWS = 1_000_000, 200_000
#: Hot keys that are kept on the driver; beyond, their list is computed where it is used.
FEW_KEYS = 10_000
#: Rows that a task of a window or a grouping should have at most.
TASK_ROWS = 1_000_000


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows, about n of them, by key over so many tasks that each has TASK_ROWS at most; as they are where the session's number of tasks does."""
    tasks = -(-n // TASK_ROWS)
    return rows.repartition(tasks, *keys) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


@dataclass(frozen=True)
class Heat:
    """Hot keys (one column, ``key``), whether they are few enough to be sent to all tasks, and a bucket's length: 2**shift instants."""

    keys: DataFrame
    few: bool
    shift: int

    def known(self) -> DataFrame:
        return F.broadcast(self.keys) if self.few else self.keys


def heat_of(rows: DataFrame, hot_rows: int = HOT_ROWS, bucket_rows: int = BUCKET_ROWS) -> Heat | None:
    """The hot keys of rows (key, at: whole numbers), None if there are none.

    One pass counts keys; one more, seldom a few, over hot rows finds a bucket length that leaves no more than
    ``bucket_rows`` in any bucket. Rows of one key and instant can't be told apart by time and stay together.
    """
    counts = rows.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"), (F.max("at") - F.min("at") + 1).alias("span")).filter(F.col("n") >= hot_rows)
    some = counts.agg(F.count("*").alias("m"), F.max(F.col("n") / F.col("span")).alias("density")).first()
    if not some.m:
        return None
    keys, few = counts.select("key"), some.m <= FEW_KEYS
    if few:
        keys = rows.sparkSession.createDataFrame(keys.collect(), keys.schema)
    # as many as if instants were spread evenly, then finer
    heat = Heat(keys, few, min(62, math.floor(math.log2(max(1.0, bucket_rows / some.density)))))
    hot = rows.join(heat.known(), "key", "left_semi")
    while heat.shift and hot.groupBy("key", F.shiftright("at", heat.shift).alias("bucket")).count().agg(F.max("count")).first()[0] > bucket_rows:
        heat = Heat(keys, few, max(0, heat.shift - 3))
    return heat


def bucketed(rows: DataFrame, heat: Heat | None) -> DataFrame:
    """rows (key, at, ...) with hot (whether their key is) and bucket (0 if not)."""
    if heat is None:
        return rows.withColumn("bucket", F.lit(0).cast("long")).withColumn("hot", F.lit(False))
    known = heat.known().select(F.col("key").alias("_key"), F.lit(True).alias("hot"))
    out = rows.join(known, F.col("key") == F.col("_key"), "left").drop("_key").withColumn("hot", F.coalesce("hot", F.lit(False)))
    return out.withColumn("bucket", F.when(F.col("hot"), F.shiftright("at", heat.shift)).otherwise(0).cast("long"))


def carried_in(rows: DataFrame, sums: dict[str, tuple[Column, Callable[[Column], Column]]], by: Sequence[str] = ("key",)) -> DataFrame:
    """One row for each bucket of hot keys (rows as ``bucketed`` gives them): what the buckets before it come to.

    sums: name -> (aggregate of a bucket's rows, how the aggregates of several buckets come together, such as F.sum).
    """
    per = rows.filter("hot").groupBy(*by, "bucket").agg(*(one.alias(name) for name, (one, _) in sums.items()))
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*by, "bucket", *(together(F.col(name)).over(before).alias(name) for name, (_, together) in sums.items()))
