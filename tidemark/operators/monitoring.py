"""Extensions that watch a running store: freshness on dataset time, and the population stability index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeutil import micros


def freshness(transactions: DataFrame, clock: Column | None = None) -> DataFrame:
    """Per entity the last event and its age in seconds at the clock: an instant, or else the latest event of all. Never wall time."""
    last = transactions.filter("uid is not null").groupBy("uid").agg(F.max("event_ts").alias("last_ts"))
    now = transactions.agg(F.max("event_ts").alias("now")) if clock is None else transactions.sparkSession.range(1).select(clock.cast("timestamp_ntz").alias("now"))
    return last.crossJoin(F.broadcast(now)).select("uid", "last_ts", F.round((micros(F.col("now")) - micros(F.col("last_ts"))) / 1e6, 6).alias("age_sec"))


def stability(expected: DataFrame, actual: DataFrame, column: str, edges: Sequence[float], floor: float = 1e-6) -> DataFrame:
    """psi, and per bin the shares it sums. Bins are cut at edges, missing values are a bin; a share is at least ``floor``, so empty bins and tables are defined."""
    cut = F.when(F.col(column).isNull() | F.isnan(F.col(column).cast("double")), -1)
    place = F.lit(0)
    for e in sorted(edges):
        place = place + F.when(F.col(column) > F.lit(e), 1).otherwise(0)
    bins = cut.otherwise(place).alias("bin")
    counted = expected.select(bins, F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(actual.select(bins, F.lit(0).alias("e"), F.lit(1).alias("a"))).groupBy("bin").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    every = expected.sparkSession.range(-1, len(edges) + 1).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").fillna(0, ["e", "a"])
    total = every.agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    share = lambda x, t: F.greatest(F.col(x) / F.greatest(F.col(t), F.lit(1)), F.lit(floor))
    rows = every.crossJoin(F.broadcast(total)).select("bin", share("e", "te").alias("expected_share"), share("a", "ta").alias("actual_share"))
    return rows.withColumn("psi", (F.col("actual_share") - F.col("expected_share")) * F.log(F.col("actual_share") / F.col("expected_share")))
