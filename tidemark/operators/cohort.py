"""Who takes part in a study, where it is split in time, and samples that every partitioning agrees on."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeutil import from_micros, micros
from tidemark.operators import features
from tidemark.plans.catalog import FeatureCatalog


@dataclass(frozen=True)
class ObservationBounds:
    """Prediction points from start to end, both included, have the whole lookback on either side."""

    start: datetime
    end: datetime
    total_rows: int
    eligible_rows: int

    @property
    def excluded_rows(self) -> int:
        return self.total_rows - self.eligible_rows


def bounds_frame(points: DataFrame, lookback_hours: int) -> DataFrame:
    """start, end, total_rows, eligible_rows as one row."""
    span = points.agg(F.min("cutoff_ts").alias("first"), F.max("cutoff_ts").alias("last"), F.count("*").alias("total_rows"))
    hours = F.make_dt_interval(hours=F.lit(lookback_hours))
    span = span.select((F.col("first") + hours).cast("timestamp_ntz").alias("start"), (F.col("last") - hours).cast("timestamp_ntz").alias("end"), "total_rows")
    inside = points.select("cutoff_ts").crossJoin(F.broadcast(span)).groupBy("start", "end", "total_rows").agg(F.count_if((F.col("cutoff_ts") >= F.col("start")) & (F.col("cutoff_ts") <= F.col("end"))).alias("eligible_rows"))
    return inside


def observation_bounds(points: DataFrame, lookback_hours: int) -> ObservationBounds:
    """Errors if there are no points or the span is shorter than both lookbacks."""
    row = points.agg(F.min("cutoff_ts").alias("first"), F.max("cutoff_ts").alias("last"), F.count("*").alias("n")).first()
    if not row.n:
        raise ValueError("there are no prediction points")
    start, end = row.first + timedelta(hours=lookback_hours), row.last - timedelta(hours=lookback_hours)
    if start > end:
        raise ValueError("the time span is shorter than the lookback on both sides")
    inside = points.filter(F.col("cutoff_ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))).count()
    return ObservationBounds(start, end, row.n, inside)


def eligible(df: DataFrame, bounds: ObservationBounds) -> DataFrame:
    """Rows with cutoff_ts within the bounds, both ends included; errors if that is not the number counted before."""
    out = df.filter(F.col("cutoff_ts").between(F.lit(bounds.start).cast("timestamp_ntz"), F.lit(bounds.end).cast("timestamp_ntz")))
    found = out.count()
    if found != bounds.eligible_rows:
        raise ValueError(f"{bounds.eligible_rows} rows were eligible, {found} are")
    return out


def split_frame(points: DataFrame, fraction: float) -> DataFrame:
    """split_ts: the least cutoff that at least ``fraction`` of the points do not exceed. One row; no sort of all points."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction must lie between 0 and 1")
    per = points.groupBy(micros(F.col("cutoff_ts")).alias("us")).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    running = running_sums(per, "us", ["n"], ascending=True)
    reached = running.crossJoin(F.broadcast(total)).filter(F.col("upto_n") >= F.ceil(F.col("total") * F.lit(fraction)))
    return reached.agg(from_micros(F.min("us")).alias("split_ts"))


def split_timestamp(points: DataFrame, bounds: ObservationBounds, fraction: float = 0.8) -> datetime:
    """Where the eligible points split into an earlier part of about ``fraction`` and the rest."""
    found = split_frame(eligible(points, bounds), fraction).first()[0]
    if found is None:
        raise ValueError("there are no eligible points")
    return found


def temporal_split(df: DataFrame, split_ts: datetime) -> tuple[DataFrame, DataFrame]:
    """Before the instant, and from it on; equal instants stay together. Both parts must have rows."""
    at = F.lit(split_ts).cast("timestamp_ntz")
    train, test = df.filter(F.col("cutoff_ts") < at), df.filter(F.col("cutoff_ts") >= at)
    if train.isEmpty() or test.isEmpty():
        raise ValueError("one side of the split is empty")
    return train, test


def split_summary(df: DataFrame, split_ts: datetime) -> DataFrame:
    """Rows, positives, their share and time span of both parts."""
    part = F.when(F.col("cutoff_ts") < F.lit(split_ts).cast("timestamp_ntz"), "train").otherwise("test")
    return df.groupBy(part.alias("part")).agg(F.count("*").alias("n_rows"), F.sum(F.col("label").cast("long")).alias("n_positive"), F.round(F.avg(F.col("label").cast("double")), 6).alias("positive_rate"), F.min("cutoff_ts").alias("first_ts"), F.max("cutoff_ts").alias("last_ts"))


@dataclass(frozen=True)
class ExperimentFrames:
    past: DataFrame
    future: DataFrame
    combined: DataFrame
    bounds: ObservationBounds
    split_ts: datetime


def experiment_frames(transactions: DataFrame, catalog: FeatureCatalog, fraction: float = 0.8, strategy: str = "auto") -> ExperimentFrames:
    """The three frames of a leakage study over one set of prediction points."""
    points, events = features.spine(transactions), features.history(transactions)
    bounds = observation_bounds(points, catalog.max_lookback_hours)
    at = split_timestamp(points, bounds, fraction)
    both = eligible(features.combined_features(points, events, catalog, strategy), bounds)
    future = {f.name: features.future_name(f) for f in catalog.features}
    past_frame = both.select(*features.SPINE, *catalog.names)
    future_frame = both.select(*features.SPINE, *(F.col(future[n]).alias(n) for n in catalog.names))
    return ExperimentFrames(past_frame, future_frame, both, bounds, at)


def fingerprint(df: DataFrame) -> DataFrame:
    """n_rows, low_sum, high_sum: one row that tells frames apart whatever the order of their rows, and that any engine can compute.

    Each row is the md5 of its columns' texts joined by | (nulls left out); the sums are of its first and next fifteen digits, as text.
    """
    digest = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in df.columns)))
    part = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")
    sums = [F.coalesce(F.sum(part(at)).cast("string"), F.lit("0")).alias(n) for at, n in ((1, "low_sum"), (16, "high_sum"))]
    return df.select(digest.alias("h")).agg(F.count("*").alias("n_rows"), *sums)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames have the same rows the same number of times, in any order: one aggregate of each, no shuffle of rows.

    Rows are compared by sums of two 64-bit hashes, so frames that differ are told to be equal with a chance of about 2**-64.
    """
    if a.columns != b.columns:
        return False
    common = a.limit(0).union(b.limit(0)).schema

    def sums(df: DataFrame) -> tuple:
        columns = [F.col(f"`{f.name}`").cast(f.dataType) for f in common]
        # a null is a value of its own: hashes pass over nulls
        nulls = F.concat(*(c.isNull().cast("int").cast("string") for c in columns))
        hashes = [F.xxhash64(F.lit(seed), nulls, *columns).cast("decimal(38,0)") for seed in (1, 2)]
        return tuple(df.agg(F.count("*"), *(F.sum(h) for h in hashes)).first())

    return sums(a) == sums(b)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows of lowest seeded md5 of a unique key: the same ones at every partitioning and in any engine."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), F.col(key)).limit(n)


def first_qualifying(frame: DataFrame, split_ts: datetime, counts: Sequence[str]) -> DataFrame:
    """The first row by (cutoff_ts, label_id) from the split on that has an entity and more than 0 in every count; none if there is none."""
    ok = (F.col("cutoff_ts") >= F.lit(split_ts).cast("timestamp_ntz")) & F.col("uid").isNotNull()
    for c in counts:
        ok = ok & (F.col(c) > 0)
    first = frame.filter(ok).agg(F.min(F.struct("cutoff_ts", "label_id", *(c for c in frame.columns if c not in ("cutoff_ts", "label_id")))).alias("x"))
    return first.filter("x is not null").select(*(F.col(f"x.`{c}`").alias(c) for c in frame.columns))


def availability_timeline(transactions: DataFrame, label_id: int, hours: float = 24.0, before: int = 6, at: int = 3, after: int = 6) -> DataFrame:
    """Events of one entity around a prediction point, told apart by whether they were known there.

    availability is before_cutoff, at_cutoff or after_cutoff; at most the last ``before``, first ``at`` and first
    ``after`` of them are shown, and the point itself.
    """
    point = transactions.filter(F.col("transaction_id") == label_id).select(F.col("uid").alias("of"), micros(F.col("event_ts")).alias("us0")).limit(1)
    rows = transactions.join(F.broadcast(point), F.col("uid") == F.col("of")).withColumn("us", micros(F.col("event_ts")))
    rows = rows.filter(F.abs(F.col("us") - F.col("us0")) <= int(hours * 3_600_000_000))
    kind = F.when(F.col("us") < F.col("us0"), "before_cutoff").when(F.col("us") == F.col("us0"), "at_cutoff").otherwise("after_cutoff")
    rows = rows.withColumn("availability", kind).withColumn("hours_from_cutoff", F.round((F.col("us") - F.col("us0")) / 3.6e9, 6))
    forth = F.row_number().over(Window.partitionBy("availability").orderBy("us", "transaction_id"))
    back = F.row_number().over(Window.partitionBy("availability").orderBy(F.desc("us"), F.desc("transaction_id")))
    rows = rows.withColumn("forth", forth).withColumn("back", back)
    shown = ((F.col("availability") == "before_cutoff") & (F.col("back") <= before)) | ((F.col("availability") == "at_cutoff") & (F.col("forth") <= at)) | ((F.col("availability") == "after_cutoff") & (F.col("forth") <= after)) | (F.col("transaction_id") == label_id)
    return rows.filter(shown).select("transaction_id", "event_ts", "amount", "label", "availability", "hours_from_cutoff").dropDuplicates(["transaction_id"])


def running_sums(df: DataFrame, key: str, sums: list[str], ascending: bool = True, parts: int = 32, by: Sequence[str] = (), like: DataFrame | None = None) -> DataFrame:
    """df with upto_<name>: the sum of a column over all rows up to this key (unique), without sorting all rows in one task.

    Keys are cut at quantiles; running sums within a cut are windows, and the cuts' totals, a few rows, are broadcast.
    ``by``: sums run apart for each value of these columns. ``like``: a smaller frame whose keys tell the quantiles.
    """
    sign = 1.0 if ascending else -1.0
    low = (df if like is None else like).select((F.col(key).cast("double") * sign).alias("v"))
    edges = sorted(set(low.approxQuantile("v", [i / parts for i in range(1, parts)], 0.01)))
    place = F.lit(0)
    for e in edges:
        place = place + F.when(F.col(key).cast("double") * sign > F.lit(e), 1).otherwise(0)
    cut = df.withColumn("_cut", place)
    totals = cut.groupBy(*by, "_cut").agg(*(F.sum(s).alias(f"_{s}") for s in sums))
    earlier = Window.partitionBy(*by).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_cut", *(F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_{s}") for s in sums))
    order = F.col(key).asc() if ascending else F.col(key).desc()
    within = Window.partitionBy(*by, "_cut").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = cut.join(F.broadcast(totals), [*by, "_cut"])
    return cut.select(*(F.col(c) for c in df.columns), *((F.sum(s).over(within) + F.col(f"_{s}")).alias(f"upto_{s}") for s in sums))
