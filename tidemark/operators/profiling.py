"""Looking at a table before it is used: each frame here is what a report or chart shows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import quantiles


#: Quantiles of a profile.
PROFILED = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation and exact quantiles of numeric columns, one row each. The quantiles are found by jobs of their own, when called."""
    stats = {"n": lambda c: F.count(c).cast("double"), "mean": F.avg, "stddev": F.stddev_samp, "min_value": F.min, "max_value": F.max}
    found = quantiles(df, columns, list(PROFILED.values()))
    known = lambda c: [F.round(F.lit(found[c, f]).cast("double"), 4).alias(n) for n, f in PROFILED.items()]
    one = df.agg(*(F.struct(*(F.round(f(F.col(c).cast("double")), 4).alias(n) for n, f in stats.items())).alias(c) for c in columns))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("s"), *known(c)) for c in columns))).alias("x"))
    order = ("n", "mean", "stddev", "min_value")
    return rows.select("x.column_name", *(F.col(f"x.s.{n}").alias(n) for n in order), *(F.col(f"x.{n}").alias(n) for n in PROFILED), F.col("x.s.max_value").alias("max_value"))


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, missing rows and their share per column, from one pass."""
    one = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    rows = one.select(F.col("n"), F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in columns))).alias("x"))
    return rows.select("x.column_name", F.col("n").alias("n_rows"), "x.n_missing", F.round(F.lit(100.0) * F.col("x.n_missing") / F.nullif(F.col("n"), F.lit(0)), 4).alias("missing_pct"))


def id_quality(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct ids, nulls, and repeats among the ids that are there."""
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_distinct"), F.count_if(F.col(key).isNull()).alias("n_null"), (F.count(key) - F.count_distinct(key)).alias("n_duplicate"))


def outliers(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, the fence 1.5 quartile ranges above, and how many values are beyond it or not positive: one row; none without values."""
    found = quantiles(df, [column], [0.25, 0.75])
    low, high = found[column, 0.25], found[column, 0.75]
    v = F.col(column).cast("double")
    fence = None if low is None else high + 1.5 * (high - low)
    shown = [F.round(F.lit(x).cast("double"), 4).alias(n) for n, x in (("p25", low), ("p75", high), ("fence", fence))]
    counted = df.agg(F.count_if(v > F.lit(fence).cast("double")).alias("n_high"), F.count_if(v <= 0).alias("n_not_positive"), F.count(v).alias("n_values"), F.count("*").alias("n"))
    return counted.filter("n > 0").select(*shown, "n_high", "n_not_positive", "n_values")


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and share per label, with its meaning."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_rows"))
    share = F.round(F.lit(100.0) * F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()), 4)
    name = F.when(F.col(label) == 0, "negative").when(F.col(label) == 1, "positive").otherwise("other")
    return counts.select(F.col(label).cast("int").alias("label"), name.alias("label_name"), "n_rows", share.alias("share_pct"))


def domain(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column of few values, sorted, as one text, and how many rows have one beyond 0 and 1."""
    return df.agg(F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), ",").alias("domain"), F.count_if(~F.col(column).isin(0, 1)).alias("n_other"))


def daily_activity(df: DataFrame, ts: str = "event_ts", label: str = "label") -> DataFrame:
    """Rows and label rate of each day."""
    return df.groupBy(F.date_trunc("day", ts).cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n_rows"), F.round(F.avg(F.col(label).cast("double")) * 100, 4).alias("label_rate_pct"))


def modulo_sample(df: DataFrame, key: str, step: int = 20) -> DataFrame:
    """Every row whose id is a multiple of ``step``, with the logarithm of its amount beside it."""
    return df.filter(F.col(key) % step == 0).withColumn("log_amount", F.round(F.log1p(F.greatest(F.col("amount"), F.lit(0.0))), 6))
