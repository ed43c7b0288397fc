"""The fact table: built from a wide source, gated, profiled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import entity_key, require_columns
from tidemark.functions.timeutil import shifted

#: Columns that a raw source must have; others are not read.
RAW = ("TransactionID", "TransactionDT", "TransactionAmt", "isFraud", "card1", "card2", "addr1")


def build_transactions(raw: DataFrame, keys: tuple[str, ...] = ("card1", "card2", "addr1"), origin: str = "2017-12-01 00:00:00") -> DataFrame:
    """transaction_id, uid (md5 of the key columns, null if one is missing), event_ts (origin plus seconds), amount, label."""
    require_columns(raw, [*RAW[:4], *keys])
    return raw.select(
        F.col("TransactionID").cast("bigint").alias("transaction_id"),
        entity_key(keys).alias("uid"),
        shifted(F.col("TransactionDT"), origin).alias("event_ts"),
        F.col("TransactionAmt").cast("double").alias("amount"),
        F.col("isFraud").cast("smallint").alias("label"),
    )


def gates(transactions: DataFrame) -> DataFrame:
    """All counts that the checks need, as one row."""
    amount = F.col("amount")
    rows = transactions.agg(
        F.count("*").alias("total_rows"),
        (F.count("*") - F.count_distinct("transaction_id")).alias("duplicate_ids"),
        F.count_if(F.col("transaction_id").isNull()).alias("null_ids"),
        F.count_if(F.col("event_ts").isNull() | amount.isNull()).alias("null_required"),
        F.count_if(F.col("label").isNull() | ~F.col("label").isin(0, 1)).alias("invalid_labels"),
        F.count_if(F.isnan(amount) | (F.abs(amount) == float("inf"))).alias("non_finite_amounts"),
        F.count_if(F.col("uid") == "").alias("empty_uids"),
    )
    entities = transactions.filter("uid is not null").groupBy("uid").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_entities"), F.count_if(F.col("n") >= 2).alias("repeated_entities"))
    return rows.crossJoin(entities)  # one row each


def check(transactions: DataFrame, expected_rows: int | None = None) -> None:
    """Raise ValueError at the first gate that fails."""
    g = gates(transactions).first()
    problems = [
        (expected_rows is not None and g.total_rows != expected_rows, f"{expected_rows} rows expected, {g.total_rows} found"),
        (g.duplicate_ids > 0, f"{g.duplicate_ids} duplicate transaction ids"),
        (g.null_ids > 0, f"{g.null_ids} null transaction ids"),
        (g.null_required > 0, f"{g.null_required} rows without event_ts or amount"),
        (g.invalid_labels > 0, f"{g.invalid_labels} labels are neither 0 nor 1"),
        (g.non_finite_amounts > 0, f"{g.non_finite_amounts} amounts are not finite"),
        (g.empty_uids > 0, f"{g.empty_uids} entity keys are empty"),
        (g.n_entities == 0 or g.repeated_entities * 2 <= g.n_entities, "most entities must have two rows or more"),
    ]
    for failed, what in problems:
        if failed:
            raise ValueError(what)


def profile(transactions: DataFrame) -> DataFrame:
    """Size, coverage, label rate and time span as one row."""
    known = F.count_if(F.col("uid").isNotNull())
    return transactions.agg(
        F.count("*").alias("total_rows"),
        F.count_distinct("transaction_id").alias("distinct_ids"),
        known.alias("rows_with_uid"),
        F.round(F.lit(100.0) * known / F.nullif(F.count("*"), F.lit(0)), 2).alias("uid_coverage_pct"),
        F.round(100.0 * F.avg(F.col("label").cast("double")), 4).alias("label_rate_pct"),
        F.min("event_ts").alias("min_event_ts"),
        F.max("event_ts").alias("max_event_ts"),
    )


def entity_profile(transactions: DataFrame) -> DataFrame:
    """How often entities come again, as one row. p95 is exact."""
    counts = transactions.filter("uid is not null").groupBy("uid").agg(F.count("*").alias("n"))
    return counts.agg(*repeat_metrics())


def repeat_metrics() -> list:
    """Metrics over rows with n, the number of rows of an entity."""
    again = F.col("n") >= 2
    return [
        F.count("*").alias("n_entities"),
        F.round(F.lit(100.0) * F.count_if(again) / F.nullif(F.count("*"), F.lit(0)), 2).alias("repeat_entity_pct"),
        F.round(F.lit(100.0) * F.sum(F.when(again, F.col("n"))) / F.nullif(F.sum("n"), F.lit(0)), 2).alias("repeat_row_pct"),
        F.median("n").alias("median_per_entity"),
        F.percentile("n", F.lit(0.95)).alias("p95_per_entity"),
        F.max("n").alias("max_per_entity"),
    ]
