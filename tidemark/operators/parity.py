"""Do served values equal batch values? Compared for all rows, or a seeded sample."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import missing_as_null, values_equal
from tidemark.operators import features
from tidemark.operators.cohort import hash_sample
from tidemark.plans.catalog import FeatureCatalog
from tidemark.streaming.online import OnlineStore

LEAST_SAMPLE = 50


@dataclass(frozen=True)
class ParityOptions:
    sample_size: int | None = None  # None: all rows
    rel_tol: float = 1e-9
    abs_tol: float = 1e-9
    seed: int = 42

    def __post_init__(self) -> None:
        n = self.sample_size
        if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n < LEAST_SAMPLE):
            raise ValueError(f"a sample has at least {LEAST_SAMPLE} rows")
        for t in (self.rel_tol, self.abs_tol):
            if isinstance(t, bool) or not isinstance(t, (int, float)) or not math.isfinite(t) or t < 0:
                raise ValueError("tolerances are finite and not negative")


@dataclass(frozen=True)
class ParityResult:
    sample_count: int
    feature_names: tuple[str, ...]
    comparison_count: int
    mismatch_count: int
    mismatches: DataFrame  # label_id, uid, cutoff_ts, feature_name, offline_value, online_value, reason

    @property
    def ok(self) -> bool:
        return self.mismatch_count == 0


def compared(offline: DataFrame, online: DataFrame, names: Sequence[str], options: ParityOptions = ParityOptions()) -> DataFrame:
    """One row per prediction point and feature: both values and the reason they differ, null if they agree."""
    served = [n for n in names if n in online.columns]
    pairs = F.array(*(F.struct(F.lit(n).alias("feature_name"), F.col(f"a.{n}").cast("double").alias("offline_value"), (F.col(f"b.{n}") if n in served else F.lit(None)).cast("double").alias("online_value"), F.lit(n in served).alias("served")) for n in names))
    joined = offline.alias("a").join(online.select("label_id", *served, F.lit(True).alias("there")).alias("b"), "label_id", "left")
    rows = joined.select("label_id", F.col("a.uid").alias("uid"), F.col("a.cutoff_ts").alias("cutoff_ts"), F.coalesce("b.there", F.lit(False)).alias("there"), F.explode(pairs).alias("x")).select("label_id", "uid", "cutoff_ts", "there", "x.*")
    a, b = missing_as_null(F.col("offline_value")), missing_as_null(F.col("online_value"))
    reason = F.when(~F.col("served") | ~F.col("there"), "online_feature_missing").when(values_equal(a, b, options.rel_tol, options.abs_tol), None).when(a.isNull() | b.isNull(), "one_side_missing").otherwise("values_differ")
    return rows.select("label_id", "uid", "cutoff_ts", "feature_name", a.alias("offline_value"), b.alias("online_value"), reason.alias("reason"))


def sampled(offline: DataFrame, options: ParityOptions) -> tuple[DataFrame, int]:
    """The rows with an entity that are compared, and their number."""
    offline = offline.filter("uid is not null")
    total = offline.count()
    if options.sample_size is None:
        return offline, total
    if total < options.sample_size:
        raise ValueError(f"{options.sample_size} rows are asked for, {total} are there")
    return hash_sample(offline, "label_id", options.sample_size, options.seed), options.sample_size


def store_parity(transactions: DataFrame, store: OnlineStore, catalog: FeatureCatalog, options: ParityOptions = ParityOptions(), replay: bool = True) -> ParityResult:
    """Batch features against what the store answers: it is asked for each sampled (uid, cutoff), all in one batch.

    With ``replay`` the store starts afresh from the transactions; without, it is compared as it stands.
    """
    if replay:
        store.replay_facts(transactions, catalog)
    offline, total = sampled(features.build(transactions, catalog), options)
    served = store.features_at(offline.select("label_id", "uid", "cutoff_ts"), catalog)
    wrong = compared(offline, served, catalog.names, options).filter("reason is not null")
    return ParityResult(total, tuple(catalog.names), total * len(catalog.names), wrong.count(), wrong)


def run_parity(offline: DataFrame, online: DataFrame, names: Sequence[str], options: ParityOptions = ParityOptions()) -> ParityResult:
    """Compare rows with an entity. Errors if there are fewer of them than the sample asks for."""
    offline, total = sampled(offline, options)
    wrong = compared(offline, online, names, options).filter("reason is not null")
    return ParityResult(total, tuple(names), total * len(names), wrong.count(), wrong)
