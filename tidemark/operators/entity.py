"""Candidate entity keys and how good each is."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import entity_key, require_columns
from tidemark.operators.warehouse import repeat_metrics


@dataclass(frozen=True)
class Candidate:
    name: str
    columns: tuple[str, ...]


def candidates(*keys: Sequence[str]) -> tuple[Candidate, ...]:
    """Candidates named by their columns."""
    return tuple(Candidate("_".join(k), tuple(k)) for k in keys)


def candidate_metrics(df: DataFrame, candidates: Sequence[Candidate]) -> DataFrame:
    """One row of metrics per candidate: name and columns, row counts, coverage, and ``repeat_metrics``. All columns of all candidates must be there.

    One group-by counts rows per key, the null key among them; totals and metrics come from those counts.
    """
    if not candidates:
        raise ValueError("there are no candidates")
    require_columns(df, {c for x in candidates for c in x.columns})
    frames = []
    for x in candidates:
        counts = df.groupBy(entity_key(x.columns).alias("uid")).agg(F.count("*").alias("m"))
        n = counts.withColumn("n", F.when(F.col("uid").isNotNull(), F.col("m")))
        metrics = [F.count("n").alias("n_entities") if i == 0 else m for i, m in enumerate(repeat_metrics())]
        again = F.col("n") >= 2
        metrics[1] = F.round(F.lit(100.0) * F.count_if(again) / F.nullif(F.count("n"), F.lit(0)), 2).alias("repeat_entity_pct")
        rows, known = F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))
        frames.append(n.agg(rows.alias("total_rows"), known.alias("rows_with_uid"), F.round(F.lit(100.0) * known / F.nullif(rows, F.lit(0)), 2).alias("coverage_pct"), *metrics).withColumn("candidate", F.lit(x.name)).withColumn("columns", F.lit(" + ".join(x.columns))))
    every = reduce(DataFrame.unionByName, frames)
    return every.select("candidate", "columns", *(c for c in every.columns if c not in ("candidate", "columns")))


def ranked(metrics: DataFrame) -> DataFrame:
    """Best repeat share first, then coverage, then name."""
    return metrics.orderBy(F.desc("repeat_entity_pct"), F.desc("coverage_pct"), "candidate")


def with_decision(metrics: DataFrame, selected: str, reason: str) -> DataFrame:
    """A person's choice, written beside the metrics; nothing is chosen by itself."""
    return metrics.withColumn("selected", F.col("candidate") == selected).withColumn("selection_reason", F.when(F.col("selected"), reason))
