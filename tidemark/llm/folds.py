"""Which rows a model may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """One row in five, by the checksum of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_rows(docs: DataFrame, ids: DataFrame, rows: int, seed: int) -> DataFrame:
    """doc_id and text of at most ``rows`` rows whose doc_id is among ``ids``: the same ones at every partitioning.

    Ids of lowest hash are taken first, at most ``rows``, so what is broadcast is bounded; of their rows, each of
    equal ones once, those of lowest hash of id and text. So an id of any number of rows brings no more than the bound.
    """
    few = ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    there = texts.join(F.broadcast(few), "doc_id", "left_semi").distinct()
    return there.orderBy(F.xxhash64("doc_id", "text", F.lit(seed)), "doc_id", "text").limit(rows)
