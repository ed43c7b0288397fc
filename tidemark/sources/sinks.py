"""Sinks: atomic publication of directories, run logs, reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.keys import require_columns, safe_name


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, a = _fs(spark, source)
    _, b = _fs(spark, target)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"could not rename {source} to {target}")


def publish(df: DataFrame, target: str, by: Sequence[str] = ()) -> int:
    """Write df (in folders ``by`` columns, if given) beside target under a hidden name and rename it into place. Returns the rows written.

    An older version moves aside first and back if the second rename fails. Readers see the old directory or the new
    one whole, except between the two renames: then there is none. A crash just there leaves the old version under its
    hidden name; the next publication of the target puts it back first. On an object store a rename is a copy.
    """
    spark = df.sparkSession
    parent, name = str(target).rstrip("/").rsplit("/", 1)
    mark = uuid.uuid4().hex
    fresh, old = f"{parent}/_tmp-{name}-{mark}", f"{parent}/_old-{name}-{mark}"
    restore(spark, str(target))
    try:
        writer = df.write.partitionBy(*by) if by else df.write
        writer.parquet(fresh)
        n = spark.read.parquet(fresh).count()
        fs, place = _fs(spark, target)
        moved = fs.exists(place)
        if moved:
            rename(spark, str(target), old)
        try:
            rename(spark, fresh, str(target))
        except Exception:
            if moved:
                rename(spark, old, str(target))
            raise
        delete(spark, old)
        return n
    finally:
        delete(spark, fresh)


def restore(spark: SparkSession, target: str) -> bool:
    """Put the version back that a crash between the two renames of ``publish`` left aside."""
    parent, name = target.rstrip("/").rsplit("/", 1)
    fs, place = _fs(spark, target)
    _, folder = _fs(spark, parent)
    if fs.exists(place) or not fs.exists(folder):
        return False
    left = sorted(s.getPath().toString() for s in fs.listStatus(folder) if s.getPath().getName().startswith(f"_old-{name}-"))
    if not left:
        return False
    rename(spark, left[-1], target)
    return True


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file in whatever file system the path names, renamed into place whole."""
    fs, place = _fs(spark, path)
    fs.mkdirs(place.getParent())
    _, fresh = _fs(spark, f"{place.getParent().toString()}/_tmp-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    try:
        out.write(data)
    finally:
        out.close()
    fs.delete(place, False)
    if not fs.rename(fresh, place):
        raise OSError(f"could not write {path}")


def write_facts(df: DataFrame, target: str) -> int:
    """Store a fact table, sorted within files so that time filters skip row groups."""
    return publish(df.sortWithinPartitions("event_ts", "transaction_id"), target)


def relation(df: DataFrame, name: str, temporary: bool = True) -> DataFrame:
    """df under a plain name: a view of this session, or a table that is written and stays. Either replaces one of its kind and name."""
    safe_name(name)
    if temporary:
        df.createOrReplaceTempView(name)
    else:
        df.write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def append_log(path: str | Path, record: dict) -> None:
    """One JSON object a line; spark.read.json reads it back."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a", encoding="utf-8") as out:
        out.write(json.dumps(record, ensure_ascii=False, sort_keys=True, default=str) + "\n")


def export_report(df: DataFrame, path: str | Path, required: Iterable[str], limit: int = 10_000) -> int:
    """A small report as one CSV file with a header, in the order of df. A frame that is no report (over ``limit`` rows) is refused."""
    require_columns(df, required)
    rows = df.limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"a report has at most {limit} rows")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    rows.to_csv(path, index=False, float_format="%.10f")
    return len(rows)


def markdown_table(columns: Sequence[str], rows: Iterable[Sequence]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"
