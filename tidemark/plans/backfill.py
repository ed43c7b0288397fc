"""Features of a range of days, rebuilt from just as much history as the catalog needs, published under the catalog's version."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import UTC, date, datetime, time, timedelta
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeutil import parse_date
from tidemark.operators import features
from tidemark.plans.catalog import DEFAULT_PATH, FeatureCatalog, load_catalog
from tidemark.sources.sinks import append_log, delete, publish, write_bytes


@dataclass(frozen=True)
class BackfillResult:
    output_path: str
    snapshot_path: str
    catalog_version: str
    catalog_fingerprint: str
    start_date: date
    end_date: date
    lookback_hours: int
    row_count: int


def requested(transactions: DataFrame, start: date, end: date, catalog: FeatureCatalog, strategy: str = "auto") -> DataFrame:
    """Features of the cutoffs from start to end, both days included, in catalog order.

    The filter on history goes to the scan: a filter on cutoffs alone would not pass the window.
    """
    low = datetime.combine(start, time())
    high = datetime.combine(end + timedelta(days=1), time())
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    slice_ = transactions.filter((F.col("event_ts") >= at(low - timedelta(hours=catalog.max_lookback_hours))) & (F.col("event_ts") < at(high)))
    built = features.build(slice_, catalog, strategy)
    return built.filter((F.col("cutoff_ts") >= at(low)) & (F.col("cutoff_ts") < at(high)))


def run(transactions: DataFrame, start_date: str | date, end_date: str | date, *, output_root: str, log_path: str | Path, catalog_path: str | Path = DEFAULT_PATH, strategy: str = "auto") -> BackfillResult:
    """Build, publish the catalog's snapshot and then the rows, log. A rerun gives the same rows at the same place; a failure leaves the rows that were there and is logged.

    ``output_root`` may name any file system that Spark knows; ``log_path`` is a local file of the driver.
    """
    start, end = parse_date(start_date, "start_date"), parse_date(end_date, "end_date")
    if start > end:
        raise ValueError("start_date must not be after end_date")
    text = Path(catalog_path).read_bytes()
    catalog = load_catalog(catalog_path)
    base = f"{str(output_root).rstrip('/')}/version={catalog.version}-{catalog.fingerprint}"
    place = f"{base}/{start}_{end}"
    record = {"run_id": uuid.uuid4().hex, "started_at": datetime.now(UTC).isoformat(), "start_date": start.isoformat(), "end_date": end.isoformat(), "catalog_version": catalog.version, "catalog_fingerprint": catalog.fingerprint, "lookback_hours": catalog.max_lookback_hours}
    try:
        snapshot = f"{base}/feature_catalog.yaml"
        write_bytes(transactions.sparkSession, snapshot, text)
        rows = publish(requested(transactions, start, end, catalog, strategy).repartitionByRange("cutoff_ts", "label_id").sortWithinPartitions("cutoff_ts", "label_id"), f"{place}/features.parquet")
    except Exception as error:
        append_log(log_path, record | {"status": "failed", "error": f"{type(error).__name__}: {error}"[:500], "finished_at": datetime.now(UTC).isoformat()})
        raise
    append_log(log_path, record | {"status": "success", "row_count": rows, "output_path": f"{place}/features.parquet", "finished_at": datetime.now(UTC).isoformat()})
    return BackfillResult(f"{place}/features.parquet", snapshot, catalog.version, catalog.fingerprint, start, end, catalog.max_lookback_hours, rows)


def affected_days(changed: DataFrame, catalog: FeatureCatalog) -> list[date]:
    """Days with cutoffs that can see a changed fact, or are one: from its own day to that of its instant plus the longest window.

    ``changed`` has event_ts of facts that came, went or differ; of a fact that moved, both instants. What comes back is days of the
    calendar, however many facts changed.
    """
    last = F.col("event_ts") + F.make_dt_interval(hours=F.lit(catalog.max_lookback_hours))
    spans = changed.filter("event_ts is not null").select(F.to_date("event_ts").alias("a"), F.to_date(last).alias("b")).distinct()
    return sorted(r.day for r in spans.select(F.explode(F.sequence("a", "b")).alias("day")).distinct().collect())


def _ranges(days: list[date]) -> list[tuple[date, date]]:
    """Days in a row as first and last."""
    out: list[tuple[date, date]] = []
    for d in days:
        if out and d - out[-1][1] == timedelta(days=1):
            out[-1] = (out[-1][0], d)
        else:
            out.append((d, d))
    return out


def write_days(built: DataFrame, root: str) -> list[date]:
    """Put the days of built features in place of those days in a store (folders by day); other days are not touched. Returns the days that have rows.

    A day of any number of rows is several files. A rerun leaves the same rows.
    """
    rows = built.withColumn("day", F.to_date("cutoff_ts"))
    rows = rows.repartitionByRange("day", "cutoff_ts", "label_id").sortWithinPartitions("day", "cutoff_ts", "label_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(root)
    return sorted(r.day for r in built.select(F.to_date("cutoff_ts").alias("day")).distinct().collect())


def refresh(transactions: DataFrame, changed: DataFrame, root: str, catalog: FeatureCatalog, strategy: str = "auto") -> list[date]:
    """Bring a store of all features (folders by day) up to date with facts that changed: only days that can differ are built and written.

    ``transactions`` are all facts as they are now. The result equals a build of everything. Returns the days that were built.
    """
    days = affected_days(changed, catalog)
    if not days:
        return []
    built = None
    for first, last in _ranges(days):
        part = requested(transactions, first, last, catalog, strategy)
        built = part if built is None else built.unionByName(part)
    there = set(write_days(built, root))
    for d in days:
        if d not in there:  # its facts have all gone
            delete(transactions.sparkSession, f"{root.rstrip('/')}/day={d}")
    return days
