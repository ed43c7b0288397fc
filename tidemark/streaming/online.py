"""The online side: stored events of each entity, features as of any instant, and replay in time order.

Events (uid, transaction_id, amount, us) go to an event log, which is anything with the methods of ``EventLog``;
``ParquetLog`` is the one here. It appends: a put writes a delta, dealt to folders by a checksum of the entity, and
reading resolves the deltas, so one event costs one small file and a lookup reads one folder. The key of an event is
(uid, transaction_id, amount): sending it again moves it in time, a changed amount is a second event. The clock is
dataset time, the latest instant replayed, never wall time. Nothing expires, so past instants stay answerable.
"""

from __future__ import annotations

import json
import math
import threading
import time
import uuid
import zlib
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.timeutil import epoch_micros, from_micros, micros
from tidemark.operators import features
from tidemark.plans.catalog import FeatureCatalog, load_catalog
from tidemark.sources.readers import exists
from tidemark.sources.sinks import delete, publish
from tidemark.streaming.runs import EntityRun, look_up, sorted_runs

STATE = "uid string, transaction_id string, amount double, us long"


class NoClock(RuntimeError):
    """Nothing was replayed yet, or the clock cannot be read: 503 in HTTP."""


class BadInstant(ValueError):
    """An instant that is not finite: 422 in HTTP."""


@dataclass(frozen=True)
class OnlineEvent:
    transaction_id: int | str
    uid: str | None
    event_ts: datetime | float | int | str
    amount: float


@dataclass(frozen=True)
class ReplayResult:
    total_rows: int
    ingested_events: int
    last_event_epoch: float | None


def coerce(event: OnlineEvent | Mapping | tuple) -> OnlineEvent:
    """An event from a mapping with its field names or a tuple of its four fields."""
    names = ("transaction_id", "uid", "event_ts", "amount")
    if isinstance(event, OnlineEvent):
        found = event
    elif isinstance(event, Mapping):
        missing = [n for n in names if n not in event]
        if missing:
            raise ValueError(f"the event has no {missing[0]}")
        found = OnlineEvent(*(event[n] for n in names))
    elif isinstance(event, tuple) and len(event) == 4:
        found = OnlineEvent(*event)
    else:
        raise ValueError("an event is an OnlineEvent, a mapping or a tuple of four")
    checked_id(found.transaction_id)
    if found.uid is not None:
        checked_uid(found.uid)
    if isinstance(found.amount, bool) or not isinstance(found.amount, (int, float)) or not math.isfinite(found.amount):
        raise ValueError("an amount is a finite number")
    return found


def checked_id(value: object) -> str:
    if isinstance(value, bool) or not isinstance(value, (int, str)) or value == "":
        raise ValueError("a transaction id is a whole number or a text that is not empty")
    return str(value)


def checked_uid(value: object) -> str:
    if not isinstance(value, str) or not value:
        raise ValueError("an entity is a text that is not empty")
    return value


def event_rows(spark: SparkSession, events: Iterable[OnlineEvent | Mapping | tuple]) -> DataFrame:
    """Events in order of arrival: seq, transaction_id, uid, us, amount."""
    rows = [(i, str(e.transaction_id), e.uid, epoch_micros(e.event_ts), float(e.amount)) for i, e in enumerate(map(coerce, events))]
    return spark.createDataFrame(rows, "seq long, transaction_id string, uid string, us long, amount double")


class EventLog(Protocol):
    """Where a store keeps its events and its clock."""

    def put(self, rows: DataFrame) -> None:
        """Add events (uid, transaction_id, amount, us); of one key the last put stays."""

    def events(self, uids: Sequence[str] | None = None) -> DataFrame:
        """uid, transaction_id, amount, us: one row per key, of the entities asked for or of all."""

    def clock(self) -> int | None:
        """Dataset time in microseconds."""

    def set_clock(self, us: int) -> None: ...

    def clear(self) -> None: ...


class ParquetLog:
    """An event log in folders under ``root``; other folders there are not touched. One writer at a time."""

    BUCKETS = 32
    #: Entities whose folders are worth choosing.
    FEW = 16
    KEY = ("uid", "transaction_id", "amount")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(root).rstrip("/")
        self._events, self._clock = f"{self.root}/events", f"{self.root}/clock"

    def _deltas(self) -> DataFrame | None:
        if not exists(self.spark, self._events):
            return None
        return self.spark.read.schema(f"{STATE}, turn long, bucket int").parquet(self._events)

    def _resolved(self, deltas: DataFrame) -> DataFrame:
        return deltas.groupBy("bucket", *self.KEY).agg(F.max_by("us", F.struct("turn", "us")).alias("us"), F.max("turn").alias("turn"))

    def _delta(self, rows: DataFrame) -> DataFrame:
        bucket = F.pmod(F.crc32(F.encode("uid", "UTF-8")), F.lit(self.BUCKETS)).cast("int")
        return rows.select("uid", F.col("transaction_id").cast("string").alias("transaction_id"), F.col("amount").cast("double").alias("amount"), "us", F.lit(time.time_ns()).alias("turn"), bucket.alias("bucket"))

    def put(self, rows: DataFrame) -> None:
        # a folder gets few files, and one of a hot entity is split again
        self._delta(rows).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(self._events)

    def replace(self, rows: DataFrame) -> None:
        """Put rows (some) in place of all events: until they are written whole, the old ones stay."""
        publish(self._delta(rows).hint("rebalance", "bucket"), self._events, by=["bucket"])

    def events(self, uids: Sequence[str] | None = None) -> DataFrame:
        deltas = self._deltas()
        if deltas is None:
            return self.spark.createDataFrame([], STATE)
        if uids is not None and len(uids) <= self.FEW:
            deltas = deltas.filter(F.col("bucket").isin(sorted({zlib.crc32(u.encode()) % self.BUCKETS for u in uids})) & F.col("uid").isin(list(uids)))
        return self._resolved(deltas).select(*self.KEY, "us")

    def compact(self) -> None:
        """Rewrite the deltas as one. Lookups meanwhile see the old folders or, between two renames, none."""
        deltas = self._deltas()
        if deltas is not None:
            publish(self._resolved(deltas).hint("rebalance", "bucket").sortWithinPartitions("bucket", "uid", "us"), self._events, by=["bucket"])

    def clock(self) -> int | None:
        if not exists(self.spark, self._clock):
            return None
        return self.spark.read.schema("us long").parquet(self._clock).first()[0]

    def set_clock(self, us: int) -> None:
        publish(self.spark.createDataFrame([(us,)], "us long"), self._clock)

    def clear(self) -> None:
        delete(self.spark, self._events)
        delete(self.spark, self._clock)


class OnlineStore:
    """Features of stored events. ``log`` is any event log; by default one in Parquet under ``root``.

    Single lookups are answered from runs of entities kept in memory, at most ``cached_events`` events of all; an entity of more is
    answered by a Spark job. What this store writes is seen at once, what others write to the same log after ``fresh`` seconds.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, log: EventLog | None = None, cached_events: int = 1_000_000, fresh: float = 5.0):
        if (root is None) == (log is None):
            raise ValueError("a store has a root or a log")
        self.spark, self.log = spark, log or ParquetLog(spark, str(root))
        self.cached_events, self.fresh = cached_events, fresh
        self._runs: dict[str, tuple[float, EntityRun]] = {}
        self._clock: tuple[float, int | None] | None = None
        self._lock = threading.Lock()

    def _forget(self) -> None:
        with self._lock:
            self._runs, self._clock = {}, None

    def run_of(self, uid: str) -> EntityRun | None:
        """All events of an entity in memory; None if they are too many."""
        now = time.monotonic()
        with self._lock:
            found = self._runs.get(uid)
        if found is not None and now - found[0] <= self.fresh:
            return found[1]
        rows = self.log.events([uid]).select("us", "amount").limit(self.cached_events + 1).collect()
        if len(rows) > self.cached_events:
            return None
        run = EntityRun((r.us, r.amount) for r in rows)
        with self._lock:
            self._runs.pop(uid, None)
            while self._runs and sum(len(r) + 1 for _, r in self._runs.values()) + len(run) > self.cached_events:
                del self._runs[next(iter(self._runs))]  # the one that came first
            self._runs[uid] = (now, run)
        return run

    def recent_clock(self) -> int | None:
        """The clock in microseconds, not older than ``fresh`` seconds."""
        now = time.monotonic()
        if self._clock is None or now - self._clock[0] > self.fresh:
            self._clock = (now, self.log.clock())
        return self._clock[1]

    def state(self) -> DataFrame:
        return self.log.events()

    def put(self, rows: DataFrame) -> None:
        self.log.put(rows)
        self._forget()

    def ingest(self, uid: str, transaction_id: int | str, amount: float, at: datetime | float | str) -> None:
        """One event."""
        e = coerce(OnlineEvent(transaction_id, checked_uid(uid), at, amount))
        self.put(self.spark.createDataFrame([(e.uid, str(e.transaction_id), float(e.amount), epoch_micros(e.event_ts))], STATE))

    def clock(self) -> float | None:
        """Dataset time in seconds; None before any replay."""
        us = self.log.clock()
        return None if us is None else us / 1e6

    def set_clock(self, at: datetime | float | str | int) -> None:
        self.log.set_clock(epoch_micros(at))
        self._forget()

    def clear(self) -> None:
        """Forget this store's events and clock, nothing else."""
        self.log.clear()
        self._forget()

    def features_at(self, points: DataFrame, catalog: FeatureCatalog | None = None) -> DataFrame:
        """Many lookups at once: points (label_id, uid, cutoff_ts) with the features over stored events before each cutoff."""
        return look_up(points.select("label_id", "uid", "cutoff_ts"), sorted_runs(self.state()), catalog or load_catalog())

    def features_as_of(self, uids: DataFrame | Iterable[str], at: datetime | float | str | None = None, catalog: FeatureCatalog | None = None) -> DataFrame:
        """uid, as_of, and the catalog's features over stored events before the instant (default: the clock). Unknown entities get defaults."""
        us = epoch_micros(at) if at is not None else self.log.clock()
        if us is None:
            raise NoClock("nothing was replayed yet")
        catalog = catalog or load_catalog()
        named = None
        if not isinstance(uids, DataFrame):
            named = [checked_uid(u) for u in uids]
            uids = self.spark.createDataFrame([(u,) for u in named], "uid string")
        points = uids.select(F.lit(0).cast("long").alias("label_id"), "uid", from_micros(F.lit(us)).alias("cutoff_ts"))
        reach = us - catalog.max_lookback_hours * 3_600_000_000
        # only what the longest window can see
        seen = self.log.events(named).filter((F.col("us") >= reach) & (F.col("us") < us)).join(uids.select("uid").distinct(), "uid", "left_semi")
        return look_up(points, sorted_runs(seen), catalog).select("uid", F.col("cutoff_ts").alias("as_of"), *catalog.names)

    def replay(self, rows: DataFrame, catalog: FeatureCatalog | None = None, observer: Callable[[DataFrame], None] | None = None) -> ReplayResult:
        """Start afresh from events (transaction_id, uid, us, amount, and seq, the order of arrival, if that is to be checked).

        Each event sees what was before its instant; it is then stored. As a batch that is the as-of build over the
        same rows. A row that goes back in time is an error before anything changes; equal instants are fine. Rows
        without an entity only move the clock. ``observer`` gets the frame of features. A log with ``replace`` keeps its old events
        until the new ones are there.
        """
        catalog = catalog or load_catalog()
        if "seq" in rows.columns:
            late = out_of_order(rows)
            if late:
                raise ValueError(f"{late} events go back in time")
        totals = rows.agg(F.count("*").alias("n"), F.count("uid").alias("known"), F.max("us").alias("last")).first()
        if observer is not None:
            observer(replay_features(rows, catalog))
        replace = getattr(self.log, "replace", None)
        if totals.known and replace is not None:
            replace(rows.filter("uid is not null"))
        else:
            self.clear()
            if totals.known:
                self.put(rows.filter("uid is not null"))
        if totals.last is not None:
            self.log.set_clock(totals.last)
        self._forget()
        return ReplayResult(totals.n, totals.known, None if totals.last is None else totals.last / 1e6)

    def replay_facts(self, transactions: DataFrame, catalog: FeatureCatalog | None = None, observer: Callable[[DataFrame], None] | None = None) -> ReplayResult:
        """Replay a fact table in order of (event_ts, transaction_id)."""
        rows = transactions.select(F.col("transaction_id"), "uid", micros(F.col("event_ts")).alias("us"), "amount")
        return self.replay(rows, catalog, observer)


def out_of_order(rows: DataFrame, parts: int = 32) -> int:
    """Events that arrive (seq) after one of a later instant; the check goes over all entities together.

    Rows are cut into stretches of arrival, each checked by itself and against the latest instant of all before.
    """
    span = rows.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    if span.a is None:
        return 0
    width = max(1, (span.b - span.a) // parts + 1)
    cut = rows.select("seq", "us", F.floor((F.col("seq") - span.a) / width).alias("cut"))
    latest = cut.groupBy("cut").agg(F.max("us").alias("m"))
    earlier = latest.select("cut", F.max("m").over(Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    inside = F.max("us").over(Window.partitionBy("cut").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = cut.withColumn("inside", inside).join(F.broadcast(earlier), "cut")
    return rows.filter(F.col("us") < F.greatest("inside", "before")).count()


def replay_features(rows: DataFrame, catalog: FeatureCatalog) -> DataFrame:
    """What each event sees when it arrives: label_id, uid, cutoff_ts and the features; rows without an entity are left out."""
    known = rows.filter("uid is not null")
    facts = known.select("transaction_id", "uid", from_micros(F.col("us")).alias("event_ts"), "amount", F.lit(0).cast("smallint").alias("label"))
    return features.build(facts, catalog).drop("label")


def lookup(store: OnlineStore, uid: str, as_of: float | None = None, catalog: FeatureCatalog | None = None) -> dict:
    """{uid, as_of_epoch, features...} of one entity, from memory once it was asked for. An explicit instant goes before the clock."""
    if as_of is not None:
        if isinstance(as_of, bool) or not isinstance(as_of, (int, float)) or not math.isfinite(as_of):
            raise BadInstant("as_of must be a finite number of seconds")
    else:
        us = store.recent_clock()
        if us is None:
            raise NoClock("nothing was replayed yet")
        as_of = us / 1e6
    catalog = catalog or load_catalog()
    run = store.run_of(checked_uid(uid))
    if run is not None:
        return {"uid": uid, "as_of_epoch": float(as_of), **dict(zip(catalog.names, run.values(catalog, epoch_micros(float(as_of))), strict=True))}
    row = store.features_as_of([uid], float(as_of), catalog).first().asDict()
    del row["as_of"], row["uid"]
    return {"uid": uid, "as_of_epoch": float(as_of), **row}


def serve(store: OnlineStore, host: str = "127.0.0.1", port: int = 8000, catalog: FeatureCatalog | None = None):
    """An HTTP server for GET /features/{uid}?as_of_epoch=; the caller runs and closes it."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, unquote, urlsplit

    catalog = catalog or load_catalog()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlsplit(self.path)
            parts = url.path.split("/")
            if len(parts) != 3 or parts[1] != "features" or not parts[2]:
                return self.answer(404, {"detail": "not found"})
            given = parse_qs(url.query).get("as_of_epoch")
            try:
                as_of = float(given[-1]) if given else None
                self.answer(200, lookup(store, unquote(parts[2]), as_of, catalog))
            except NoClock as e:
                self.answer(503, {"detail": str(e)})
            except ValueError as e:
                self.answer(422, {"detail": str(e)})

        def answer(self, status: int, body: dict) -> None:
            raw = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def new_root(base: str | Path) -> str:
    return f"{str(base).rstrip('/')}/store-{uuid.uuid4().hex}"
