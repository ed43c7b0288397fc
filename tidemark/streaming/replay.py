"""Replay as a Structured Streaming query: features of each event from keyed state, then the event goes into it.

Per entity the state is the list of events within the longest window and the latest instant seen. Rows of a
micro-batch are ordered by instant; peers of one instant do not see each other, whichever batch brings them. A row
older than its entity's latest instant is not dropped: it comes out flagged as late, without features, and is not
stored. ``replay_stream`` checks order over all entities, as a batch replay does, and refuses a micro-batch that goes back.

State of an entity without new events stays, unless ``expire_after`` is given: then a timer of event time clears it when the
watermark has passed its last event by the longest window, from when on no event in order can see it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.timeutil import micros
from tidemark.plans.catalog import FeatureCatalog
from tidemark.sources import sinks
from tidemark.sources.readers import exists
from tidemark.streaming.runs import EntityRun

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def output_schema(catalog: FeatureCatalog) -> T.StructType:
    kinds = {"sum": T.DoubleType(), "count": T.LongType(), "time_since_last": T.DoubleType()}
    head = [T.StructField("label_id", T.LongType()), T.StructField("uid", T.StringType()), T.StructField("us", T.LongType()), T.StructField("late", T.BooleanType())]
    return T.StructType(head + [T.StructField(f.name, kinds[f.aggregation]) for f in catalog.features])


class AsOfProcessor(StatefulProcessor):
    """Compute before ingest, per entity. With ``expires``, in event time, an entity's state goes when no event in order can see it."""

    def __init__(self, catalog: FeatureCatalog, expires: bool = False):
        self.catalog, self.expires = catalog, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", T.StructType([T.StructField("us", T.LongType()), T.StructField("amount", T.DoubleType())]))
        self.latest = handle.getValueState("latest", T.StructType([T.StructField("us", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "transaction_id"], kind="stable")
        held = [(int(us), float(a)) for us, a in self.events.get()] if self.events.exists() else []
        latest = int(self.latest.get()[0]) if self.latest.exists() else None
        run = EntityRun(held)
        passed = timerValues.getCurrentWatermarkInMs() * 1000 if self.expires else 0  # 0: no watermark yet
        out = []
        for us, group in batch.groupby("us", sort=True):
            us = int(us)
            late = (latest is not None and us < latest) or (passed > 0 and us < passed)
            values = [None] * len(self.catalog.features) if late else run.values(self.catalog, us)
            out += [(int(r), key[0], us, late, *values) for r in group["transaction_id"]]
            if not late:
                for a in group["amount"]:
                    run.add(us, float(a))
                    held.append((us, float(a)))
                latest = us
        if latest is not None:
            reach = latest - self.catalog.max_lookback_hours * 3_600_000_000
            self.events.put([(us, a) for us, a in held if us >= reach])  # no later cutoff sees what is before
            self.latest.update((latest,))
            if self.expires:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(latest // 1000 + self.catalog.max_lookback_hours * 3_600_000 + 2)
        frame = pd.DataFrame(out, columns=["label_id", "uid", "us", "late", *self.catalog.names])
        for f in self.catalog.features:
            if f.aggregation == "count":
                frame[f.name] = frame[f.name].astype("Int64")
            else:
                frame[f.name] = frame[f.name].astype("float64")
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.events.clear()
        self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_features(stream: DataFrame, catalog: FeatureCatalog, expire_after: str | None = None) -> DataFrame:
    """A streaming frame of transactions (transaction_id, uid, event_ts, amount) to label_id, uid, us, late and the features.

    Rows without an entity have no features and are left out. Needs ``STATE_PROVIDER`` as the state store provider.

    ``expire_after`` (an interval, such as "0 seconds") says how far an event may be behind the latest of all entities in earlier
    micro-batches. With it, state of an entity that had no event for the longest window beyond that is removed, and an event further
    behind comes out late, as the state it would need may be gone. Events before 1970 never expire.
    """
    rows = stream.filter("uid is not null").select("transaction_id", "uid", micros(F.col("event_ts")).alias("us"), F.col("amount").cast("double").alias("amount"))
    if expire_after is not None:
        # the watermark's column does not go on: with it Spark would drop late rows, which are to come out flagged
        rows = rows.withColumn("_at", F.timestamp_micros("us")).withWatermark("_at", expire_after).drop("_at")
    mode = "None" if expire_after is None else "EventTime"
    return rows.groupBy("uid").transformWithStateInPandas(AsOfProcessor(catalog, expire_after is not None), output_schema(catalog), "Append", mode)


class OutOfOrder(ValueError):
    """A micro-batch has an event older than one of an earlier micro-batch, of whatever entity."""


def _latest_before(spark: SparkSession, root: str, batch: int) -> int | None:
    """The latest instant of the batches before one, from the record of the last of them."""
    fs, folder = sinks._fs(spark, f"{root}/batches")
    if not fs.exists(folder):
        return None
    ids = [int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json")]
    earlier = [i for i in ids if i < batch]
    return json.loads(spark.read.text(f"{root}/batches/{max(earlier)}.json").first()[0])["latest"] if earlier else None


def replay_stream(stream: DataFrame, catalog: FeatureCatalog, root: str, observer: Callable[[DataFrame, int], None] | None = None, expire_after: str | None = None, **trigger) -> StreamingQuery:
    """Start a replay of a stream of transactions: features per micro-batch in ``root/features/batch=N``, a record of each in ``root/batches``.

    A micro-batch with an event older than any of an earlier one, of this or another entity, stops the query with OutOfOrder
    before its features are published. ``observer`` is called with each published micro-batch's features and number, in order; a
    micro-batch that Spark runs again after a crash is published again, with the same rows, but not observed again. Rows without an
    entity are left out. ``expire_after`` removes the state of idle entities (see ``stream_features``). ``trigger`` goes to the query's
    trigger.
    """
    spark, root = stream.sparkSession, root.rstrip("/")

    def publish(rows: DataFrame, batch: int) -> None:
        record, place, fresh = f"{root}/batches/{batch}.json", f"{root}/features/batch={batch}", f"{root}/_checking/{batch}"
        rows.write.mode("overwrite").parquet(fresh)
        rows = spark.read.schema(rows.schema).parquet(fresh)
        seen = rows.agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count_if("late").alias("late")).first()
        before = _latest_before(spark, root, batch)
        if seen.late or (seen.first is not None and before is not None and seen.first < before):
            sinks.delete(spark, fresh)
            raise OutOfOrder(f"micro-batch {batch} has events older than {before}")
        again = exists(spark, record)
        sinks.delete(spark, place)
        sinks.rename(spark, fresh, place)
        latest = max((x for x in (before, seen.last) if x is not None), default=None)
        sinks.write_bytes(spark, record, json.dumps({"batch": batch, "latest": latest}).encode())
        if observer is not None and not again:
            observer(spark.read.schema(rows.schema).parquet(place), batch)

    writer = stream_features(stream, catalog, expire_after).writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(publish)
    return (writer.trigger(**trigger) if trigger else writer).start()
