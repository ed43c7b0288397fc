import json
import random
import re
import threading
import urllib.error
import urllib.request
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import brute, close, facts, values
from tidemark.__main__ import main
from tidemark.operators import features, parity
from tidemark.operators.cohort import same_rows
from tidemark.plans import backfill
from tidemark.plans.catalog import DEFAULT_PATH, load_catalog
from tidemark.queries import custom
from tidemark.sources import readers, sinks
from tidemark.streaming import online, replay

SHIPPED = load_catalog()
D = datetime
FIRST, LAST = date(2022, 9, 14), date(2022, 9, 16)


def around(seed, first=FIRST, last=LAST):
    """Events of three entities and of none: at both ends of some days, one lookback before these, and anywhere near."""
    rng = random.Random(seed)
    low, high = D.combine(first, D.min.time()), D.combine(last + timedelta(days=1), D.min.time())
    us, back = timedelta(microseconds=1), timedelta(hours=SHIPPED.max_lookback_hours)
    times = [t - b + d for t in (low, low, high) for b in (timedelta(0), back) for d in (-us, timedelta(0), us)]
    times += [low + rng.random() * (high - low) for _ in range(25)] + [low - rng.random() * 1.2 * back for _ in range(25)] + [high + rng.random() * back for _ in range(5)]
    return [(i + 1, rng.choice(["k1", "k1", "k2", None]), t, rng.randrange(1, 900) / 4, rng.randrange(2)) for i, t in enumerate(times)]


def test_backfill_reruns_and_equals_the_whole_build(spark, tmp_path):
    rows = around(4)
    table = facts(spark, rows)
    how = {"output_root": str(tmp_path / "out"), "log_path": tmp_path / "log.jsonl"}
    first = backfill.run(table, str(FIRST), LAST, **how)
    built = spark.read.parquet(first.output_path)
    asked = [i for i, _, t, *_ in rows if FIRST <= t.date() <= LAST]
    whole = features.build(table, SHIPPED).filter(F.col("label_id").isin(asked))
    assert first.row_count == len(asked) and close(values(built, SHIPPED.names), values(whole, SHIPPED.names))
    before = built.collect()
    second = backfill.run(table, str(FIRST), str(LAST), **how)
    assert second.output_path == first.output_path and sorted(spark.read.parquet(second.output_path).collect(), key=str) == sorted(before, key=str)
    assert f"version=1.0.0-{SHIPPED.fingerprint}/{FIRST}_{LAST}" in first.output_path
    assert open(first.snapshot_path, "rb").read() == DEFAULT_PATH.read_bytes()
    assert not [p for p in (tmp_path / "out").rglob("*") if p.name.startswith(("_tmp", "_old"))]
    with pytest.raises(ValueError):
        backfill.run(table, LAST, FIRST, **how)
    with pytest.raises(Exception):
        backfill.run(table.drop("amount"), FIRST, LAST, **how)
    log = [json.loads(x)["status"] for x in (tmp_path / "log.jsonl").read_text().splitlines()]
    assert log == ["success", "success", "failed"] and spark.read.json(str(tmp_path / "log.jsonl")).count() == 3
    assert sorted(spark.read.parquet(first.output_path).collect(), key=str) == sorted(before, key=str)


def test_store_boundaries_and_state(spark, tmp_path):
    store = online.OnlineStore(spark, tmp_path / "store")
    (tmp_path / "store").mkdir()
    other = tmp_path / "store" / "mine.txt"
    other.write_text("x")
    with pytest.raises(online.NoClock):
        online.lookup(store, "u")
    rng = random.Random(6)
    at = rng.randrange(10**9, 10**10)
    seconds = sorted({-f.window_us // 10**6 + d for f in SHIPPED.features for d in (-2, 0, 2)} | {-7, 0, 3})
    events = [(i, "u", at + s, rng.randrange(1, 90) / 2) for i, s in enumerate(seconds)]
    result = store.replay(online.event_rows(spark, events))
    assert (result.total_rows, result.ingested_events, result.last_event_epoch) == (len(events), len(events), at + 3) and store.clock() == at + 3
    moment = lambda s: D(1970, 1, 1) + timedelta(seconds=s)
    want = brute([(i, u, moment(s), a) for i, u, s, a in events] + [(-1, "u", moment(at), 0.0)], SHIPPED)[-1]
    assert online.lookup(store, "u", at) == {"uid": "u", "as_of_epoch": at, **dict(zip(SHIPPED.names, want, strict=True))}
    assert online.lookup(store, "nobody")["count_txn_24h"] == 0 and online.lookup(store, "nobody")["time_since_last_txn_sec"] is None
    i, _, _, amount = events[3]
    store.ingest("u", i, amount, at + 5)  # the same event moves
    store.ingest("u", i, amount + 1, at + 5)  # another amount is another event
    assert store.state().count() == len(events) + 1 and store.state().filter(F.col("us") == (at + 5) * 10**6).count() == 2
    for bad in (float("nan"), float("inf"), True):
        with pytest.raises(online.BadInstant):
            online.lookup(store, "u", bad)
    with pytest.raises(ValueError):
        store.replay(online.event_rows(spark, [(1, "u", 5, 1.0), (2, "v", 4, 1.0)]))
    assert store.state().count() == len(events) + 1
    store.clear()
    assert store.clock() is None and store.state().count() == 0 and other.exists()


def test_replay_orders_observes_and_keeps_the_clock(spark, tmp_path):
    rows = edge_rows(11)
    random.Random(11).shuffle(rows)
    seen = []
    store = online.OnlineStore(spark, str(tmp_path))
    result = store.replay_facts(facts(spark, rows), observer=lambda df: seen.extend(df.collect()))
    want = brute(rows, SHIPPED)
    known = {i for i, u, *_ in rows if u is not None}
    assert close({r.label_id: list(r[3:]) for r in seen}, {i: want[i] for i in known})
    last = max(t for _, _, t, *_ in rows)
    assert (result.total_rows, result.ingested_events, result.last_event_epoch) == (len(rows), len(known), (last - D(1970, 1, 1)) // timedelta(microseconds=1) / 1e6)
    with pytest.raises(FileNotFoundError):
        readers.read_facts(spark, str(tmp_path / "nowhere"))
    for bad in ([(True, "a", 1, 1.0)], [("", "a", 1, 1.0)], [(1, "", 1, 1.0)], [(1, "a", 1, float("nan"))], [(1, "a")], [{"uid": "a"}]):
        with pytest.raises(ValueError):
            online.event_rows(spark, bad)


def edge_rows(seed=20):
    """Events of a few entities, seeded; before each of some instants there is one at, just inside and just outside every window's far end."""
    rng = random.Random(seed)
    windows = sorted({f.window_us for f in SHIPPED.features})
    instants = []
    for name in ("north", "south", "west"):
        for _ in range(2):
            at = rng.randrange(10**15, 10**15 + 10**13)
            instants += [(name, at), (name, at)] + [(name, at - w + d) for w in windows for d in (-1, 0, 1)]
        instants += [(name, rng.randrange(10**15, 10**15 + 10**13)) for _ in range(5)]
    origin = D(2020, 3, 1) - timedelta(microseconds=10**15)
    rows = [(i, name, origin + timedelta(microseconds=us), round(rng.uniform(1, 900), 2), 0) for i, (name, us) in enumerate(instants)]
    return rows + [(len(rows), None, D(2020, 3, 5), 7.5, 0)]


def test_parity_of_batch_and_store(spark, tmp_path):
    table = facts(spark, edge_rows())
    known = table.filter("uid is not null").count()
    store = online.OnlineStore(spark, str(tmp_path / "store"))
    result = parity.store_parity(table, store, SHIPPED, parity.ParityOptions(50))
    assert (result.sample_count, result.comparison_count, result.mismatch_count, result.ok) == (50, 50 * len(SHIPPED.names), 0, True)
    # a fault planted in the store is found
    last = table.filter("uid = 'north'").orderBy(F.desc("event_ts")).first().event_ts
    store.ingest("north", "planted", 1e6, last - timedelta(minutes=30))
    found = parity.store_parity(table, store, SHIPPED, replay=False)
    assert not found.ok and {r.uid for r in found.mismatches.collect()} == {"north"}
    assert parity.store_parity(table, store, SHIPPED).ok  # a replay starts afresh
    offline = features.build(table, SHIPPED)
    served = store.features_at(offline.filter("uid is not null").select("label_id", "uid", "cutoff_ts"), SHIPPED)
    wrong = served.withColumn("sum_amt_24h", F.when(F.col("label_id") == 3, 1e6).otherwise(F.col("sum_amt_24h"))).drop("sum_amt_7d")
    reasons = parity.run_parity(offline, wrong, SHIPPED.names).mismatches.groupBy("reason").count().collect()
    assert dict(map(tuple, reasons)) == {"values_differ": 1, "online_feature_missing": known}
    for bad in ({"sample_size": 49}, {"sample_size": True}, {"rel_tol": -1}, {"abs_tol": float("nan")}):
        with pytest.raises(ValueError):
            parity.ParityOptions(**bad)
    with pytest.raises(ValueError):
        parity.run_parity(offline, served, SHIPPED.names, parity.ParityOptions(known + 1))


def test_parity_on_the_command_line(spark, tmp_path):
    rows = edge_rows(3)
    last = max(r[2] for r in rows if r[1] == "south")
    sinks.write_facts(facts(spark, rows), str(tmp_path / "facts"))
    where = ["parity", "--facts", str(tmp_path / "facts"), "--store", str(tmp_path / "store")]
    assert main(where, spark) == 0
    online.OnlineStore(spark, str(tmp_path / "store")).ingest("south", 10**9, 5.0, last - timedelta(minutes=30))
    assert main([*where, "--as-stored"], spark) == 1


def test_event_log_appends_resolves_and_compacts(spark, tmp_path):
    log = online.ParquetLog(spark, str(tmp_path / "log"))
    rows = [(f"u{i % 40}", str(i), float(i), i) for i in range(200)]
    log.put(spark.createDataFrame(rows, online.STATE))
    log.put(spark.createDataFrame([("u1", "1", 1.0, 999), ("u1", "1", 2.0, 5)], online.STATE))
    want = sorted((set(rows) - {("u1", "1", 1.0, 1)}) | {("u1", "1", 1.0, 999), ("u1", "1", 2.0, 5)})
    assert sorted(map(tuple, log.events().collect())) == want
    asked = log.events(["u1", "nobody"])
    assert sorted(map(tuple, asked.collect())) == [r for r in want if r[0] == "u1"]
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (=|IN) ", asked._jdf.queryExecution().executedPlan().toString())
    log.compact()
    log.put(spark.createDataFrame([("u1", "1", 2.0, 6)], online.STATE))
    assert ("u1", "1", 2.0, 6) in set(map(tuple, log.events(["u1"]).collect())) and log.events().count() == len(want)


def test_a_replay_that_fails_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    store = online.OnlineStore(spark, str(tmp_path / "store"))
    store.replay_facts(facts(spark, edge_rows(7)))
    before = sorted(map(tuple, store.state().collect()))
    with pytest.raises(Exception, match="broken"):
        rows = facts(spark, edge_rows(8)).select("transaction_id", "uid", F.lit(1).cast("long").alias("us"), F.when(F.col("transaction_id") > 3, F.raise_error(F.lit("broken"))).otherwise(F.col("amount")).alias("amount"))
        store.replay(rows)
    assert sorted(map(tuple, store.state().collect())) == before


class FrameLog:
    """An event log of a test: one frame in memory."""

    def __init__(self, spark):
        self.frame, self.us = spark.createDataFrame([], online.STATE), None

    def put(self, rows):
        new = rows.select("uid", F.col("transaction_id").cast("string").alias("transaction_id"), F.col("amount").cast("double").alias("amount"), "us")
        self.frame = self.frame.unionByName(new)

    def events(self, uids=None):
        return self.frame if uids is None else self.frame.filter(F.col("uid").isin(list(uids)))

    def clock(self):
        return self.us

    def set_clock(self, us):
        self.us = us

    def clear(self):
        self.frame, self.us = self.frame.limit(0), None


def test_any_event_log_will_do(spark):
    store = online.OnlineStore(spark, log=FrameLog(spark))
    table = facts(spark, edge_rows(5))
    assert parity.store_parity(table, store, SHIPPED).ok and online.lookup(store, "north")["uid"] == "north"
    with pytest.raises(ValueError):
        online.OnlineStore(spark)


def test_named_relations(spark):
    assert sinks.relation(spark.range(3), "three_rows").count() == 3 and spark.sql("SELECT * FROM three_rows").count() == 3
    sinks.relation(spark.range(4), "three_rows")
    assert spark.table("three_rows").count() == 4
    assert sinks.relation(spark.range(5), "five_rows", temporary=False).count() == 5
    assert sinks.relation(spark.range(6), "five_rows", temporary=False).count() == 6
    spark.sql("DROP TABLE five_rows")
    with pytest.raises(ValueError):
        sinks.relation(spark.range(1), "x; DROP")


def test_a_crash_between_the_renames_loses_nothing(spark, tmp_path):
    place = tmp_path / "table"
    sinks.publish(spark.range(3), str(place))
    place.rename(tmp_path / "_old-table-x")
    assert sinks.restore(spark, str(place)) and spark.read.parquet(str(place)).count() == 3
    assert not sinks.restore(spark, str(place))
    place.rename(tmp_path / "_old-table-y")
    assert sinks.publish(spark.range(5), str(place)) == 5 and sorted(p.name for p in tmp_path.iterdir()) == ["table"]


def test_streaming_replay_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", replay.STATE_PROVIDER)
    rows = sorted(edge_rows()[:-1], key=lambda r: (r[2], r[0]))
    source = tmp_path / "in"
    for n in range(3):  # a file a micro-batch; peers of one instant may be cut apart
        facts(spark, rows[n * 25 : (n + 1) * 25 if n < 2 else None]).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(readers.FACT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = replay.stream_features(stream, SHIPPED)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.schema(replay.output_schema(SHIPPED)).parquet(str(tmp_path / "out"))
    assert got.filter("late").count() == 0
    assert close(values(got, SHIPPED.names), values(features.build(facts(spark, rows), SHIPPED), SHIPPED.names))


def test_a_stream_is_observed_once_and_refuses_to_go_back(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", replay.STATE_PROVIDER)
    rows = sorted(edge_rows(30)[:-1], key=lambda r: (r[2], r[0]))
    source, root = tmp_path / "in", str(tmp_path / "out")
    seen = []

    def run():
        stream = spark.readStream.schema(readers.FACT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        replay.replay_stream(stream, SHIPPED, root, lambda df, n: seen.append((n, df.count())), availableNow=True).awaitTermination(180)

    def add(some):
        facts(spark, some).coalesce(1).write.mode("append").parquet(str(source))

    add(rows[:30])
    run()
    add(rows[30:])
    run()
    published = lambda: spark.read.parquet(f"{root}/features")
    assert seen == [(0, 30), (1, len(rows) - 30)]
    assert close(values(published(), SHIPPED.names), values(features.build(facts(spark, rows), SHIPPED), SHIPPED.names))
    # a crash after a batch was published, before Spark noted it: it runs again
    (tmp_path / "out" / "checkpoint" / "commits" / "1").unlink()
    for left in (tmp_path / "out" / "checkpoint" / "commits").glob(".1*"):
        left.unlink()
    run()
    assert len(seen) == 2 and published().count() == len(rows)
    assert close(values(published(), SHIPPED.names), values(features.build(facts(spark, rows), SHIPPED), SHIPPED.names))
    # another entity's event from before: nothing of its batch is published or observed
    add([(5000, "elsewhere", rows[-1][2] - timedelta(seconds=1), 1.0, 0)])
    with pytest.raises(Exception, match="older than"):
        run()
    assert len(seen) == 2 and published().count() == len(rows)


def test_state_of_idle_entities_expires_when_asked_to(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", replay.STATE_PROVIDER)
    begin, month = datetime(2023, 3, 1), SHIPPED.max_lookback_hours
    hours = {"idle": [0], "edge": [0, month], "busy": [0, month + 1, 3 * month]}
    rows = [(n, u, begin + timedelta(hours=h), 2.0 + h, 0) for n, (u, h) in enumerate((u, h) for u, hs in hours.items() for h in hs)]
    want = values(features.build(facts(spark, rows), SHIPPED), SHIPPED.names)

    def replayed(name, expire_after, batches):
        source, root, held = tmp_path / f"in-{name}", str(tmp_path / name), []
        for some in batches:
            facts(spark, some).coalesce(1).write.mode("append").parquet(str(source))
            stream = spark.readStream.schema(readers.FACT_SCHEMA).parquet(str(source))
            replay.replay_stream(stream, SHIPPED, root, expire_after=expire_after, availableNow=True).awaitTermination(180)
            state = spark.read.format("statestore").option("stateVarName", "events").option("flattenCollectionTypes", True).load(f"{root}/checkpoint")
            held.append({r.key.uid for r in state.select("key").distinct().collect()})
        got = spark.read.parquet(f"{root}/features")
        assert close(values(got.filter("label_id < 100"), SHIPPED.names), want)
        return got, held

    assert replayed("kept", None, [rows])[1] == [{"idle", "edge", "busy"}]
    instants = [[r for r in rows if r[2] == t] for t in sorted({r[2] for r in rows})]
    back = (100, "idle", begin + timedelta(hours=3 * month + 1), 7.0, 0)
    got, held = replayed("expiring", "0 seconds", [*instants, [back]])
    # at the very end of the window the state is needed, so it is there; an entity whose state went begins anew
    assert held == [{"idle", "edge", "busy"}, {"idle", "edge", "busy"}, {"edge", "busy"}, {"busy"}, {"busy", "idle"}]
    assert [got.filter("label_id = 100").first()[n] for n in SHIPPED.names] == [0.0, 0, 0.0, None]


def test_events_behind_the_watermark_come_out_late(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", replay.STATE_PROVIDER)
    begin, source = datetime(2023, 3, 1), tmp_path / "in"
    batches = [[(1, "a", 10)], [(2, "b", 9), (3, "c", 4), (4, "a", 10)]]
    for n, rows in enumerate(batches):
        facts(spark, [(i, u, begin + timedelta(hours=h), 1.0, 0) for i, u, h in rows]).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(readers.FACT_SCHEMA).parquet(str(source))
        out = replay.stream_features(stream, SHIPPED, "2 hours")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
        assert n or spark.read.parquet(str(tmp_path / "out")).count() == 1
    got = {r.label_id: (r.late, r.count_txn_24h) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (False, 0), 2: (False, 0), 3: (True, None), 4: (False, 0)}


def test_http(spark, tmp_path):
    store = online.OnlineStore(spark, str(tmp_path))
    server = online.serve(store, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def get(path):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}{path}") as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, None

    try:
        assert get("/features/u")[0] == 503
        assert get("/features/u?as_of_epoch=nan")[0] == 422 and get("/x")[0] == 404
        store.set_clock(1000)
        status, body = get("/features/u")
        assert status == 200 and body["as_of_epoch"] == 1000 and body["sum_amt_24h"] == 0
        assert get("/features/u?as_of_epoch=5")[1]["as_of_epoch"] == 5
    finally:
        server.shutdown()
        server.server_close()


def test_sources_and_sinks(spark, tmp_path):
    csv = tmp_path / "raw.csv"
    csv.write_text("TransactionID,isFraud,TransactionDT,TransactionAmt,card1,card2,addr1,other\n1,0,10,5.5,1,2.0,3,x\n2,1,20,6.5,1,2.0,3,y\n")
    df = readers.read_csv(spark, str(csv), ["TransactionID"])
    assert dict(df.dtypes)["TransactionAmt"] == "double" and "other" in readers.column_names(df)
    assert dict(readers.read_csv(spark, str(csv), infer=True).dtypes)["isFraud"] == "int"
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(csv), ["nope"])
    assert main(["warehouse", "--csv-path", str(csv), "--output", str(tmp_path / "facts")], spark) == 0
    stored = readers.read_facts(spark, str(tmp_path / "facts"))
    assert [r.transaction_id for r in readers.in_order(stored, "event_ts")] == [1, 2]
    assert main(["offline", "--facts", str(tmp_path / "facts"), "--output", str(tmp_path / "features")], spark) == 0
    assert main(["catalog"]) == 0
    assert main(["replay", "--facts", str(tmp_path / "facts"), "--store", str(tmp_path / "store"), "--features", str(tmp_path / "seen")], spark) == 0
    assert sorted(r.label_id for r in spark.read.parquet(str(tmp_path / "seen")).collect()) == [1, 2]
    assert sinks.export_report(spark.range(3), tmp_path / "r.csv", ["id"]) == 3
    with pytest.raises(ValueError):
        sinks.export_report(spark.range(3), tmp_path / "r.csv", ["id"], limit=2)
    assert sinks.markdown_table(["a"], [[None], [1]]).count("|") == 8


def test_a_day_is_written_by_several_tasks(spark):
    rows = facts(spark, [(i, f"u{i % 50}", D(2022, 9, 14) + timedelta(seconds=i), 1.0, 0) for i in range(4000)])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        built = backfill.requested(rows, FIRST, FIRST, SHIPPED).repartitionByRange("cutoff_ts", "label_id")
        assert built.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_changed_facts_rebuild_the_days_that_can_differ(spark, tmp_path):
    catalog = custom(("sum_30h", "sum", 30), ("since_50h", "time_since_last", 50))
    rng = random.Random(1)
    start = D(2022, 9, 1)
    rows = [(i, rng.choice(["a", "b", None]), start + timedelta(days=rng.randrange(20), seconds=rng.randrange(86_400)), rng.randrange(1, 400) / 4, 0) for i in range(150)]
    day = date(2022, 9, 9)
    gone = [r for r in rows if r[2].date() == date(2022, 9, 15)]
    late = [(1000 + i, "a", D(2022, 9, 9, 0, 0) + timedelta(hours=h), 5.0, 0) for i, h in enumerate((0, 12, 23.9))]
    root = str(tmp_path / "days")
    backfill.write_days(features.build(facts(spark, rows), catalog), root)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "days").rglob("*.parquet")}
    before = files()
    now = facts(spark, [r for r in rows if r not in gone] + late)
    built = backfill.refresh(now, facts(spark, late + gone), root, catalog)
    # 23.9 h and 50 h later is the third day after
    assert built[:4] == [day + timedelta(days=d) for d in range(4)] and date(2022, 9, 15) in built and date(2022, 9, 14) not in built
    got, want = spark.read.parquet(root).drop("day"), features.build(now, catalog)
    assert close(values(got, catalog.names), values(want, catalog.names)) and got.count() == want.count()
    changed = {p.parent.name for p in set(before) ^ set(files())}
    assert changed <= {f"day={d}" for d in built} and not list((tmp_path / "days").glob("day=2022-09-15"))
    assert backfill.refresh(now, facts(spark, []), root, catalog) == []


def test_same_rows_counts_and_orders(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, None, 0.0)], "x long, y string, z double")
    assert same_rows(df, df.orderBy(F.desc("x"))) and same_rows(df.limit(0), df.limit(0))
    assert not same_rows(df, df.distinct()) and not same_rows(df, df.withColumn("z", F.lit(1.0))) and not same_rows(df, df.drop("z"))
    # nulls are told from one another by place
    a, b = spark.createDataFrame([(1, None)], "x int, y int"), spark.createDataFrame([(None, 1)], "x int, y int")
    assert not same_rows(a, b) and same_rows(a, a.select("x", F.col("y").cast("long").alias("y")))
