"""The online evaluator: against plain Python, and apart from the batch build."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import brute, close, facts, values
from tests.test_hot_keys import hot_rows
from tidemark.functions.timeutil import micros
from tidemark.operators import carry, features, parity
from tidemark.plans.catalog import load_catalog
from tidemark.streaming import online, runs

SHIPPED = load_catalog()


def us_of(t):
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


@pytest.mark.parametrize("segment", [1, 3, 4096])
def test_runs_of_a_store(spark, segment):
    rows = hot_rows(segment, 250)
    df = facts(spark, rows)
    state = df.select("uid", micros(F.col("event_ts")).alias("us"), "amount")
    made = runs.sorted_runs(state, segment, hot_rows=50, bucket_rows=20)
    assert max(len(r.times) for r in made.collect()) <= segment
    got = runs.look_up(features.spine(df), made, SHIPPED, hot_rows=50, bucket_rows=20)
    assert close(values(got, SHIPPED.names), brute(rows, SHIPPED))
    twice = runs.look_up(features.spine(df).unionByName(features.spine(df).limit(30)), made, SHIPPED)
    assert twice.count() == len(rows) + 30
    assert dict(got.dtypes)["count_txn_24h"] == "bigint"
    assert runs.look_up(features.spine(df).limit(0), made, SHIPPED).count() == 0
    none = runs.look_up(features.spine(df), made.limit(0), SHIPPED)
    assert {tuple(v) for v in values(none, SHIPPED.names).values()} == {(0.0, 0, 0.0, None)}


def test_many_questions_get_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(carry, "TASK_ROWS", 50)
    rows = hot_rows(5, 250)
    df = facts(spark, rows)
    made = runs.sorted_runs(df.select("uid", micros(F.col("event_ts")).alias("us"), "amount"), 3)
    got = runs.look_up(features.spine(df), made, SHIPPED)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the join, the segments with their questions, and the answers by point
    assert plan.count(f", {-(-len(rows) * 4 // 50)}), REPARTITION_BY_NUM") >= 3 and "SortAggregate(key=[k" not in plan
    assert close(values(got, SHIPPED.names), brute(rows, SHIPPED))


def test_one_entity_in_memory():
    rng = random.Random(1)
    rows = [(i, "u", datetime(2022, 1, 1) + timedelta(hours=rng.choice([0, 1, 24, 168, 720]), microseconds=rng.randrange(3)), rng.randrange(100) / 4) for i in range(80)]
    whole, grown = runs.EntityRun((us_of(t), a) for _, _, t, a in rows), runs.EntityRun()
    for _, _, t, a in rows:
        grown.add(us_of(t), a)
    want = brute(rows, SHIPPED)
    for run in (whole, grown):
        assert close({i: run.values(SHIPPED, us_of(t)) for i, _, t, _ in rows}, want)


def test_a_fault_of_the_batch_build_is_seen(spark, tmp_path, monkeypatch):
    df = facts(spark, hot_rows(8, 150))
    store = online.OnlineStore(spark, str(tmp_path / "store"))
    assert parity.store_parity(df, store, SHIPPED).ok
    real = features._framed

    def late(feature, keys, future):
        """Windows whose ends are one event short."""
        return real(feature, keys, future) - (F.when(F.col("amount") > 0, 1).otherwise(0) if feature.aggregation == "sum" else 0)

    monkeypatch.setattr(features, "_framed", late)
    found = parity.store_parity(df, store, SHIPPED)
    assert not found.ok and {r.feature_name for r in found.mismatches.collect()} == {"sum_amt_24h", "sum_amt_7d"}
    assert {r.reason for r in found.mismatches.collect()} == {"values_differ"}


def test_lookups_run_no_job_once_an_entity_is_known(spark, tmp_path):
    rows = hot_rows(9, 120)
    store = online.OnlineStore(spark, str(tmp_path / "store"), fresh=3600.0)
    store.replay_facts(facts(spark, rows))
    online.lookup(store, "hot")
    group = "lookups"
    spark.sparkContext.setJobGroup(group, group)
    try:
        rng = random.Random(2)
        for _ in range(50):
            at = us_of(rows[rng.randrange(len(rows))][2]) // 10**6
            got = online.lookup(store, "hot", at)
            want = brute([*rows, (-1, "hot", datetime(1970, 1, 1) + timedelta(seconds=at), 0.0)], SHIPPED)[-1]
            assert close({0: [got[n] for n in SHIPPED.names]}, {0: want})
        assert online.lookup(store, "hot")["as_of_epoch"] == store.recent_clock() / 1e6
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    before = online.lookup(store, "hot", at)["count_txn_24h"]
    store.ingest("hot", "new", 1.0, at - 1)  # what the store writes it sees at once
    assert online.lookup(store, "hot", at)["count_txn_24h"] == before + 1
    # an entity of too many events is asked for in Spark
    small = online.OnlineStore(spark, str(tmp_path / "store"), cached_events=5)
    assert small.run_of("hot") is None and online.lookup(small, "hot", at)["count_txn_24h"] == before + 1
    assert sum(len(r) for _, r in small._runs.values()) <= 5
