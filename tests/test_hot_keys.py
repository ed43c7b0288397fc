"""Keys of many rows: the same values as in one window, no task with the whole key."""

import bisect
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import START, brute, close, facts, values
from tidemark.functions.timeutil import micros
from tidemark.operators import carry, features
from tidemark.operators.asof import asof_join
from tidemark.plans.catalog import load_catalog

SHIPPED = load_catalog()


def hot_rows(seed, n=400):
    """One entity with most rows, some in bursts of a millisecond and at one instant, and others of a few."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        uid = rng.choice(["hot", "hot", "hot", "warm", None])
        at = START + timedelta(hours=rng.choice([0, 24, 168, 720, 900])) + timedelta(microseconds=rng.choice([0, 0, 1, rng.randrange(10**3), rng.randrange(10**9), rng.randrange(10**12)]))
        out.append((i, uid, at, rng.randrange(-200, 900) / 4))
    return out


@pytest.mark.parametrize("bucket_rows", [1, 7, 100])
def test_rolling_features_of_hot_entities(spark, bucket_rows):
    rows = hot_rows(bucket_rows)
    df = facts(spark, rows)
    got = features.build(df, SHIPPED, "prefix", hot_rows=50, bucket_rows=bucket_rows)
    assert close(values(got, SHIPPED.names), brute(rows, SHIPPED))
    both = features.combined_features(features.spine(df), features.history(df), SHIPPED, "prefix", hot_rows=50, bucket_rows=bucket_rows)
    names = [features.future_name(f) for f in SHIPPED.features]
    assert close(values(both, SHIPPED.names), brute(rows, SHIPPED)) and close(values(both, names), brute(rows, SHIPPED, future=True))


def test_auto_takes_each_entity_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(features, "MANY_ROWS", 100)
    rows = hot_rows(3)
    df = facts(spark, rows)
    seen = []
    real = features._by_prefixes
    monkeypatch.setattr(features, "_by_prefixes", lambda points, *a: (seen.append({r.uid for r in points.select("uid").distinct().collect()}), real(points, *a))[1])
    assert close(values(features.build(df, SHIPPED), SHIPPED.names), brute(rows, SHIPPED))
    assert close(values(features.future_features(features.spine(df), features.history(df), SHIPPED), SHIPPED.names), brute(rows, SHIPPED, future=True))
    assert seen == [{"hot"}, {"hot"}]
    for few in (10_000, 0):  # as a list on the driver, or joined
        monkeypatch.setattr(features, "FEW_KEYS", few)
        assert close(values(features.build(df, SHIPPED), SHIPPED.names), brute(rows, SHIPPED))


def test_running_sums_of_hot_entities(spark):
    df = features.history(facts(spark, hot_rows(5)))
    want = sorted(map(tuple, features.prefix_sums(df, hot_rows=None).collect()))
    for few in (carry.FEW_KEYS, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(carry, "FEW_KEYS", few)
            assert sorted(map(tuple, features.prefix_sums(df, hot_rows=20, bucket_rows=5).collect())) == want


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [True, False])
def test_asof_of_hot_keys(spark, direction, strict):
    rng = random.Random(direction + str(strict))
    key = lambda: rng.choice(["hot", "hot", "hot", "warm", None])
    at = lambda: rng.choice([None, rng.randrange(50), rng.randrange(50), 10**6 + rng.randrange(4), rng.randrange(-(10**12), 10**12)])
    left = [(i, key(), at(), "x") for i in range(300)]
    right = sorted({(key(), at()) for _ in range(300)}, key=str)
    right = [(k, t, n, f"s{n}") for n, (k, t) in enumerate(right)]
    per = {}
    for k, t, n, _ in right:
        if k is not None and t is not None:
            per.setdefault(k, []).append((t, n))
    want = {}
    for i, k, t, _ in left:
        times = sorted(per.get(k, []))
        inner = [x for x, _ in times]
        found = None
        if k is not None and t is not None and direction == "backward":
            j = (bisect.bisect_left if strict else bisect.bisect_right)(inner, t + 3) - 1
            found = times[j][1] if j >= 0 else None
        elif k is not None and t is not None:
            j = (bisect.bisect_right if strict else bisect.bisect_left)(inner, t + 3)
            found = times[j][1] if j < len(times) else None
        want[i] = found
    a = spark.createDataFrame(left, "id long, uid string, t long, state string")
    b = spark.createDataFrame(right, "uid string, t long, n long, name string")
    for heat in ({"hot_rows": None}, {"hot_rows": 100, "bucket_rows": 10}, {"hot_rows": 1, "bucket_rows": 1}):
        got = asof_join(a, b, "uid", "t", "t", ["n", "name"], direction, strict, shift=3, **heat).collect()
        assert {r.id: r.n for r in got} == want and len(got) == 300 and all(r.name == (None if r.n is None else f"s{r.n}") and r.state == "x" for r in got)


def test_no_bucket_holds_more_than_it_should(spark):
    # half of all rows in a thousandth of the time
    rows = spark.range(40_000).select(F.lit("hot").alias("key"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") * 1000).alias("at"))
    rows = rows.unionByName(spark.range(500).select(F.concat(F.lit("cold"), F.col("id") % 50).alias("key"), F.col("id").alias("at")))
    heat = carry.heat_of(rows, 1000, 500)
    dealt = carry.bucketed(rows, heat)
    assert dealt.filter("hot").groupBy("key", "bucket").count().agg(F.max("count")).first()[0] <= 500
    assert dealt.filter("not hot").select("key", "bucket").distinct().count() == 50
    assert carry.heat_of(rows, 100_000, 500) is None and carry.heat_of(rows.limit(0), 1, 1) is None


def test_no_window_or_exchange_of_rows_is_by_the_key_alone(spark, monkeypatch):
    df = facts(spark, hot_rows(6, 2000))
    states = features.prefix_sums(features.history(df), 200, 50)
    left = features.spine(df).select("label_id", "uid", micros(F.col("cutoff_ts")).alias("us"))
    frames = {
        "sums": states,
        "asof": asof_join(left, states.withColumn("at", micros(F.col("feature_ts"))), "uid", "us", "at", ["cumulative_amount"], hot_rows=200, bucket_rows=50),
        "features": features.build(df, SHIPPED, "prefix", hot_rows=200, bucket_rows=50),
    }
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        for name, frame in frames.items():
            # rows of the hot entity meet in windows by bucket; by entity alone there are rows of buckets only
            n = df.filter("uid = 'hot'").count()
            most = frame.filter("uid = 'hot'").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
            assert most < n / 3, (name, most, n)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
