import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import START, brute, close, facts, hours, values
from tidemark.operators import features
from tidemark.operators.asof import asof_join
from tidemark.plans.catalog import load_catalog
from tidemark.queries import custom

SHIPPED = load_catalog()


def edges(seed):
    """Entities with one event at, just within or just before the far end of a window, a point to predict, peers of it, and later events."""
    rng = random.Random(seed)
    rows = []
    for n, (f, d) in enumerate((f, d) for f in SHIPPED.features for d in (-1, 0, 1)):
        at = hours(rng.randrange(1000)) + timedelta(microseconds=rng.choice([0, 1, 400_000, 999_999]))
        far = at - timedelta(microseconds=f.window_us - d)
        times = [far, far, at, at, at, at + timedelta(microseconds=1), at + timedelta(hours=rng.randrange(1, 900))]
        rows += [(100 * n + i, f"u{n}", t, rng.randrange(1, 4000) / 8) for i, t in enumerate(times)]
    return rows


@pytest.mark.parametrize("strategy", features.STRATEGIES)
def test_window_ends_and_peers(spark, strategy):
    rows = edges(strategy)
    got = values(features.build(facts(spark, rows), SHIPPED, strategy), SHIPPED.names)
    assert close(got, brute(rows, SHIPPED))
    # peers of one instant see the same, and not each other
    assert all(got[n + 2] == got[n + 3] == got[n + 4] for n in range(0, rows[-1][0], 100))


def random_rows(seed, n=150):
    rng = random.Random(seed)
    steps = [0, 1, 24, 168, 720, 24.5, 0.0001, 700]
    return [(i, rng.choice(["a", "b", "", None]), START + timedelta(hours=rng.choice(steps) * rng.randrange(-3, 4), microseconds=rng.choice([0, 0, 1, 999_999])), rng.randrange(-500, 5000) / 100) for i in range(n)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_strategies_against_brute_force(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = random_rows(zone)
        table = facts(spark, rows)
        points, events = features.spine(table), features.history(table)
        past, future = brute(rows, SHIPPED), brute(rows, SHIPPED, future=True)
        for strategy in features.STRATEGIES:
            assert close(values(features.build(table, SHIPPED, strategy), SHIPPED.names), past), strategy
        for strategy in ("range", "prefix", "chunked"):
            both = features.combined_features(points, events, SHIPPED, strategy)
            assert both.columns == [*features.SPINE, *SHIPPED.names, "future_sum_amt_24h", "future_count_txn_24h", "future_sum_amt_7d", "time_to_next_txn_sec"]
            assert close(values(both, SHIPPED.names), past)
            assert close(values(both, both.columns[8:]), future), strategy
        assert close(values(features.future_features(points, events, SHIPPED), SHIPPED.names), future)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_shapes_and_types(spark):
    table = facts(spark, random_rows(8, 12))
    assert features.spine(table).columns == ["label_id", "uid", "cutoff_ts", "label"]
    assert features.history(table).columns == ["uid", "feature_ts", "amount", "event_id"]
    assert features.prefix_sums(features.history(table)).columns == ["uid", "feature_ts", "amount", "event_id", "cumulative_amount", "cumulative_count"]
    kinds = dict(features.build(table, SHIPPED).dtypes)
    assert [kinds[n] for n in SHIPPED.names] == ["double", "bigint", "double", "double"]
    assert features.build(table.limit(0), SHIPPED).count() == 0


def test_future_names_may_not_collide():
    with pytest.raises(ValueError):
        features._future_names(custom(("a", "time_since_last", 1), ("b", "time_since_last", 2)))


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [True, False])
def test_asof_join(spark, direction, strict):
    rng = random.Random(1)
    left = [(i, rng.choice(["a", "b", None, "z"]), rng.randrange(30)) for i in range(60)]
    right = [(k, t, f"{k}{t}") for k in ("a", "b") for t in range(0, 30, 3)] + [(None, 5, "n")]
    out = asof_join(spark.createDataFrame(left, "id int, k string, t long"), spark.createDataFrame(right, "k string, at long, v string"), "k", "t", "at", ["v"], direction, strict, shift=2)
    back = direction == "backward"
    for r in out.collect():
        near = [(at, v) for k, at, v in right if k == r.k and k is not None and ((at < r.t + 2 if strict else at <= r.t + 2) if back else (at > r.t + 2 if strict else at >= r.t + 2))]
        assert r.v == ((max if back else min)(near)[1] if near else None)


def test_default_plan_has_one_shuffle_and_one_sort(spark):
    table = facts(spark, random_rows(3)).filter(F.col("uid").isNotNull())
    plan = features.build(table, SHIPPED)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(uid") == 1


def test_prefix_deals_rows_by_their_number(spark, monkeypatch):
    from tidemark.operators import carry

    rng = random.Random(11)
    rows = facts(spark, [(i, rng.choice(["a", "b", "c", "d", None]), hours(rng.randrange(200)), rng.randrange(50)) for i in range(300)])
    want = values(features.build(rows, load_catalog(), "range"), load_catalog().names)
    monkeypatch.setattr(carry, "TASK_ROWS", 20)
    got = features.build(rows, load_catalog(), "prefix")
    # 300 points less those without an entity, probed at four instants
    known = rows.filter("uid is not null").count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-known * 4 // 20)}), REPARTITION_BY_NUM" in plan and f", {-(-known * 5 // 20)}), REPARTITION_BY_NUM" in plan
    assert close(values(got, load_catalog().names), want)
