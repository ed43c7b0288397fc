import hashlib
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import START, facts, hours
from tidemark.functions.keys import require_columns, safe_name, values_equal
from tidemark.functions.timeutil import epoch_micros, parse_date
from tidemark.operators import cohort, entity, evidence, features, metrics, monitoring, profiling, warehouse
from tidemark.plans.catalog import load_catalog


def points(spark, offsets):
    return features.spine(facts(spark, [(i + 1, "a", hours(h), 1) for i, h in enumerate(offsets)]))


def random_offsets(seed, lookback, n=40):
    """Hours from the start, some just at or beside the ends that a lookback leaves."""
    rng = random.Random(seed)
    last = rng.randrange(3 * lookback, 4 * lookback)
    ends = [lookback + d for d in (-1, 0, 1)] + [last - lookback + d for d in (-1, 0, 1)]
    return [0, last, *ends, *(rng.randrange(last) for _ in range(n))]


def test_observation_bounds_are_closed(spark):
    offsets = random_offsets(1, 90)
    p = points(spark, offsets)
    b = cohort.observation_bounds(p, 90)
    inside = [i + 1 for i, h in enumerate(offsets) if 90 <= h <= max(offsets) - 90]
    assert (b.start, b.end, b.total_rows, b.eligible_rows, b.excluded_rows) == (hours(90), hours(max(offsets) - 90), len(offsets), len(inside), len(offsets) - len(inside))
    assert sorted(r.label_id for r in cohort.eligible(p, b).collect()) == inside
    with pytest.raises(ValueError):
        cohort.observation_bounds(p, max(offsets))
    with pytest.raises(ValueError):
        cohort.observation_bounds(p.limit(0), 90)


@pytest.mark.parametrize("fraction", [0.1, 0.5, 0.75])
def test_split_keeps_equal_instants_together(spark, fraction):
    offsets = sorted(h // 20 * 20 for h in random_offsets(2, 50))  # many of one instant
    p = points(spark, offsets)
    b = cohort.ObservationBounds(hours(20), hours(140), len(offsets), sum(20 <= h <= 140 for h in offsets))
    inside = [h for h in offsets if 20 <= h <= 140]
    at = cohort.split_timestamp(p, b, fraction)
    assert at == hours(inside[math.ceil(fraction * len(inside)) - 1])
    if at > hours(inside[0]):
        train, test = cohort.temporal_split(cohort.eligible(p, b), at)
        assert (train.count(), test.count()) == (sum(hours(h) < at for h in inside), sum(hours(h) >= at for h in inside))
    for bad in (0, 1, 1.5):
        with pytest.raises(ValueError):
            cohort.split_timestamp(p, b, bad)


def test_experiment_frames_share_rows(spark):
    offsets = random_offsets(3, load_catalog().max_lookback_hours, 25)
    f = cohort.experiment_frames(facts(spark, [(i, f"e{i % 3}", hours(h), 1 + i) for i, h in enumerate(offsets)]), load_catalog(), 0.5)
    assert f.bounds.eligible_rows == sum(load_catalog().max_lookback_hours <= h <= max(offsets) - load_catalog().max_lookback_hours for h in offsets)
    spine = f.past.select(*features.SPINE)
    assert cohort.same_rows(spine, f.future.select(*features.SPINE)) and cohort.same_rows(spine, f.combined.select(*features.SPINE))


def test_hash_sample_is_exact_and_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "label_id")
    a = sorted(r.label_id for r in cohort.hash_sample(df, "label_id", 64).collect())
    assert len(a) == 64 and a == sorted(r.label_id for r in cohort.hash_sample(df.repartition(7), "label_id", 64).collect())


def test_warehouse_and_gates(spark):
    raw = [(1, 0, 3600, 10.0, 1, 2, 3), (2, 1, 7200, 20.0, 1, 2, 3), (3, 0, 9000, 5.0, None, 2, 3)]
    table = warehouse.build_transactions(spark.createDataFrame(raw, "TransactionID long, isFraud int, TransactionDT long, TransactionAmt double, card1 long, card2 long, addr1 long"))
    rows = table.orderBy("transaction_id").collect()
    assert rows[0].event_ts == datetime(2017, 12, 1, 1) and rows[2].uid is None and rows[0].uid == rows[1].uid and len(rows[0].uid) == 32
    warehouse.check(table, 3)
    with pytest.raises(ValueError, match="expected"):
        warehouse.check(table, 4)
    good = [(1, "a", START, 1.0, 0), (2, "a", START, 1.0, 1)]
    bad = [(1, "a", START, 1.0, 0)], [(None, "a", START, 1.0, 0)], [(3, "a", None, 1.0, 0)], [(3, "a", START, 1.0, 2)], [(3, "a", START, math.nan, 0)], [(3, "a", START, math.inf, 0)], [(3, "", START, 1.0, 0)], [(3, "b", START, 1.0, 0)]
    warehouse.check(facts(spark, good))
    for extra in bad:
        with pytest.raises(ValueError):
            warehouse.check(facts(spark, good + extra))
    with pytest.raises(ValueError):
        warehouse.check(facts(spark, []))
    with pytest.raises(ValueError, match="b, c"):
        require_columns(table, ["c", "uid", "b"])


def test_entity_candidates(spark):
    rows = [(1, 1, 1, 1, 10), (1, 1, 1, 1, 11), (1, 1, 1, 1, 12), (2, 1, 1, 1, 10), (2, 1, None, 1, 11), (None, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "card1 int, card2 int, card5 int, addr1 int, D1 int")
    keys = entity.candidates(("card1", "addr1"), ("card1", "card5"), ("card1", "card2", "addr1", "D1"))
    metrics = entity.candidate_metrics(df, keys)
    ordered = entity.ranked(metrics).collect()
    got = {r.candidate: r for r in ordered}
    assert (got["card1_addr1"].rows_with_uid, got["card1_addr1"].coverage_pct, got["card1_addr1"].repeat_entity_pct) == (5, 83.33, 100.0)
    assert (got["card1_card2_addr1_D1"].repeat_entity_pct, got["card1_card2_addr1_D1"].median_per_entity) == (0.0, 1.0)
    assert [r.candidate for r in ordered] == ["card1_addr1", "card1_card5", "card1_card2_addr1_D1"]
    with pytest.raises(ValueError):
        entity.candidate_metrics(df.drop("card5"), keys)
    with pytest.raises(ValueError):
        entity.candidate_metrics(df, ())
    chosen = entity.with_decision(metrics, "card1_addr1", "it repeats").filter("selected").collect()
    assert [r.selection_reason for r in chosen] == ["it repeats"]


def test_profiles(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (2, 3.0)], "id int, amount double")
    assert {r.column_name: r.n_missing for r in profiling.missing_profile(df, ["id", "amount"]).collect()} == {"id": 0, "amount": 1}
    assert profiling.id_quality(df, "id").first()["n_duplicate"] == 1
    assert profiling.numeric_profile(df, ["amount"]).first()["median"] == 2.0


def brute_metrics(s, y):
    pos, neg = s[y == 1], s[y == 0]
    auc = float(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)))
    ap, recall = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        k = s >= t
        r = y[k].sum() / y.sum()
        ap += (r - recall) * y[k].mean()
        recall = r
    return auc, ap


def test_metrics_against_brute_force(spark):
    rng = np.random.default_rng(0)
    y = (rng.random(300) < 0.3).astype(int)
    s = np.round(rng.random(300) + 0.3 * y, 1)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "score double, label int")
    row = metrics.ranking_metrics(df, "score").first()
    assert (row.roc_auc, row.average_precision) == pytest.approx(brute_metrics(s, y))
    curve = metrics.roc_curve(df, "score").orderBy("threshold").collect()
    assert curve[0].fpr == curve[0].tpr == 1.0 and len(curve) == len(set(s))
    metrics.check_inputs(df, "score")
    for bad in (df.withColumn("score", F.lit(float("nan"))), df.withColumn("label", F.lit(1)), df.withColumn("label", F.lit(2))):
        with pytest.raises(ValueError):
            metrics.check_inputs(bad, "score")
    assert metrics.ranking_metrics(df.limit(0), "score").first().roc_auc is None
    # a metric does not pass over bad inputs
    for bad in (df.withColumn("score", F.lit(float("nan"))), df.withColumn("score", F.lit(None).cast("double")), df.withColumn("label", F.lit(2))):
        with pytest.raises(Exception, match="finite|neither"):
            metrics.ranking_metrics(bad, "score").collect()
    with pytest.raises(ValueError, match="infinite"):
        metrics.check_features(df.withColumn("score", F.lit(float("inf"))), ["score"])
    metrics.check_features(df.withColumn("score", F.lit(float("nan"))), ["score"])


def test_resampling_studies(spark):
    rng = random.Random(2)
    rows = [(i, rng.random(), float(i % 3 == 0) + rng.random(), int(i % 3 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    boot = {r.metric: r for r in metrics.paired_bootstrap(df, "a", "b", "id", replicates=40).collect()}
    assert boot["roc_auc"].low <= boot["roc_auc"].delta <= boot["roc_auc"].high and boot["roc_auc"].low > 0
    mixed = metrics.shuffled_block(df, ["b"], "id", 1)
    assert sorted(r.b for r in mixed.collect()) == sorted(r[2] for r in rows) and mixed.join(df, ["id", "b"]).count() < 50
    lost = {r.feature: r.importance for r in metrics.permutation_importance(df, F.col("a") * 0 + F.col("b"), ["a", "b"], "id", repeats=1).collect()}
    assert abs(lost["a"]) < 1e-9 < lost["b"]


def test_shuffles_of_all_repeats_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randrange(9)), rng.random(), int(rng.random() < 0.3)) for i in rng.sample(range(1000), 150)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int").repartition(3)
    got = {r.repeat: (r.roc_auc, r.average_precision) for r in metrics.block_shuffle_study(df, F.col("a") + F.col("b"), ["b"], "id", repeats=3).collect()}
    by_id = sorted(rows)
    for r in range(3):
        given = [by_id[i][2] for i in metrics.permuted(np.arange(len(rows)), len(rows), 42 + r)]
        assert got[r] == pytest.approx(brute_metrics(np.array([x[1] + g for x, g in zip(by_id, given, strict=True)]), np.array([x[3] for x in by_id])))
    assert len(got) == 3
    assert [tuple(r) for r in metrics.block_shuffle_study(df.limit(0), F.col("a"), ["b"], "id", repeats=1).collect()] == [(0, None, None)]


@pytest.mark.parametrize("ties", [True, False])
def test_shuffles_in_many_blocks_and_ranges(spark, monkeypatch, ties):
    monkeypatch.setattr(metrics, "BLOCK", 64)
    monkeypatch.setattr(metrics, "RANGE_ROWS", 100)
    monkeypatch.setattr(metrics, "ROWS_AT_ONCE", 700)
    rng = random.Random(6)
    rows = [(i, float(rng.randrange(3)), float(rng.randrange(2)) if ties else rng.random(), int(rng.random() < 0.3)) for i in rng.sample(range(9000), 1500)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int").repartition(3)
    score, by_id, y = F.col("a") + F.col("b"), sorted(rows), np.array([r[3] for r in sorted(rows)])
    a, b = (np.array([r[i] for r in by_id]) for i in (1, 2))
    want = {c: [brute_metrics((a[at] + b) if c == "a" else (a + b[at]), y) for at in (metrics.permuted(np.arange(1500), 1500, 42 + r) for r in range(4))] for c in "ab"}
    lost = metrics.permutation_importance(df, score, ["a", "b"], "id", repeats=4)
    # the plan of the result holds no study: only small numbers wait on the driver
    assert "Exchange hashpartitioning" not in lost._jdf.queryExecution().executedPlan().toString()
    for r in lost.collect():
        ap = np.array([x[1] for x in want[r.feature]])
        assert (r.importance, r.deviation) == pytest.approx((brute_metrics(a + b, y)[1] - ap.mean(), ap.std(ddof=1)))
    got = {r.repeat: (r.roc_auc, r.average_precision) for r in metrics.block_shuffle_study(df, score, ["b"], "id", repeats=4).collect()}
    assert all(got[r] == pytest.approx(want["b"][r]) for r in range(4)) and len(got) == 4
    with pytest.raises(Exception, match="neither"):
        metrics.block_shuffle_study(df.withColumn("label", F.lit(2)), score, ["b"], "id", repeats=1)


@pytest.mark.parametrize("ties", [True, False])
def test_shuffles_scored_by_a_function(spark, monkeypatch, ties):
    monkeypatch.setattr(metrics, "BLOCK", 64)
    monkeypatch.setattr(metrics, "RANGE_ROWS", 100)
    monkeypatch.setattr(metrics, "ROWS_AT_ONCE", 700)
    rng = random.Random(7)
    rows = [(i, float(rng.randrange(3)), float(rng.randrange(2)) if ties else rng.random() ** 9, int(rng.random() < 0.3)) for i in rng.sample(range(900), 150)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int").repartition(3)
    column, function = F.col("a") + F.col("b"), lambda x: x["a"] + x["b"]
    study = lambda rows, score: [tuple(r) for r in metrics.block_shuffle_study(rows, score, ["b"], "id", repeats=4).sort("repeat").collect()]
    for got, want in zip(study(df, function), study(df, column), strict=True):
        assert got == pytest.approx(want)
    if ties:
        return
    got, want = (metrics.permutation_importance(df, score, ["b"], "id", repeats=2).first() for score in (function, column))
    assert tuple(got) == pytest.approx(tuple(want))
    assert study(df.limit(0), function) == [(i, None, None) for i in range(4)]
    for label in (F.lit(2), F.lit(None).cast("int")):
        with pytest.raises(Exception, match="neither"):
            study(df.withColumn("label", label), function)
    for bad in (F.lit(float("inf")), F.when(F.col("id") != rows[0][0], F.col("b"))):
        with pytest.raises(Exception, match="finite"):
            study(df.withColumn("b", bad), function)


def test_permutation_by_tables_and_by_rounds(monkeypatch):
    for n in (1, 2, 3, 1000, 65_537, 6_000_000, 36_000_000):
        x = np.random.default_rng(n).integers(0, n, 40_000)
        by_tables = metrics.permuted(x, n, 43)
        monkeypatch.setattr(metrics, "TABLE_BITS", 0)
        assert (metrics.permuted(x, n, 43) == by_tables).all() and by_tables.min() >= 0 and by_tables.max() < n
        monkeypatch.undo()
    # as in the round before tables
    assert metrics.permuted(np.array([0, 1, 999_999, 35_999_999]), 36_000_000, 42).tolist() == [7527522, 3614908, 2756215, 15332369]


def test_scores_of_a_range_numbered_or_sorted():
    rng = np.random.default_rng(8)
    for values in (6, 10**9):  # few: numbered; many: sorted
        repeat, score, pos = rng.integers(0, 7, 5000).astype(np.int16), rng.integers(-values, values, 5000) * 0.5, rng.integers(0, 2, 5000).astype(np.int8)
        score[score == 0] = np.where(rng.random((score == 0).sum()) < 0.5, -0.0, 0.0)
        want = {}
        for r, s, y in zip(repeat.tolist(), score.tolist(), pos.tolist(), strict=True):
            x = want.setdefault((r, -s + 0.0), [0, 0])
            x[1 - y] += 1
        got = metrics._by_score(repeat, score, pos, 1 - pos, 7)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == [(r, *want[r, s]) for r, s in sorted(want)]


def test_edges_below_scores():
    rng = np.random.default_rng(5)
    for edges in ([], [0.0], [1.0, 1.0 + 2**-52], [-1e308, 0.0, 1e308], np.unique(rng.random(800) ** 20), np.unique(rng.normal(size=900).round(2) * 1e6)):
        edges = np.array(edges, float)
        x = np.concatenate([edges, np.nextafter(edges, -np.inf), np.nextafter(edges, np.inf), [-1e308, 1e308, 0.0, -0.0, 5e-324], rng.normal(size=3000) * (np.abs(edges).max(initial=1) / 8), rng.random(3000)])
        assert (metrics._below(edges)(x) == np.searchsorted(edges, x, "left")).all()


def test_first_qualifying_row(spark):
    rows = [(1, "a", hours(1), 0, 9, 9), (2, None, hours(5), 0, 9, 9), (3, "a", hours(6), 0, 0, 9), (5, "b", hours(7), 0, 1, 2), (4, "b", hours(7), 0, 3, 4), (6, "c", hours(8), 0, 1, 1)]
    df = spark.createDataFrame(rows, "label_id long, uid string, cutoff_ts timestamp_ntz, label int, past int, future int")
    assert tuple(cohort.first_qualifying(df, hours(2), ["past", "future"]).first()) == (4, "b", hours(7), 0, 3, 4)
    assert cohort.first_qualifying(df, hours(9), ["past", "future"]).count() == 0


def test_evidence_verdict_and_report(spark):
    rng = random.Random(4)
    rows = [(i, rng.random(), float(i % 3 == 0) + 0.3 * rng.random(), int(i % 3 == 0)) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    score = F.col("a") * 0.1 + F.col("b")
    base = metrics.ranking_metrics(df.select(score.alias("s"), "label"), "s").first().asDict()
    both = df.withColumn("both", score)
    f = evidence.findings(3, 1, metrics.paired_bootstrap(both, "a", "both", "id", replicates=40), metrics.permutation_importance(df, score, ["b"], "id", repeats=4), metrics.block_shuffle_study(df, score, ["b"], "id", repeats=20), base)
    table = {r.question: r.supports for r in evidence.evidence_table(spark, f).collect()}
    assert len(table) == 5 and list(table.values()).count(True) == 4 and list(table.values()).count(None) == 1
    assert f.relies_on_one and f.relies_on_block and {i.sign for i in f.intervals} == {1}
    assert "relies on it" in evidence.verdict(f) and "above 0" in evidence.verdict(f)
    none = evidence.Findings(0, 0, [evidence.Interval("roc_auc", 0.0, -0.1, 0.1), evidence.Interval("average_precision", -0.2, -0.3, -0.1)], {"b": (0.001, 0.01)}, {"roc_auc": (0.1, 0.5)})
    assert not none.relies_on_one and not none.relies_on_block and "holds 0" in evidence.verdict(none) and "below 0" in evidence.verdict(none)
    text = evidence.report("Study", {"cohort": "x"}, [("past", 4, 0.5, 0.1), ("past and future", 8, 0.9, 0.8)], f)
    assert text.startswith("# Study") and text.count("\n## ") == 5 and "| past and future | 8 | 0.900000 | 0.800000 |" in text


def test_monitoring(spark):
    a = spark.createDataFrame([(float(x),) for x in range(100)], "v double")
    same = monitoring.stability(a, a, "v", [25, 50, 75]).agg(F.sum("psi")).first()[0]
    moved = monitoring.stability(a, a.filter("v > 60"), "v", [25, 50, 75]).agg(F.sum("psi")).first()[0]
    assert same == pytest.approx(0) and moved > 1
    assert monitoring.stability(a, a.limit(0), "v", [1]).count() == 3


def test_small_functions(spark):
    for bad in (datetime(2020, 1, 1), "2020-1-1", "20200101", 5, "x"):
        with pytest.raises(ValueError):
            parse_date(bad, "start")
    for bad in (True, math.nan, math.inf, "x", None):
        with pytest.raises(ValueError):
            epoch_micros(bad)
    assert epoch_micros("1970-01-01T00:00:01") == epoch_micros(1) == epoch_micros(datetime(1970, 1, 1) + timedelta(seconds=1)) == 1_000_000
    for bad in ("", "a b", "1a", "a;b"):
        with pytest.raises(ValueError):
            safe_name(bad)
    cases = [(None, None, True), (None, math.nan, True), (1.0, None, False), (1.0, 1.0 + 1e-10, True), (1.0, 1.1, False), (math.inf, math.inf, True), (math.inf, 1.0, False)]
    rows = spark.createDataFrame([c[:2] for c in cases], "a double, b double").select(values_equal(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in rows] == [c[2] for c in cases]


def test_poisson_weights_are_poisson():
    rng = np.random.default_rng(0)
    w = metrics.poisson_weights(rng.integers(0, 2**32, 4000), rng.integers(0, 2**32, 4000), 50)
    for k in range(5):
        assert abs((w == k).mean() - math.exp(-1) / math.factorial(k)) < 0.003
    assert abs(w.mean() - 1) < 0.01 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06


@pytest.mark.parametrize("parts, frequent", [(1, 2.0), (7, 0.05), (7, 2.0)])
def test_bootstrap_against_whole_resamples(spark, monkeypatch, parts, frequent):
    monkeypatch.setattr(metrics, "FREQUENT", frequent)
    rng = random.Random(parts)
    n = 2500
    rows = [(i, rng.random(), float(rng.choice([0, 0, 0, 1, 2, 3])), int(rng.random() < 0.3)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int").repartition(5)
    got = {r.metric: r for r in metrics.paired_bootstrap(df, "a", "b", "id", replicates=30, seed=5, parts=parts).collect()}
    hashes = [hashlib.md5(f"5:{i}".encode()).hexdigest() for i in range(n)]
    w = metrics.poisson_weights(np.array([int(h[:8], 16) for h in hashes]), np.array([int(h[8:16], 16) for h in hashes]), 30)
    y = np.array([r[3] for r in rows])

    def account(score, weight):
        values = sorted(set(score), reverse=True)
        pos = np.array([(weight * y)[score == v].sum() for v in values], float)
        neg = np.array([(weight * (1 - y))[score == v].sum() for v in values], float)
        tp, fp = pos.cumsum(), neg.cumsum()
        return (pos * (neg.sum() - fp + neg / 2)).sum() / (pos.sum() * neg.sum()), (pos / pos.sum() * tp / np.maximum(tp + fp, 1)).sum()

    gains = np.array([np.subtract(account(np.array([r[2] for r in rows]), w[:, k]), account(np.array([r[1] for r in rows]), w[:, k])) for k in range(30)])
    for i, m in enumerate(("roc_auc", "average_precision")):
        assert got[m].n_valid == 30 and got[m].low == pytest.approx(np.quantile(gains[:, i], 0.025)) and got[m].high == pytest.approx(np.quantile(gains[:, i], 0.975))


def test_bootstrap_computes_its_rows_once_and_deals_them_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(metrics, "RANGE_OF_SCORES", 100)
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.random(), float(rng.randrange(3)), i % 2) for i in range(1000)], "id long, a double, b double, label int")
    watched_df = df.mapInArrow(watched, df.schema)
    assert {r.n_valid for r in metrics.paired_bootstrap(watched_df, "a", "b", "id", replicates=5, parts=2).collect()} == {5}
    assert seen.value == 1000
    study = metrics._Resampled(df, "a", "label", "id", 5, 42, 2)
    assert study.rows.rdd.getNumPartitions() == 10 and study.rows.agg(F.max("cut")).first()[0] == 9
    study.close()


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 65, 1000, 70_000])
def test_permutations_are_permutations(n):
    a, b = metrics.permuted(np.arange(n), n, 1), metrics.permuted(np.arange(n), n, 2)
    assert sorted(a) == list(range(n)) and sorted(b) == list(range(n))
    if n > 60:
        assert (a == b).sum() < 20 + n / 50 and abs(np.corrcoef(a, np.arange(n))[0, 1]) < 4 / n**0.5 + 0.1
        assert metrics.permuted(np.array([5, 9]), n, 1).tolist() == [a[5], a[9]]
