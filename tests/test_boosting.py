"""Boosted trees: against a learner in plain Python, row by row."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting, metrics

SCHEMA = "id long, a double, b double, c double, label int"
ONE = 1 << 30


def some_rows(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = rng.choice([None, float("nan"), rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)])
        b, c = float(rng.randrange(6)), rng.choice([None, 1.0])
        seen = a is not None and a == a
        odds = (1.5 if not seen else a) + (b in (1, 2)) - 1.2 * (c is None)
        out.append((i, a, b, c, int(rng.random() < 1 / (1 + math.exp(-odds)))))
    return out


def missing(v):
    return v is None or v != v


def edges_of(values, bins):
    known = sorted(v for v in values if not missing(v))
    out = set()
    for j in range(1, bins):
        p = j / bins * (len(known) - 1)
        x, y = known[math.floor(p)], known[math.ceil(p)]
        out.add(x if x == y else x + (y - x) * (p - math.floor(p)))
    return sorted(out)


def learn(rows, trees, depth, bins, rate=0.1, l2=1.0, least=1.0):
    """Scores by id. A test is (column, edge or None, side of missing values): left where the value is at most the edge."""
    edges = [edges_of([r[1 + c] for r in rows], bins) for c in range(3)]
    pos = sum(r[4] for r in rows)
    margin = {r[0]: math.log(pos / (len(rows) - pos)) for r in rows}

    def weight(g, h):
        return (g / ONE) ** 2 / (h / ONE + l2)

    def goes_left(r, test):
        c, edge, side = test
        return side if missing(r[1 + c]) else edge is not None and r[1 + c] <= edge

    for _ in range(trees):
        slope = {}
        for r in rows:
            p = 1 / (1 + math.exp(-margin[r[0]]))
            slope[r[0]] = round((p - r[4]) * ONE), round(p * (1 - p) * ONE)
        total = lambda part: tuple(sum(slope[r[0]][i] for r in part) for i in (0, 1))

        def split(part, level):
            g, h = total(part)
            best = (0.0, None)
            for c in range(3) if level < depth else ():
                for test in [*((c, e, side) for e in edges[c] for side in (True, False)), (c, None, True)]:
                    gl, hl = total([r for r in part if goes_left(r, test)])
                    if min(hl, h - hl) < least * ONE:
                        continue
                    gain = weight(gl, hl) + weight(g - gl, h - hl) - weight(g, h)
                    if gain > best[0]:
                        best = (gain, test)
            if best[1] is None:
                if level == 0:
                    return False
                for r in part:
                    margin[r[0]] += -rate * (g / ONE) / (h / ONE + l2)
                return True
            for side in (True, False):
                split([r for r in part if goes_left(r, best[1]) == side], level + 1)
            return True

        if not split(rows, 0):
            break
    return {i: 1 / (1 + math.exp(-m)) for i, m in margin.items()}


@pytest.mark.parametrize("seed, tasks, chunk", [(1, 64, 10), (2, 0, 2)])
def test_against_rows_one_by_one(spark, monkeypatch, seed, tasks, chunk):
    monkeypatch.setattr(boosting, "TASKS", tasks)
    monkeypatch.setattr(boosting, "CHUNK", chunk)
    rows = some_rows(seed, 220)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = boosting.fit(df, ["a", "b", "c"], trees=5, depth=3, bins=8)
    got = {r.id: r.score for r in df.select("id", model.score().alias("score")).collect()}
    want = learn(rows, 5, 3, 8)
    assert len(model.trees) == 5 and got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-12
    assert sum(model.importance.values()) == pytest.approx(1) and min(model.importance.values()) > 0


def test_the_same_at_every_partitioning_and_a_missing_value_tells(spark):
    rows = some_rows(3, 3000)
    found = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts, "b")
        scored, importance = metrics.boosted_trees(df, df, ["a", "b", "c"], trees=25, depth=4)
        found.append(({r.id: r.score for r in scored.collect()}, importance))
    assert found[0] == found[1]
    scored = spark.createDataFrame([(i, s) for i, s in found[0][0].items()], "id long, score double").join(df, "id")
    assert metrics.roc_auc(scored, "score").first()[0] > 0.78
    # only that a value is missing tells the label
    df = spark.range(400).select("id", F.when(F.col("id") % 3 > 0, F.rand(1)).alias("a"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    scored, _ = metrics.boosted_trees(df, df.withColumn("score_of_mine", F.lit(1)), ["a"], trees=30)
    assert scored.filter((F.col("score") > 0.5) != (F.col("label") == 1)).count() == 0 and scored.columns == ["id", "a", "label", "score_of_mine", "score"]


def test_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(ValueError):
        boosting.fit(make([]), ["a"])
    with pytest.raises(Exception, match="neither 0 nor 1"):
        boosting.fit(make([(1, 1.0, 1.0, 1.0, 2), (2, 1.0, 1.0, 1.0, None)]), ["a"])
    with pytest.raises(ValueError, match="infinite"):
        metrics.boosted_trees(make([(1, float("inf"), 1.0, 1.0, 1)]), make([]), ["a"])
    same = make([(i, None, 2.0, None, i % 2) for i in range(40)])
    model = boosting.fit(same, ["a", "b"])
    assert model.trees == [] and model.importance == {"a": 0.0, "b": 0.0}
    assert {r.s for r in same.select(model.score().alias("s")).collect()} == {0.5}
    ones = boosting.fit(make([(i, float(i), 2.0, None, 1) for i in range(9)]), ["a", "b"])
    assert ones.trees == [] and ones.start == pytest.approx(math.log(9.5 / 0.5))
