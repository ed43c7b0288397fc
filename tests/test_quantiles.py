import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.profiling import numeric_profile, outliers
from tidemark.operators.quantiles import order_statistics, quantiles

FRACTIONS = [0, 0.001, 0.25, 0.5, 0.75, 0.95, 0.99, 1]


@pytest.mark.parametrize("few, accuracy", [(5, 20), (50, 100), (100_000, 10_000)])
def test_quantiles_of_any_distribution(spark, few, accuracy):
    rng = random.Random(few)
    n = 3000
    columns = {
        "even": [rng.uniform(-5, 5) for _ in range(n)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(n)],
        "ties": [float(rng.choice([0, 0, 0, 0, 0, 1, 2, 7])) for _ in range(n)],
        "steps": [float(i // 997) for i in range(n)],
        "same": [3.5] * n,
        "gaps": [rng.gauss(0, 1) if rng.random() < 0.3 else None for _ in range(n)],
        "none": [None] * n,
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(6)
    got = quantiles(df, list(columns), FRACTIONS, few, accuracy)
    for c, values in columns.items():
        kept = [v for v in values if v is not None]
        for f in FRACTIONS:
            assert got[c, f] is None if not kept else math.isclose(got[c, f], float(np.quantile(kept, f)), rel_tol=1e-12, abs_tol=1e-12), (c, f)


def test_every_rank(spark):
    rng = random.Random(1)
    values = [float(rng.randrange(40)) for _ in range(200)] + [rng.random() * 40 for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = order_statistics(df, {"x": range(400)}, {"x": 400}, few=6, accuracy=8)
    assert [got["x", r] for r in range(400)] == sorted(values)


def test_many_distinct_values_need_few_jobs_and_no_large_buffer(spark):
    df = spark.range(2_000_000).select((F.xxhash64("id") / 1e6).alias("x"))
    spark.sparkContext.setJobGroup("many", "many")
    try:
        got = quantiles(df, ["x"], [0.5, 0.95])
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("many"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 12
    for f in (0.5, 0.95):
        below = df.filter(F.col("x") <= got["x", f]).count()
        assert abs(below - f * 2_000_000) <= 1


def test_profiles_of_nothing(spark):
    df = spark.createDataFrame([], "a double, b int")
    assert [(r.column_name, r.n, r.median) for r in numeric_profile(df, ["a", "b"]).collect()] == [("a", 0.0, None), ("b", 0.0, None)]
    assert outliers(df, "a").collect() == []
    assert outliers(spark.createDataFrame([(None,), (1.0,), (-2.0,)], "a double"), "a").first().n_not_positive == 1
