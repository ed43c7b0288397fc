import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bytetext as bt
from tidemark.llm import web_quality as Q
from tidemark.llm.queries import queries

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int"


def test_features_are_shares():
    texts = ["Aa aa Bb", None, "", "x! x! x! x! y?", "one\none\ntwo\n\n", "ab"]
    got = {}
    for s in bt.slices(pa.array(texts)):
        for d, k, v in zip(*Q.features(s), strict=True):
            got.setdefault(int(d), {})[int(k)] = float(v)
    at = {name: Q.FORMS + i for i, name in enumerate(Q.STATISTICS)}
    assert sorted(v for k, v in got[0].items() if k < Q.FORMS) == [pytest.approx(1 / 3), pytest.approx(2 / 3)]
    assert 1 not in got and 2 not in got
    assert got[3][at["most common word"]] == 0.8 and got[3][at["words equal to the one before"]] == pytest.approx(0.6) and got[3][at["words seen before"]] == pytest.approx(0.6)
    assert got[4][at["lines seen before"]] == pytest.approx(1 / 3) and got[5][at["under 5 words"]] == 1


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9])
def test_class_prior_of_a_mixture(share):
    rng = np.random.default_rng(0)
    good = lambda n: rng.normal(2, 1, n)
    mixed = np.concatenate([good(int(20_000 * share)), rng.normal(-2, 1, 20_000 - int(20_000 * share))])
    assert Q.class_prior(good(10_000), mixed) == pytest.approx(share, abs=0.03)
    assert Q.class_prior(np.zeros(0), mixed) == 0.5


def test_risk_is_corrected_where_it_gets_negative():
    rng = np.random.default_rng(1)
    kind = lambda good: (np.array([int(rng.integers(0, 50) if good else rng.integers(50, 100)), Q.FORMS]), np.array([1.0, 0.5]))
    positive, unlabelled = Q.Texts([kind(True) for _ in range(300)]), Q.Texts([kind(i % 5 > 0) for i in range(1000)])
    w, b = Q.fit(positive, unlabelled, 0.8)
    assert (Q._sigmoid(Q.Texts([kind(True) for _ in range(200)]).scores(w, b)) > 0.5).mean() > 0.95
    assert (Q._sigmoid(Q.Texts([kind(False) for _ in range(200)]).scores(w, b)) < 0.5).mean() > 0.95


def test_good_documents_held_out(spark):
    sf = "/root/testdata/sf0.1"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality is not null").collect()}
    rows = [r for r in queries()["op12_quality_classifier"](spark, sf).collect() if r.held_out and r.doc_id in quality]
    good, bad = [r for r in rows if quality[r.doc_id] == 1], [r for r in rows if quality[r.doc_id] == 0]
    assert len(good) > 500 and sum(r.predicted for r in good) >= 0.99 * len(good)
    assert len(bad) > 100 and sum(r.predicted == 0 for r in bad) >= 0.93 * len(bad)


def test_no_labels_no_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, None), (None, "")], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert Q.learn(docs, none) is None and Q.learn(docs.limit(0), spark.createDataFrame([(1, 1)], LABELS)) is None
    assert [r.score for r in Q.score_quality(docs, None, ["doc_id"]).collect()] == [0.5] * 4
    clash = docs.withColumn("score", F.lit("x")).withColumn("row", F.lit(1)).withColumn("p", F.lit(2))
    model = Q.learn(clash, spark.createDataFrame([(1, 1), (2, 0), (None, 1)], LABELS))
    got = Q.score_quality(clash, model, clash.columns)
    assert sorted(map(str, got.select("row.*").collect())) == sorted(map(str, clash.collect())) and all(0 <= r.score <= 1 for r in got.collect())
    assert Q.score_quality(docs.limit(0), model, ["doc_id"]).count() == 0


def test_a_long_bad_text_is_bad(spark):
    rng = random.Random(2)
    words = [f"{rng.choice('abcdefg')}{'xyzuvw'[i % 6]}oro{i}".rstrip("0123456789") for i in range(300)]
    plain = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    noisy = lambda n: " ".join(rng.choice(words) + rng.choice(["###", "$$$", "&&&"]) for _ in range(n))
    rows = [(i, plain(80) if i % 4 else noisy(80)) for i in range(1200)] + [(5000, plain(200_000)), (5001, noisy(200_000))]
    docs = spark.createDataFrame(rows, DOCS)
    model = Q.learn(docs, spark.createDataFrame([(i, 1) for i in range(1200) if i % 4], LABELS))
    got = {r.row.doc_id: r.score for r in Q.score_quality(docs, model, ["doc_id"]).collect()}
    assert got[5000] >= 0.5 > 0.3 > got[5001]
    assert sum((got[i] >= 0.5) == (i % 4 > 0) for i in range(1200)) >= 1190
