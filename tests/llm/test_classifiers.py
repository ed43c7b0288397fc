import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import language, toxicity
from tidemark.llm.folds import held_out
from tidemark.llm.queries import queries

SF = "/root/testdata/sf0.01"
DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, toxic int"


def test_held_out_is_the_checksum_of_the_text(spark):
    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_toxic_words_are_learnt_and_clean_texts_left_alone(spark):
    rng = random.Random(0)
    words = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(1500):
        toxic = i % 8 == 0
        text = rng.choices(words, k=rng.choice([20, 60, 600])) + (rng.choices(["vilest", "vilely", "badone"], k=3) if toxic else [])
        rng.shuffle(text)
        docs.append((i, " ".join(text), "en"))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    docs += [(9000, None, None), (9001, "", None), (0, docs[0][1], "en")]
    out = toxicity.score_toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), ["doc_id"]).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)
    scores = {r.row.doc_id: r.score for r in out}
    held = {r.row.doc_id for r in out if r.held_out} & set(range(1500))
    assert len(held) > 200 and all((scores[i] >= 0.5) == (i % 8 == 0) for i in held)
    assert all((scores[i] >= 0.5) == (i % 8 == 0) for i in set(range(1500)) - held)
    assert scores[9000] < 0.5 and scores[9001] < 0.5


def test_toxic_documents_held_out(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null").collect()}
    rows = [r for r in queries()["op4_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in toxic]
    bad, clean = [r for r in rows if toxic[r.doc_id] == 1], [r for r in rows if toxic[r.doc_id] == 0]
    assert len(bad) > 50 and sum(r.predicted for r in bad) >= 0.9 * len(bad)  # some have no toxic word left
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_toxicity_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "a", "en"), (2, None, "en")], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity.score_toxicity(df, none, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score_toxicity(df.limit(0), none, ["doc_id"]).count() == 0
    both = spark.createDataFrame([(1, "a", "en", 0.5, "r")], DOCS + ", score double, row string")
    assert toxicity.score_toxicity(both, spark.createDataFrame([(1, 1)], LABELS), both.columns).select("row.*").collect() == both.collect()


def test_nnpu_risk_does_not_go_negative_for_long():
    rng = np.random.default_rng(0)
    texts = [np.unique(np.concatenate([rng.integers(100, 400, 20), [1, 2]] if i < 60 or i % 10 == 0 else [rng.integers(100, 400, 20)])) for i in range(660)]
    weights, bias = toxicity.fit(texts, np.arange(660) < 60, 0.1)
    assert weights.min() >= 0 and weights[1] + weights[2] + bias > 0 > bias


def test_languages_held_out(spark):
    rows = queries()["op8_language_id"](spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    tested = [r for r in rows if r.held_out]
    assert len(tested) > 100 and sum(r.lang_pred == lang[r.doc_id] for r in tested) >= 0.97 * len(tested)


def test_language_edge_cases(spark):
    learnt = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", None)] * 60)]
    df = spark.createDataFrame(learnt, DOCS)
    filters = language.fit(df)
    assert filters.languages == ["de", "en"]
    asked = spark.createDataFrame([(1, "the dog", None), (2, None, None), (3, "", None), (4, "123 !", None), (5, "日本", None), (6, "DER HUND", None), (1, "the dog", None)], DOCS)
    got = sorted((r.row.doc_id, r.lang_pred) for r in language.identify(asked, filters, ["doc_id"]).collect())
    assert got[:5] == [(1, "en"), (1, "en"), (2, "und"), (3, "und"), (4, "und")] and got[6] == (6, "de") and got[5][1] in ("de", "en")
    nothing = language.fit(df.limit(0))
    assert {r.lang_pred for r in language.identify(asked, nothing, ["doc_id"]).collect()} == {"und"}
    clash = asked.withColumn("score", F.lit(1)).withColumn("row", F.lit("x"))
    assert language.identify(clash, filters, clash.columns).count() == 7 and language.identify(asked.limit(0), filters, ["doc_id"]).count() == 0


def test_bloom_filters_have_no_false_negatives_and_the_rate_they_say():
    rng = np.random.default_rng(1)
    f = language.Filters([str(i) for i in range(70)], cells=1 << 14)
    inside = rng.integers(0, 2**32, 2000).astype(np.uint32)
    f.add(3, inside)
    f.add(69, inside[:500])
    assert (f.look(inside)[0] >> np.uint64(3) & np.uint64(1)).all() and (f.look(inside[:500])[1] >> np.uint64(5) & np.uint64(1)).all()
    other = rng.integers(0, 2**32, 50_000).astype(np.uint32)
    rate = (f.look(other)[0] >> np.uint64(3) & np.uint64(1)).mean()
    assert abs(rate - f.false_rates()[3]) < 0.01
    assert f.shares(inside, np.array([2000, 0]))[3].tolist() == [1.0, 0.0]


def test_no_accepted_feature_is_left_out():
    rng = np.random.default_rng(4)
    features = np.arange(10_000)
    texts = [features[i % 20 :: 20] for i in range(60)] + [rng.integers(20_000, 30_000, 50) for _ in range(600)]
    weights, _ = toxicity.fit([np.unique(x) for x in texts], np.arange(660) < 60, 0.1)
    assert (weights[features] > 0).all() and not weights[20_000:].any()
