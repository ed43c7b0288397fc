"""What models are fitted on is bounded in rows, whatever doc_ids there are."""

from pyspark.sql import functions as F

from tidemark.llm import language
from tidemark.llm.folds import sample_rows


def test_rows_of_one_id_are_bounded(spark):
    docs = spark.range(20_000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    copies = spark.range(20_000).select(F.lit(8).alias("doc_id"), F.lit("the same").alias("text"))
    few = spark.range(100, 150).select(F.col("id").alias("doc_id"), F.lit("other").alias("text"))
    docs = docs.unionByName(copies).unionByName(few).unionByName(spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x").alias("text")))
    ids = docs.select("doc_id")
    got = sample_rows(docs, ids, 60, 1)
    assert got.count() == 60 and got.filter("doc_id is null").isEmpty()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sample_rows(docs.repartition(3), ids.repartition(5), 60, 1).collect()))
    assert sample_rows(docs.filter("doc_id = 8"), ids, 60, 1).count() == 1
    assert sample_rows(docs, ids, 10, 1).count() == 10
    assert sample_rows(docs.limit(0), ids, 10, 1).count() == 0 and sample_rows(docs, ids.limit(0), 10, 1).count() == 0


def test_languages_of_one_id_are_bounded(spark, monkeypatch):
    seen = []
    grams = language.Filters.add
    monkeypatch.setattr(language.Filters, "add", lambda self, i, g: (seen.append(len(g)), grams(self, i, g))[1])
    words = F.concat_ws(" ", F.hex(F.xxhash64("id")), F.hex(F.xxhash64("id")))
    for doc_id in (F.lit(None).cast("long"), F.lit(1)):
        docs = spark.range(20_000).select(doc_id.alias("doc_id"), words.alias("text"), F.lit("en").alias("lang"))
        language.fit(docs, per_language=10)
        # a text has 32 letters and digits, so at most this many of four in a row
        assert 0 < seen.pop() <= 10 * 34
