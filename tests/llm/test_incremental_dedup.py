import random

import pytest

from tests.llm.test_repeats import SCHEMA, brute, corpus, result
from tidemark.llm import incremental_dedup
from tidemark.llm.incremental_dedup import PassageIndex


def opened(spark, name):
    """As another session opens it."""
    return PassageIndex(spark.newSession(), name, buckets=2)


def test_batches_of_several_sessions_are_as_all_at_once(spark):
    docs = corpus()
    random.Random(4).shuffle(docs)
    batches = [docs[:20], docs[20:21], docs[21:45], [], docs[45:]]
    before: list = []
    try:
        for some in batches:
            index = opened(spark, "Sessions")
            was = {x: 0 for x in brute(before, 35, True)}
            rows = result(index.add(index.spark.createDataFrame(some, SCHEMA)))
            now = brute(before + some, 35, True)
            new = brute_of(before, some)
            assert rows == new
            assert result(index.result()) == now
            changed = result(index.revised())
            # every earlier document that is not as it was is told
            assert {x for x in now if x not in was} - set(new) <= set(changed) and set(changed) <= set(now)
            before = before + some
        assert len(opened(spark, "sessions").batches) == len(batches)
    finally:
        opened(spark, "sessions").drop()
    assert not spark.sql("SHOW TABLES LIKE 'sessions*'").collect()


def brute_of(before, some):
    """Rows of the last documents, judged with all."""
    marked = [((0, d), t) for d, t in before] + [((1, d), t) for d, t in some]
    return sorted(((d[1], *r) for d, *r in brute(marked, 35, True) if d[0]), key=str)


def test_a_broken_addition_is_taken_out(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(60))
    first, second = [(1, "a b " + passage)], [(2, passage + " c"), (3, "alone")]
    rows = lambda some: spark.createDataFrame(some, SCHEMA)
    try:
        PassageIndex(spark, "broken", buckets=2).add(rows(first))
        for step in ("segments", "match"):
            index = PassageIndex(spark, "broken", buckets=2)
            with monkeypatch.context() as m:
                m.setattr(incremental_dedup.rp, step, lambda *a: (_ for _ in ()).throw(OSError("an executor too many is gone")))
                with pytest.raises(OSError):
                    index.add(rows(second))
        index = PassageIndex(spark, "broken", buckets=2)
        assert result(index.result()) == brute(first, 35, True)
        assert result(index.add(rows(second))) == brute_of(first, second)
        assert result(index.result()) == brute(first + second, 35, True)
        assert [r.doc_id for r in index.revised().collect()] == [1]
    finally:
        PassageIndex(spark, "broken", buckets=2).drop()
    assert not spark.sql("SHOW TABLES LIKE 'broken*'").collect()


def test_other_settings_and_an_empty_index(spark):
    index = PassageIndex(spark, "settled", buckets=2)
    try:
        with pytest.raises(ValueError):
            PassageIndex(spark, "settled", width=20, buckets=2)
        for ask in (index.result, index.revised):
            with pytest.raises(ValueError):
                ask()
        clashing = spark.createDataFrame([(1, "a " * 300, 5, "x"), (2, None, 5, "x"), (3, "", 5, "x")], SCHEMA + ", h int, k string")
        assert result(index.add(clashing)) == brute([(1, "a " * 300), (2, None), (3, "")], 35, True)
        assert index.revised().count() == 0
    finally:
        index.drop()


def test_a_copy_in_a_later_batch_takes_the_whole_of_both(spark):
    text = " ".join(f"v{i}" for i in range(50))
    index = PassageIndex(spark, "copied", buckets=2)
    try:
        index.add(spark.createDataFrame([(1, text)], SCHEMA))
        assert [r.n_removed for r in index.add(spark.createDataFrame([(1, text)] * 300, SCHEMA)).select("n_removed").distinct().collect()] == [50]
        assert index.result().filter("n_removed = 50").count() == 301
    finally:
        index.drop()
