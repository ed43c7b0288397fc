import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import repeats
from tidemark.llm.lsm_dedup import FingerprintIndex, _merged, remove_repeated_passages
from tidemark.llm.suffix_dedup import BlindTrie, deep_shallow, multikey_quicksort, remove_repeated_substrings

SCHEMA = "doc_id long, text string"


def brute(docs, width, word):
    seqs = [(t or "").encode().split() if word else (t or "").encode() for _, t in docs]
    key = (lambda s, i: tuple(s[i : i + width])) if word else (lambda s, i: s[i : i + width])
    seen = Counter(key(s, i) for s in seqs for i in range(len(s) - width + 1))
    out = []
    for (d, _), s in zip(docs, seqs, strict=True):
        gone = [False] * len(s)
        for i in range(len(s) - width + 1):
            if seen[key(s, i)] > 1:
                gone[i : i + width] = [True] * width
        kept = [u for u, x in zip(s, gone, strict=True) if not x]
        runs = sum(x and not (i and gone[i - 1]) for i, x in enumerate(gone))
        out.append((d, len(s), sum(gone), runs, hashlib.sha256(b" ".join(kept) if word else bytes(kept)).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_units", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()), key=str)


def corpus():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)] + ["é", "ññ"]
    passages = [" ".join(rng.choices(words, k=60)) for _ in range(3)]
    docs = []
    for i in range(60):
        text = " ".join(rng.choices(words, k=rng.choice([0, 3, 40, 100, 200])))
        if i % 3 == 0:
            text += " " + passages[i % 7 % 3] + "  \t" + " ".join(rng.choices(words, k=30))
        docs.append((i, passages[0] if i % 10 == 0 else text))
    # null and empty texts, a repeated row, periodic texts, a null id, one id with two texts
    return docs + [(80, None), (81, ""), (5, docs[5][1]), (82, "ab " * 400), (83, "x" * 900), (None, passages[1]), (7, docs[8][1])]


@pytest.mark.parametrize("group_rows", [4096, 5])
def test_substrings_and_passages_against_brute_force(spark, monkeypatch, group_rows):
    monkeypatch.setattr(repeats, "GROUP_ROWS", group_rows)
    docs = corpus()
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    assert result(remove_repeated_substrings(df)) == brute(docs, 200, False)
    assert result(remove_repeated_substrings(df, 60, 20)) == brute(docs, 60, False)
    assert result(remove_repeated_passages(df, batches=3, buckets=4, fanout=2)) == brute(docs, 35, True)


def test_long_document_in_strides(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STRIDE", 100)
    docs = corpus()[:40]
    df = spark.createDataFrame(docs, SCHEMA)
    assert result(remove_repeated_substrings(df)) == brute(docs, 200, False)


def test_empty_table_and_clashing_columns(spark):
    for f in (remove_repeated_substrings, remove_repeated_passages):
        assert f(spark.createDataFrame([], SCHEMA)).count() == 0
        rows = spark.createDataFrame([(1, "a " * 300, 0, "x", 1), (2, "b", 0, "x", 1)], SCHEMA + ", h int, kept string, k int")
        assert f(rows).count() == 2


def test_compaction_keeps_rows_and_finds_old_hits(spark):
    index = FingerprintIndex(spark, "kept_index", buckets=2, fanout=2)
    hits = []
    for b in range(4):
        batch = spark.createDataFrame([(10 * b + i, 0, [7, 100 + b, 200 + b][i], 0, 0, 0) for i in range(3)], repeats.ANCHORS)
        hits.append({r.h for r in index.add(batch).collect()})
        index.compact()
    assert hits == [set(), {7}, {7}, {7}]
    assert [level for level, _ in index.runs] == [2]
    # found again by name
    again = FingerprintIndex(spark, "kept_index", buckets=2, fanout=2)
    assert again.runs == index.runs and sorted(again.anchors) == sorted(index.anchors)
    seven = spark.createDataFrame([(7,)], "h long")
    assert again.all_anchors().count() == 12 and {r.k for r in again.where(seven).collect()} == {0, 10, 20, 30}
    assert sum(r.m for r in again.counts(seven).collect()) == 4
    again.drop()
    assert not spark.sql("SHOW TABLES LIKE 'kept_index*'").collect()


def test_runs_merge_without_a_shuffle(spark):
    index = FingerprintIndex(spark, buckets=3, fanout=2)
    for b in range(2):
        index.add(spark.createDataFrame([(b, 0, h, 0, 0, 0) for h in range(20)], repeats.ANCHORS))
    a, b = (spark.table(t) for _, t in index.runs)
    hits = index.add(spark.createDataFrame([(9, 0, 5, 0, 0, 0)], repeats.ANCHORS))
    assert [r.h for r in hits.collect()] == [5, 5]
    assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()
    merged = _merged(a, b)
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
    index.compact()
    assert sorted(map(tuple, spark.table(index.runs[0][1]).collect())) == [(h, 2 + (h == 5)) for h in range(20)] and len(index.runs) == 1
    index.drop()


def test_many_equal_rows_and_rows_without_id(spark):
    long_text = " ".join(f"w{i}" for i in range(300))
    docs = [(None, long_text), (None, "x" * 19)] + [(3, long_text + " y")] * 500 + [(None, None)] * 3
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    assert result(remove_repeated_substrings(df)) == brute(docs, 200, False)
    assert result(remove_repeated_passages(df)) == brute(docs, 35, True)


def test_work_is_linear_in_equal_rows(spark):
    unit = repeats.Unit(False, 200, 50)
    text = " ".join(f"v{i}" for i in range(300))
    counts = []
    for n in (50, 200):
        docs = repeats.keyed(spark.createDataFrame([(1, text)] * n, SCHEMA).repartition(3))
        found = repeats.anchors(docs, unit)
        often = found.groupBy("h").agg(F.count("*").alias("m"))
        counts.append(repeats.segments(docs, repeats.salted(found.join(often, "h")), unit).count())
    assert counts[1] <= 4 * counts[0] and counts[0] < 50 * 30


def test_rows_are_told_apart_though_the_hash_of_their_text_is_one(spark):
    # a pair of texts with one value of F.hash, found among generated ones
    df = spark.range(300_000).selectExpr("concat('text ', id) as text").withColumn("x", F.hash("text"))
    pairs = df.groupBy("x").agg(F.collect_list("text").alias("t")).filter("size(t) > 1").orderBy("x").first()
    assert pairs is not None
    a, b = pairs.t[:2]
    keys = repeats.keyed(spark.createDataFrame([(None, a), (None, b)], SCHEMA)).select("k", "th").collect()
    assert keys[0].k != keys[1].k and keys[0].th != keys[1].th


def test_sorting_orders_suffixes():
    rng = np.random.default_rng(3)
    buf = bytes(rng.integers(97, 99, 400, dtype=np.uint8)) + b"a" * 200 + bytes(range(256)) + b"a" * 200
    pos = rng.integers(0, len(buf) - 100, 300)
    for n in (1, 7, 20, 33, 100):
        length, group = np.full(300, n), rng.integers(0, 3, 300)
        order, _ = multikey_quicksort(buf, pos, length, group, 4096)
        keys = [(group[i], buf[pos[i] : pos[i] + n]) for i in order]
        assert keys == sorted(keys)
        classes = deep_shallow(buf, pos, length, group)
        want = {k: i for i, k in enumerate(sorted({(g, buf[p : p + n]) for g, p in zip(group, pos, strict=True)}))}
        assert [want[g, buf[p : p + n]] for g, p in zip(group, pos, strict=True)] == classes.tolist()


def test_blind_trie_is_sorted_and_groups_equals():
    texts = [b"abc", b"ab", b"abd", b"b", b"abc", b"", b"abcabc"]
    trie = BlindTrie()
    for i, t in enumerate(texts):
        trie.add(t, i)
    assert [[texts[i] for i in leaf] for leaf in trie.leaves()] == [[b""], [b"ab"], [b"abc", b"abc"], [b"abcabc"], [b"abd"], [b"b"]]


def test_indexes_of_like_names_and_broken_additions(spark):
    rows = lambda *hs: spark.createDataFrame([(h, 1, h, 0, 1, 0) for h in hs], repeats.ANCHORS)
    long, short = FingerprintIndex(spark, "Fp_New", buckets=2), FingerprintIndex(spark, "fp", buckets=2)
    try:
        long.add(rows(1, 2))
        short.add(rows(7))
        short._write_run = lambda *a: (_ for _ in ()).throw(OSError("the disk is full"))
        with pytest.raises(OSError):
            short.add(rows(8, 9))
        again = FingerprintIndex(spark, "FP", buckets=2)
        assert again.all_anchors().count() == 1 and len(again.runs) == 1
        assert sorted(r.h for r in again.add(rows(7, 8)).collect()) == [7] and again.all_anchors().count() == 3
        assert FingerprintIndex(spark, "fp_new").all_anchors().count() == 2
        with pytest.raises(ValueError):
            FingerprintIndex(spark, "a b")
    finally:
        for x in (FingerprintIndex(spark, "fp"), long):
            x.drop()
    assert not spark.sql("SHOW TABLES LIKE 'fp*'").collect()
