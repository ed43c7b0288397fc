import random

import pytest

from tidemark.llm.mixing import WEIGHTS, sample, source_targets

SCHEMA = "doc_id long, text string, source string"


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, done = 1.5 * sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in done]
        if not left:
            return done
        x = (total - sum(done.values())) / sum(weight[s] for s in left)
        over = [s for s in left if x * weight[s] > 2 * sizes[s]]
        if not over:
            return done | {s: x * weight[s] for s in left}
        done |= {s: 2.0 * sizes[s] for s in over}


def corpus(n, sources):
    rng = random.Random(n)
    return [(i, None if i % 50 == 7 else " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("sources", [["a"], ["b", "Z", "é", None, "a", "", "c"], [f"s{i}" for i in range(20)] + ["hot"] * 10])
def test_targets_and_taken(spark, sources):
    docs = corpus(3000, sources)
    docs += [docs[0], (None, "a b c", sources[0]), (5, "other", sources[-1])]
    out = sample(spark.createDataFrame(docs, SCHEMA), ["doc_id", "source"]).collect()
    assert len(out) == len(docs)
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = brute_targets(sizes)
    taken = {}
    for r in out:
        s = r.row["source"]
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s]
        assert r.taken == r.copies * r.size and r.copies <= 2
        taken[s] = taken.get(s, 0) + r.taken
    for s, words in taken.items():
        assert abs(words - want[s]) <= 100, s  # half of the longest document


def test_reruns_and_partitioning_agree(spark):
    df = spark.createDataFrame(corpus(500, ["a", "b"]), SCHEMA)
    first = sorted(map(tuple, sample(df, ["doc_id"]).select("row.doc_id", "taken").collect()), key=str)
    again = sorted(map(tuple, sample(df.repartition(7), ["doc_id"]).select("row.doc_id", "taken").collect()), key=str)
    assert first == again


def test_buckets_do_not_change_the_sizes(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.mixing.BUCKET_ROWS", 20)
    docs = corpus(2000, ["a", "b", "c"])
    out = sample(spark.createDataFrame(docs, SCHEMA), ["source"]).selectExpr("row.source as s", "taken", "target").groupBy("s").agg({"taken": "sum", "target": "max"}).collect()
    for r in out:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 200


def test_documents_of_a_length_are_taken_as_often_as_their_probability_says(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(["w"] * rng.choice([1, 2, 5, 11, 24, 50])), "a" if i % 3 else "b") for i in range(6000)]
    df = spark.createDataFrame(docs, SCHEMA).cache()
    seeds, taken, p, sure = 4, {}, {}, {}
    for seed in range(seeds):
        for r in sample(df, ["doc_id", "source"], seed=seed).collect():
            key = (r.row["source"], r.size)
            taken[key] = taken.get(key, 0) + r.copies
            p.setdefault(key, set()).add(round(r.p, 9))
            sure[key] = sure.get(key, 0) + (r.copies >= 1)
    n = {}
    for i, text, source in docs:
        n[source, len(text.split())] = n.get((source, len(text.split())), 0) + 1
    assert all(len(x) == 1 for x in p.values()) and len({x for k, s in p.items() for x in s if k[0] == "a"}) >= 5
    for key, times in taken.items():
        chance = next(iter(p[key]))
        whole = 1 if sure[key] == n[key] * seeds else 0
        trials = n[key] * seeds
        deviation = (trials * chance * (1 - chance)) ** 0.5
        # the end of a source is filled with what fits, some short documents a source
        assert abs(times - trials * (whole + chance)) <= 4 * deviation + 20 * seeds, (key, times / trials, whole + chance)
    df.unpersist()


def test_expected_words_are_the_target(spark):
    docs = corpus(3000, ["a", "b", "c", "d"])
    rows = sample(spark.createDataFrame(docs, SCHEMA), ["source"], emphasis=0.5).collect()
    for s in "abcd":
        mine = [r for r in rows if r.row["source"] == s]
        least = {r.size: min(x.copies for x in mine if x.size == r.size) for r in mine}
        rates = {r.size: (least[r.size] if r.p > 0 or least[r.size] == 2 else r.copies) + r.p for r in mine}
        assert sum(rates[r.size] * r.size for r in mine) == pytest.approx(mine[0].target, rel=0.02)
        sizes = sorted(rates)
        assert all(rates[x] <= rates[y] + 1e-9 for x, y in zip(sizes[1:], sizes[2:], strict=False))


def test_empty_and_clashing_columns(spark):
    assert sample(spark.createDataFrame([], SCHEMA), ["doc_id"]).count() == 0
    assert source_targets(spark.createDataFrame([], "source string, size long")).count() == 0
    df = spark.createDataFrame([(1, "a b", "s", "x", 3)], SCHEMA + ", size string, rank int")
    assert sample(df, df.columns).select("row.*").collect() == df.collect()
    empty = spark.createDataFrame([(1, None, "s"), (2, "", "s")], SCHEMA)
    assert {r.taken for r in sample(empty, ["doc_id"]).collect()} == {0}


def test_a_document_longer_than_its_bucket_does_not_leave_a_gap(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.mixing.BUCKET_ROWS", 10)
    rng = random.Random(2)
    docs = [(i, " ".join(["w"] * (600 if i % 40 == 0 else rng.randrange(1, 9))), "a" if i % 3 else "b") for i in range(2000)]
    out = sample(spark.createDataFrame(docs, SCHEMA), ["source"]).selectExpr("row.source as s", "taken", "target").groupBy("s").agg({"taken": "sum", "target": "max"}).collect()
    for r in out:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 8


def test_some_of_many_equal_rows_are_taken(spark):
    docs = [(1, "a b c d", "x")] * 900 + [(2, "e f", "y")] * 901
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    out = sample(df, ["source"]).selectExpr("row.source as s", "taken", "target", "copies").collect()
    assert len(out) == len(docs)
    for s in "xy":
        mine = [r for r in out if r.s == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2 and {r.copies for r in mine} <= {0, 1, 2}
