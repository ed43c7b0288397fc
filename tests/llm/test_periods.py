import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import periods


def brute(words, exponent=4, least=6):
    """(start, length, period) of all runs, by walking along every period."""
    n, out = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in out.items())


def collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(rng, n, letters):
    w = [rng.choice(letters) for _ in range(n)]
    if n and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 4))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("exponent, least", [(4, 6), (2, 2), (3, 5)])
def test_runs_of_words(exponent, least):
    rng = random.Random(exponent)
    for _ in range(500):
        docs = [periodic(rng, rng.choice([0, 1, 3, 6, 7, 12, 30, 60]), range(rng.choice([1, 2, 2, 3, 6]))) for _ in range(rng.randint(1, 4))]
        at = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        lo, hi, q = periods.runs_of(np.array(sum(docs, []), np.int64), at, exponent, least)
        want = [(a + at[i], n, p) for i, d in enumerate(docs) for a, n, p in brute(d, exponent, least)]
        assert list(zip(lo.tolist(), (hi - lo).tolist(), q.tolist(), strict=True)) == want


def test_texts(spark, monkeypatch):
    monkeypatch.setattr(periods, "BLOCK", 64)
    rng = random.Random(9)
    texts = [None, "", " \n\t", "a " * 6, "a " * 5, "é\x00 " * 9 + "x", "ab ab ab ab"]
    texts += ["".join(w + rng.choice([" ", "\n", "\x0b \t"]) for w in periodic(rng, rng.randint(1, 200), ["a", "bb", "ü", "日本", "a."])) for _ in range(60)]
    rows = [(i % 50, t) for i, t in enumerate(texts)]  # some doc_ids come twice
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("x")).withColumn("row", F.lit(1))
    got = sorted(((r.row.doc_id, r.row.text or "", r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.find_runs(docs, docs.columns).collect()), key=str)
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want.append((i, t or "", len(words), brute(words), collapsed(words, brute(words))))
    assert got == sorted(want, key=str)
    assert periods.find_runs(docs.limit(0), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        periods.find_runs(docs, ["doc_id"], exponent=1)


def test_long_texts(spark):
    rng = random.Random(3)
    plain = [f"w{rng.randrange(50_000)}" for _ in range(150_000)]
    part = [f"w{rng.randrange(50_000)}" for _ in range(700)]
    texts = [" ".join(plain), "same " * 250_000, " ".join(plain[:1000] + part * 150 + plain[1000:2000])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: (r.n_words, [tuple(x) for x in r.runs], len(r.collapsed.split())) for r in periods.find_runs(docs, ["doc_id"]).collect()}
    assert got[0] == (150_000, [], 150_000) and got[1] == (250_000, [(0, 250_000, 1)], 1)
    assert got[2] == (107_000, [(1000, 105_000, 700)], 2700)


def test_longest(spark):
    runs = [(3, 8, 2), (1, 12, 3), (9, 13, 3), (20, 39, 9)]
    df = spark.createDataFrame([(runs,), ([],)], "runs array<struct<start:long,length:long,period:long>>")
    got = [r[0] for r in df.select(periods.longest("runs")).collect()]
    assert (got[0].start, got[0].length, got[0].period) == (9, 13, 3) and got[1] is None
