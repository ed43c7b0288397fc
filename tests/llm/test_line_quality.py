import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa

from tidemark.llm import bytetext as bt
from tidemark.llm import line_quality as lq
from tidemark.llm.queries import documents, labels, queries

SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = [False] * len(w)
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            marked[i : i + 8] = [True] * 8
    n, repeated = len(w), sum(marked)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, repeated, n < 20 or 100 * repeated > 30 * n


def test_counts_against_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "bé", "#x|", "C d", "e\x1cf", "*"]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", "\n", "\t", "\r\n", "\n\n"]) for _ in range(rng.choice([0, 5, 30, 80])))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "\n\n \n"), (203, "one two three four five six seven eight " * 6), (5, docs[5][1]), (204, "x" * 100_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = lq.rate_quality(df, lq.DEFAULT, ["doc_id"]).collect()
    got = sorted((r.row.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rows)
    assert got == sorted((d, brute(t)) for d, t in docs)
    assert all(not (r.base_failed and r.kept) for r in rows)
    assert lq.rate_quality(df, lq.DEFAULT, ["doc_id"], only_kept=True).count() == sum(r.kept for r in rows)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(50):
        field = lq.Field(np.zeros((1, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
        e = rng.normal(size=(rng.integers(1, 7), 2))

        def score(path, field=field, e=e):
            return field.first[path[0]] + sum(e[i, x] for i, x in enumerate(path)) + sum(field.step[x, y] for x, y in zip(path, path[1:], strict=False))

        assert score(field.viterbi(e)) == max(map(score, product((0, 1), repeat=len(e))))


def test_fit_separates_labelled_sequences():
    rng = np.random.default_rng(1)
    x = [np.column_stack([np.ones(n), rng.random(n) < (0.9 if y else 0.1)]).astype(float) for y, n in zip([0, 1] * 40, rng.integers(1, 9, 80), strict=True)]
    field = lq.fit(x, [0, 1] * 40)
    right = [np.mean(np.array(field.viterbi(s @ field.emit)) == y) for s, y in zip(x, [0, 1] * 40, strict=True)]
    assert np.mean(right) > 0.8
    assert lq.fit(x, [0] * 80) is lq.DEFAULT


def test_labelled_documents(spark):
    rated = {r.doc_id: r for r in queries()["op2_quality_rules"](spark, SF).collect()}
    known = labels(spark, SF).filter("quality = 1").collect()
    fine = [rated[r.doc_id] for r in known if not rated[r.doc_id].base_failed]
    assert all(r.kept for r in fine) and len(fine) > 20
    assert lq.learn(documents(spark, SF), labels(spark, SF).limit(0)) is lq.DEFAULT


def test_lines_and_empty_slices():
    for texts in ([], [""], [None, "a\nb"], ["a\n", "\na", "a"]):
        for s in bt.slices(pa.array(texts, pa.string())):
            counts, lines = lq.measure(s)
            assert counts.n_words.tolist() == [len((t or "").split()) for t in texts[s.first : s.first + s.count]]
            assert lines.words.sum() == counts.n_words.sum() and lines.features.shape[1] == len(lq.FEATURES)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, n_words int, row string")
    assert lq.rate_quality(df, lq.DEFAULT, df.columns).select("row.*").collect() == df.collect()
    assert lq.rate_quality(df.limit(0), lq.DEFAULT, ["doc_id"]).count() == 0


def good_texts(n, rng):
    words = [f"word{i}" for i in range(400)]
    line = lambda: " ".join(rng.choices(words, k=rng.randrange(8, 22))).capitalize() + "."
    return ["\n".join(line() for _ in range(rng.randrange(3, 9))) for _ in range(n)]


def junk_line(rng):
    return rng.choice([" | ".join(f"Link{rng.randrange(50)}" for _ in range(9)), "!! ".join(f"BUY{rng.randrange(50)}" for _ in range(9)) + "!!", "### ".join(f"x{rng.randrange(99)}" for _ in range(9))])


def test_footers_alone_are_marked_and_good_documents_kept(spark):
    rng = random.Random(11)
    good, rows, known = good_texts(600, rng), [], []
    for i, text in enumerate(good):
        if i % 2:  # junk, under a line or two that look like content
            text = "\n".join([*text.split("\n")[:2], *(junk_line(rng) for _ in range(6))])
        rows.append((i, text))
        if i < 400:
            known.append((i, 1 - i % 2))
    footed = {i: good[i] + "\n" + junk_line(rng) for i in range(400, 600, 2)}
    docs = spark.createDataFrame([(i, footed.get(i, t)) for i, t in rows], "doc_id long, text string")
    field = lq.learn(docs, spark.createDataFrame(known, "doc_id long, quality int"))
    rated = {r.row.doc_id: r for r in lq.rate_quality(docs, field, ["doc_id"]).collect()}
    alone = sum(rated[i].boilerplate == [t.count("\n")] for i, t in footed.items())
    assert alone >= 0.95 * len(footed)
    assert all(rated[i].kept for i in footed) and not any(rated[i].kept for i in range(401, 600, 2))
    # in documents of junk the first lines are content all the same
    assert sum(rated[i].boilerplate == list(range(2, 8)) for i in range(401, 600, 2)) >= 80


def test_labels_not_fitted_on(spark):
    docs, known = documents(spark, "/root/testdata/sf0.1"), labels(spark, "/root/testdata/sf0.1").select("doc_id", "quality").dropDuplicates(["doc_id"])
    half = known.selectExpr("*", "crc32(cast(doc_id as string)) % 2 as part")
    rated = lq.rate_quality(docs, lq.learn(docs, half.filter("part = 0")), ["doc_id"]).select("row.doc_id", "base_failed", "kept", "boilerplate", "n_words")
    rows = rated.join(half.filter("part = 1 and quality is not null"), "doc_id").filter("not base_failed").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert len(good) > 1000 and sum(r.kept for r in good) >= 0.99 * len(good)
    assert len(bad) > 50 and sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_a_long_text(spark):
    line = "The quick brown fox jumps over the lazy dog and goes on to the river bank.\n"
    text = "".join(f"{i} {line}" for i in range(14_000))
    row = lq.rate_quality(spark.createDataFrame([(1, text)], "doc_id long, text string"), lq.DEFAULT, ["doc_id"]).first()
    assert len(text) > 1_000_000 and (row.n_words, row.n_dup_lines) == (len(text.split()), 0)
