"""Texts of more than a megabyte, which are worked on alone and in strides."""

import random

import pytest

from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_repeats import brute as repeated
from tests.llm.test_repeats import result
from tidemark.llm import decontaminate, jaccard_join, language, mixing, secrets, toxicity
from tidemark.llm.lsm_dedup import remove_repeated_passages
from tidemark.llm.suffix_dedup import remove_repeated_substrings

SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    words = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(3000)]
    long_text = " ".join(rng.choices(words, k=230_000))
    passage = " ".join(rng.choices(words, k=60))
    edited = long_text[:700_000] + " changed " + long_text[700_000:]
    return [(1, long_text + " " + passage), (2, edited), (3, passage), (4, "x" * 1_100_000), (5, None), (6, "")]


@pytest.fixture(scope="module")
def df(spark, texts):
    assert all(len(t) > 1_000_000 for t in (texts[0][1], texts[1][1], texts[3][1]))
    return spark.createDataFrame([(d, t, "en", "s") for d, t in texts], SCHEMA).repartition(3)


def test_repeats(df, texts):
    assert result(remove_repeated_substrings(df)) == repeated(texts, 200, False)
    assert result(remove_repeated_passages(df)) == repeated(texts, 35, True)


def test_near_duplicates(df):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()}
    assert {d: c for d, (_, c) in found.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    assert found[1][0] > 200_000 and found[4][0] == 1


def test_contamination(spark, df, texts):
    items = [(9, texts[2][1]), (8, "w1 w2 w3")]
    out = decontaminate.digest(decontaminate.find_contamination(df, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]))
    assert sorted(map(tuple, out.collect()), key=str) == contaminated(texts, items)


def test_secrets(spark):
    text = "word " * 250_000 + "token=abcdefgh12345 " + "f" * 40
    row = secrets.digest(secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"])).first()
    assert (row.n_assign, row.n_access, row.n_hex) == (1, 0, 1) and f"assign:{5 * 250_000}:{5 * 250_000 + 19}" in row.spans


def test_classifiers_and_mixing(spark, df, texts):
    filters = language.fit(df)
    assert {r.row.doc_id: r.lang_pred for r in language.identify(df, filters, ["doc_id"]).collect()} == {1: "en", 2: "en", 3: "en", 4: "en", 5: "und", 6: "und"}
    scored = toxicity.score_toxicity(df, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), ["doc_id"]).collect()
    assert len(scored) == 6 and all(0 <= r.score <= 1 for r in scored)
    sizes = {r.row.doc_id: r["size"] for r in mixing.sample(df, ["doc_id"]).collect()}
    assert sizes == {d: len((t or "").split()) for d, t in texts}
