import re

import pytest

import corpus_pipeline
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard_join import brute as grouped
from tests.llm.test_token_files import brute as tokens
from tidemark.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, scratch = docs.columns, Scratch(spark, "test")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = [tuple(r) for r in docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.keep(str(i), stage(spark, docs, SF))
        rows = [tuple(r) for r in docs.collect()]
        if i < 4:
            assert docs.columns == names and set(rows) <= set(before)
        if i == 0:
            assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) >= 20 for r in rows) and len(rows) > 0.6 * len(before)
        if i == 1:
            want = {c for _, _, c in grouped([(r[0], r[1]) for r in before])}
            assert sorted(r[0] for r in rows) == sorted(want)
        if i == 2:
            hit = {d for d, *_, bad in contaminated([(r[0], r[1]) for r in before], bench) if bad}
            assert sorted(rows) == sorted(r for r in before if r[0] not in hit)
        if i == 3:
            assert all(rows.count(r) <= 2 for r in set(rows))
            words = sum(len(r[1].split()) for r in rows)
            assert abs(words / sum(len(r[1].split()) for r in before) - 1.5) < 0.05
        if i == 4:
            assert sorted(rows, key=lambda r: r[1]) == tokens([(r[0], r[1]) for r in before])
        before = rows


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0)]])
def test_stages_on_empty_and_null_rows(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, k string"
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, spark.createDataFrame([(*r, "x", "y") for r in rows], schema), SF).collect()
