"""The registered queries themselves, on whole small tables."""

import glob
import hashlib
import os
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tests.llm.test_conversations import account
from tests.llm.test_line_quality import brute as line_counts
from tests.llm.test_mixing import brute_targets
from tests.llm.test_periods import brute as brute_runs
from tests.llm.test_periods import collapsed
from tidemark.llm.queries import oracle_sql, queries, vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(spark, name):
    return queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, tables, name):
    got, want = queries()[name](spark, SF), tables.sql(oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def base_spans(text):
    out = []
    for i, (pattern, least, group) in enumerate([(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2), (r"AKIA[A-Z0-9]+", 16, 0), (r"[0-9a-f]+", 32, 0)]):
        out += [(m.start(), i, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
    return sorted(out)


def test_op1_base_columns(spark, docs):
    names = ("assign", "access", "hex")
    for r in rows_of(spark, "op1_secret_scan"):
        spans = base_spans(docs[r.doc_id].text or "")
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        joined = [f"{names[k]}:{a}:{b}" for a, k, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x.split(":")[0] in names] == joined


def test_op2_base_columns(spark, docs):
    for r in rows_of(spark, "op2_quality_rules"):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == line_counts(docs[r.doc_id].text)
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize("name, columns", [("op4_toxicity", {"doc_id", "held_out", "score", "predicted"}), ("op8_language_id", {"doc_id", "held_out", "lang_pred", "score"}), ("op12_quality_classifier", {"doc_id", "held_out", "score", "predicted"})])
def test_classifiers_score_every_row(spark, docs, name, columns):
    rows = rows_of(spark, name)
    assert sorted(r.doc_id for r in rows) == sorted(docs) and columns <= set(rows[0].asDict())
    for r in rows:
        assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert name == "op8_language_id" or r.predicted == (r.score >= (0.5 if name == "op4_toxicity" else 0.3))


def test_op6_targets_and_taken(spark, docs):
    sizes, longest, taken = {}, {}, {}
    count = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for d, r in docs.items()}
    for d, r in docs.items():
        sizes[r.source] = sizes.get(r.source, 0) + count[d]
        longest[r.source] = max(longest.get(r.source, 0), count[d])
    want = brute_targets(sizes)
    for r in rows_of(spark, "op6_mixing"):
        s = docs[r.doc_id].source
        assert r["size"] == count[r.doc_id] and r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 for s in sizes)


def test_op10_against_the_library(spark, docs):
    lib, start = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary()), 0
    for r in sorted(rows_of(spark, "op10_token_output"), key=lambda r: r.doc_id):
        ids = [*lib.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op11_against_brute_force(spark, docs):
    for r in rows_of(spark, "op11_periodic_runs"):
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *want)
        assert r.runs_sha256 == sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)) and r.collapsed_sha256 == sha(collapsed(words, runs))


def test_op13_against_brute_force(spark):
    per, original = {}, set()
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        original.add(r.conv_id)
        fault = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", r.text) if fault == 2 else r.text
        per.setdefault(r.conv_id, []).extend([(r.turn, "user" if fault == 4 else r.role, text)] * {0: 0, 3: 2}.get(fault, 1))
    rows = rows_of(spark, "op13_conversation_repair")
    assert sorted(r.conv_id for r in rows) == sorted(original)
    for r in rows:
        want, turns = account(per[r.conv_id])
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == want
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest()
