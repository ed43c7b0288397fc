import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bytetext as bt
from tidemark.llm import token_files as tf
from tidemark.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 50_256), st.integers(0, 2**64 - 1)), max_size=1500))
def test_words_round_trip_whole_and_by_block(ids):
    ids = np.array(ids, np.uint64)
    words, blocks = tf.encode(ids)
    assert tf.decode(words).tolist() == ids.tolist()
    edges = [*blocks.tolist(), len(words)]
    for i in range(len(blocks)):
        assert tf.decode(words[edges[i] : edges[i + 1]]).tolist() == ids[i * tf.BLOCK : (i + 1) * tf.BLOCK].tolist()


def test_escapes_and_density():
    big = np.array([2**64 - 1, 2**60 - 1, 2**60 - 2, 0, 2**64 - 1, 2**64 - 1], np.uint64)
    assert tf.decode(tf.encode(big)[0]).tolist() == big.tolist()
    assert len(tf.encode(np.zeros(512, np.uint64))[0]) < 20
    assert len(tf.encode(np.full(400, 30_000, np.uint64))[0]) == 100


def test_encoder_equals_the_library():
    rng = random.Random(2)
    own, lib = tf.Encoder(vocabulary()), tokenizers.Tokenizer.from_file(vocabulary())
    alphabet = "ab  \n\t\x00\x1c é  'sx1.<|>\xa0　à"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(14))) for _ in range(4000)]
    texts += ["", " ", "<|endoftext|> a", "a <|endoftext|>", "It's  a\n\n  test   ", "x" * 5000, " y" * 3000]
    want = [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]
    for s in bt.slices(pa.array(texts), 3000):
        ids, counts = own.slice(s)
        ends = np.cumsum(counts)
        got = [ids[e - c : e].tolist() for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
        assert got == want[s.first : s.first + s.count]


def test_encoder_stays_within_its_bound(monkeypatch):
    monkeypatch.setattr(tf, "REMEMBERED", 500)
    monkeypatch.setattr(tf, "REMEMBERED_IDS", 1500)
    own, lib = tf.Encoder(vocabulary()), tokenizers.Tokenizer.from_file(vocabulary())
    rng = random.Random(7)
    for _ in range(40):
        texts = [" ".join("".join(rng.choices("abcdeé \n", k=rng.randrange(1, 12))) for _ in range(rng.randrange(90))) for _ in range(20)]
        for s in bt.slices(pa.array(texts), 4000):
            ids, counts = own.slice(s)
            assert ids.tolist() == [x for t in texts[s.first : s.first + s.count] for x in lib.encode(t, add_special_tokens=False).ids]
            assert own.count <= 500 and own.used <= 1500 and (own.keys != 0).sum() == own.count
    assert len(own.keys) + len(own.entry) == 2 * own.SLOTS and len(own.ids) == 1500


def test_pieces_joined_with_white_space_before_them():
    own, lib = tf.Encoder(vocabulary()), tokenizers.Tokenizer.from_file(vocabulary())
    texts = ["foo\n bar", "x \ny", "a \n b\n \nc", " \n", "q\n", "<|endoftext|> <|endoftext|>", "m <|endoftext|>\n n"] * 2 + ["foo\n" + " \nbar " * 50]
    for s in bt.slices(pa.array(texts)):
        ids, _ = own.slice(s)
        assert ids.tolist() == [x for t in texts for x in lib.encode(t, add_special_tokens=False).ids]


def test_pieces_are_cut_behind_letters_and_before_line_feeds():
    own, lib = tf.Encoder(vocabulary()), tokenizers.Tokenizer.from_file(vocabulary())
    words = ["alpha", "Beta", "l'été", "it's", "we'RE", "x1y", "<|endoftext|>", "pipe|s", "é"]
    texts = [f"{a}{e}{b}{f}" for a in words for e in (", ", ".\n", "-", "'", "'s", "\n\n", "\n \n", "\t", ".", "\r\n", "|", "|>", "<|") for b in words for f in ("", ".", "\n")]
    for s in bt.slices(pa.array(texts), 3000):
        ids, counts = own.slice(s)
        want = [lib.encode(t, add_special_tokens=False).ids for t in texts[s.first : s.first + s.count]]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x]
    # a word is remembered once, whatever follows it
    own = tf.Encoder(vocabulary())
    for s in bt.slices(pa.array([" ".join(f" word{e}\nword" for e in (",", ".", ";", ":", "!", "?", "-", ")"))])):
        own.slice(s)
    assert own.count <= 12


def test_tasks_of_a_worker_share_an_encoder(spark):
    def run(batches):
        for batch in batches:
            encoder = tf.kept_encoder(vocabulary())
            for s in bt.slices(batch.column(0)):
                encoder.slice(s)
            yield pa.RecordBatch.from_arrays([pa.array([encoder.count])], names=["n"])

    counts = [spark.createDataFrame([(" one two",)], "text string").coalesce(1).mapInArrow(run, "n long").first().n for _ in range(3)]
    assert min(counts) >= 2 and tf.kept_encoder(vocabulary()) is tf.kept_encoder(vocabulary())


def test_a_long_text(spark):
    text = " ".join(f"w{i % 5000}" for i in range(300_000))
    got = tf.token_files(spark.createDataFrame([(1, text), (0, "a")], "doc_id long, text string"), vocabulary())
    assert len(text) > 1_000_000 and sorted(map(tuple, got.collect())) == brute([(1, text), (0, "a")])


def brute(docs):
    lib = tokenizers.Tokenizer.from_file(vocabulary())
    start, out = 0, []
    for d, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tf, "CHUNK_IDS", 50)
    rng = random.Random(4)
    docs = [(rng.randrange(10**6), " ".join(rng.choices(["abc", "Thé", "of,", "  z"], k=rng.randrange(40)))) for _ in range(300)]
    docs = list(dict(docs).items()) + [(-5, None), (-4, ""), (None, "null id"), (10**7, "long " * 4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in tf.token_files(df, vocabulary()).collect()), key=lambda r: r[1])
    assert got == brute(docs)


def test_repeats_empty_table_and_extra_columns(spark):
    schema = "doc_id long, text string, shard string, ids int"
    assert tf.token_files(spark.createDataFrame([], schema), vocabulary()).count() == 0
    rows = tf.token_files(spark.createDataFrame([(1, "a", "x", 1), (1, "a", "x", 1), (1, "b c", "x", 2)], schema), vocabulary()).collect()
    assert sorted(r.start for r in rows)[0] == 0 and len(rows) == 3 and sum(r.n_tokens for r in rows) == 7
