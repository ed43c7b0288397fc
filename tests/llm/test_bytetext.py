import random

import numpy as np
import pyarrow as pa

from tidemark.llm import bytetext as bt


def test_hashes_do_not_depend_on_strides(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 4000, 300))
    ends = np.maximum.accumulate(starts + rng.integers(1, 900, 300))
    whole = bt.span_hashes(data, starts, ends)
    monkeypatch.setattr(bt, "STRIDE", 64)
    assert (bt.span_hashes(data, starts, ends) == whole).all()
    by_content = {}
    for h, a, b in zip(whole.tolist(), starts.tolist(), ends.tolist(), strict=True):
        assert by_content.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(by_content.values())) == len(by_content)


def test_equal_words_have_equal_hashes_anywhere():
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["a", "bb", "é", "x" * 300_000], [9, 9, 9, 0.1], k=200)) for _ in range(20)] + [None, ""]
    seen = {}
    for s in bt.slices(pa.array(texts), 100_000):
        starts, ends, _ = bt.word_spans(s, bt.NOT_SPACE)
        for h, a, b in zip(bt.word_hashes(s, starts, ends).tolist(), starts.tolist(), ends.tolist(), strict=True):
            assert seen.setdefault(s.data[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_tally():
    member = np.array([1, 0, 1, 1, 0], bool)
    assert bt.tally(member, np.array([0, 2, 5]), np.array([2, 5, 5])).tolist() == [1, 2, 0]
