"""Whole columns of text as one array of UTF-8 bytes: word spans, hashes and windows without a Python object per word.

Every function works on a slice of documents (``Slice``): the bytes of all its texts one after another and the
offsets at which each begins. A null text is an empty one. Documents never share a word or a window.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes or symbols hashed at a time: sums and powers of this many are in memory, however long a text is.
STRIDE = 1 << 17

_rng = np.random.default_rng(20240229)
_CODES = _rng.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _run_of(base: int) -> np.ndarray:
    """Powers of a base modulo 2**64, as many as a stride needs."""
    out = np.full(STRIDE + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = [_run_of(b) for b in _BASES]
_INVERSE = [_run_of(pow(b, -1, 2**64)) for b in _BASES]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words between white space.
NOT_SPACE = ~SPACE
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes of digits, ASCII letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Slice:
    first: int  # row of the batch that the slice begins with
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than documents

    @property
    def count(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a batch's text column between documents."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Slice(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def codes(symbols: np.ndarray, which: int = 0) -> np.ndarray:
    """Bytes as 64-bit symbols; other symbols as they are."""
    return _CODES[which][symbols] if symbols.dtype == np.uint8 else symbols


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of spans, equal for equal content at any place. Neither starts nor ends may go back."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + STRIDE, "right"))
        if j <= i:  # a span of more than a stride
            out[i] = _long_hash(symbols, lo, int(ends[i]), which)
            i += 1
            continue
        part = codes(symbols[lo : int(ends[j - 1])], which)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _POWERS[which][: len(part)], out=sums[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[b] - sums[a]) * _INVERSE[which][a] + (b - a).astype(np.uint64))
        i = j
    return out


def _long_hash(symbols: np.ndarray, lo: int, hi: int, which: int) -> np.uint64:
    total = 0
    for at in range(lo, hi, STRIDE):
        part = codes(symbols[at : min(at + STRIDE, hi)], which)
        total += int((part * _POWERS[which][: len(part)]).sum()) * pow(_BASES[which], at - lo, 2**64)
    return mix(np.array([(total + hi - lo) % 2**64], np.uint64))[0]


def word_spans(s: Slice, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in s.data, and per document the number of words before it (one more entry than documents)."""
    inside = is_word[s.data]
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(s.count + 1, np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = s.offsets[(s.offsets > 0) & (s.offsets < n)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, s.offsets)


def word_hashes(s: Slice, starts: np.ndarray, ends: np.ndarray, lower: bool = False, which: int = 0) -> np.ndarray:
    return span_hashes(LOWER[s.data] if lower else s.data, starts, ends, which)


def grams(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k symbols (document limits not heeded)."""
    at = np.arange(max(len(symbols) - k + 1, 0))
    return span_hashes(symbols, at, at + k)


def tally(member: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many members each range has."""
    sums = np.zeros(len(member) + 1, np.int32)
    np.cumsum(member, out=sums[1:])
    return (sums[ends] - sums[starts]).astype(np.int64)


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w values, by doubling."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every pair, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - shift, lengths)


def union_ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open ranges joined where they overlap or touch, in order."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    first = np.flatnonzero(new)
    return lo[first], hi[np.concatenate([first[1:], [len(lo)]]) - 1]


def release() -> None:
    """Give memory that Arrow and the C library hold for later back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
