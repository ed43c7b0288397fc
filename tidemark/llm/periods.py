"""Periodic runs: stretches of words that repeat a shorter one over and over, by Karp-Miller-Rosenberg naming.

Words get numbers, equal for equal words of a document. Level k names all stretches of 2**k words: a pair of level k - 1
names, ranked. A stretch found once in its document can be part of no repeat, so only those found again are ranked at
the next level, and in ordinary text the levels end soon. The longest common extension of two places is read off
by going down the levels, in either direction. A run of period q and at least e * q words holds a stretch of (e - 1) * q
places that equal the place q further on, so one place in (e - 1) * q is tried for every period, all of them in numpy
blocks; what passes is extended both ways. No hashes of stretches and no suffixes are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .scratch import small_batches

#: A run has at least this many periods and this many words.
EXPONENT, LEAST = 4, 6
#: Places tried at a time.
BLOCK = 1 << 19


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes: Arrow compares the words themselves."""
    sizes = ends - starts
    flat = data[bt.ragged(starts, sizes)]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _ranked(key: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Names of all n places: the rank of its key where a key is found again, and a negative number of its own elsewhere."""
    name = -1 - np.arange(n, dtype=np.int64)
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    again = times[inverse] > 1
    name[places[again]] = inverse[again]
    return name


def name_levels(numbers: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4, ... words that begin at each place; document d has the places at[d] to at[d + 1]."""
    n = len(numbers)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    end = at[1:][doc] if n else doc
    levels = [_ranked(doc * (int(numbers.max(initial=0)) + 1) + numbers, np.arange(n), n)]
    half = 1
    while True:
        below = levels[-1]
        places = np.flatnonzero(below >= 0)
        places = places[places + 2 * half <= end[places]]
        places = places[below[places + half] >= 0]
        if not len(places):
            return levels
        name = _ranked(below[places] * n + below[places + half], places, n)
        if not (name >= 0).any():
            return levels
        levels.append(name)
        half *= 2


def extensions(levels: list[np.ndarray], a: np.ndarray, q: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words from place a on equal those from a + q on, and how many before a, from ``low`` on, equal those before a + q."""
    n = len(levels[0])
    ahead, back = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name = levels[k]
        x, y = a + ahead, a + q + ahead
        same = (y < n) & (name[np.minimum(x, n - 1)] == name[np.minimum(y, n - 1)])
        ahead[same] += 1 << k
        x = a - back - (1 << k)
        same = (x >= low) & (name[np.maximum(x, 0)] == name[np.maximum(x, 0) + q])
        back[same] += 1 << k
    return ahead, back


def runs_of(numbers: np.ndarray, at: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest periods of all maximal runs, by start and then period; places count over all documents.

    A stretch with a period p also has the multiples of p; it is reported once, with the smallest.
    """
    nothing = np.zeros(0, np.int64)
    sizes = np.diff(at)
    if not (sizes >= least).any():
        return nothing, nothing, nothing
    levels = name_levels(numbers, at)
    periods = np.where(sizes >= least, sizes // exponent, 0)
    doc = np.repeat(np.arange(len(sizes)), periods)
    q = bt.ragged(np.ones(len(sizes), np.int64), periods)
    step = np.maximum(least, exponent * q) - q
    tries = np.maximum((sizes[doc] - q - 1) // step + 1, 0)
    upto = np.cumsum(tries)
    found: list[np.ndarray] = []
    first = 0
    while first < len(q):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + BLOCK, "right")))
        # one pair of document and period has at most as many places as the document has words
        pair = np.repeat(np.arange(first, last), tries[first:last])
        a = at[doc[pair]] + bt.ragged(np.zeros(last - first, np.int64), tries[first:last]) * step[pair]
        use = levels[0][a] == levels[0][a + q[pair]]
        a, pair = a[use], pair[use]
        ahead, back = extensions(levels, a, q[pair], at[doc[pair]])
        length = ahead + back + q[pair]
        use = length >= np.maximum(least, exponent * q[pair])
        start = (a - back)[use]
        found.append(np.unique(np.stack([start, start + length[use], q[pair][use]], axis=1), axis=0))
        first = last
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[keep]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    kept = np.flatnonzero(keep)
    per = bt.tally(keep, at[:-1], at[1:])
    sizes = ends[kept] - starts[kept]
    last = np.zeros(len(kept), bool)
    last[np.cumsum(per)[per > 0] - 1] = True
    room = sizes + ~last
    begin = np.cumsum(room) - room
    flat = np.full(int(room.sum()), 0x20, np.uint8)
    flat[bt.ragged(begin, sizes)] = data[bt.ragged(starts[kept], sizes)]
    offsets = np.concatenate([begin, [len(flat)]])[np.concatenate([[0], np.cumsum(per)])].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(per), pa.py_buffer(offsets), pa.py_buffer(flat)).cast(pa.string())


def find_runs(docs: DataFrame, carry: list[str], exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """row (struct of the ``carry`` columns), n_words, runs (start, length, period in words, by start and period), collapsed: one row per document.

    A run is a stretch of at least ``exponent`` (2 or more) periods and ``least`` words that no neighbouring word extends.
    ``collapsed`` is the text without what runs repeat: of every run the first period stays, words joined by one space. Words
    are runs of anything but ASCII white space, compared byte by byte. A null, empty or wordless text has no words, no runs
    and collapses to an empty one; runs of one stretch come once; repeated rows stay; an empty table gives an empty one; extra
    columns matter only if carried. Texts of any length are searched whole: 8 bytes a word and level of names, as many
    levels as the longest repeat asks for.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col("text").cast("string").alias("text"))
    kind = "array<struct<start:bigint,length:bigint,period:bigint>>"
    schema = rows.select("row", F.lit(0).cast("long").alias("n_words"), F.expr(f"cast(array() as {kind})").alias("runs"), F.lit("").alias("collapsed")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in bt.slices(batch.column(1)):
                starts, ends, at = bt.word_spans(s, bt.NOT_SPACE)
                lo, hi, q = runs_of(word_numbers(s.data, starts, ends), at, exponent, least)
                cover = np.zeros(len(starts) + 1, np.int64)
                np.add.at(cover, lo + q, 1)
                np.add.at(cover, hi, -1)
                doc = np.searchsorted(at, lo, "right") - 1
                values = pa.StructArray.from_arrays([pa.array(lo - at[doc]), pa.array(hi - lo), pa.array(q)], names=["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(s.count + 1)).astype(np.int32)), values)
                collapsed = _joined(s.data, starts, ends, at, np.cumsum(cover)[:-1] == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.count), pa.array(np.diff(at)), runs, collapsed], names=schema.names)
        bt.release()

    return rows.mapInArrow(run, schema)


def longest(runs: str = "runs"):
    """Of an array of runs the one of most periods (ties: smallest start, then period), null if there is none; exact below 2**26 words."""
    order = F.transform(runs, lambda x: F.struct((-x["length"] / x["period"]).alias("e"), x["start"].alias("start"), x["period"].alias("period"), x["length"].alias("length")))
    return F.array_min(order)
