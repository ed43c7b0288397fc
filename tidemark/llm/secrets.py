"""Secret scan: patterns for known kinds, and sliding-window Shannon entropy for the rest.

Candidate strings are runs of token characters. Within one, each character class has its own runs; over a run of at
least ``window`` characters a window slides, its entropy kept by incremental counts: one character enters, one
leaves. Windows of high entropy are joined into spans. A candidate that a pattern of the allow-list matches whole adds
none; of other spans that a pattern touches, the parts between separators that it does not touch are looked at alone.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .scratch import small_batches

_KEYWORD = re.compile(rb"password|passwd|secret|token|api_?key")
_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
BASE = ("assign", "access", "hex")


def _lut(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_HEX = _lut(_DIGITS + "abcdef")
_SEPARATORS = b"/=_-"
_IS_SEPARATOR = _lut(_SEPARATORS.decode())
_PART = re.compile(rb"[^/=_-]+")
_TOKEN = _lut(_DIGITS + _LOWER + _LOWER.upper() + "+/=_-")


@dataclass(frozen=True)
class CharacterClass:
    """A window counts if its entropy (bits a character) is at least ``bits`` and it has a digit and a letter.

    With ``needs``, only spans that hold one of these characters are reported: other classes have the rest.
    """

    kind: str
    chars: str
    bits: float
    needs: str = ""


CLASSES = (
    CharacterClass("entropy_hex", _DIGITS + "abcdefABCDEF", 3.0),
    CharacterClass("entropy_base64", _DIGITS + _LOWER + _LOWER.upper() + "+/", 3.85),
    CharacterClass("entropy_base64url", _DIGITS + _LOWER + _LOWER.upper() + "-_", 3.85, "-_"),
)
#: Candidates that are not secrets: UUIDs, documentation samples, alphabets and digit sequences.
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)example",
    r"(?i)abcdefghijkl",
    r"0123456789(?:0123456789|abcdef|ABCDEF|$)",
)
WINDOW = 20
#: Characters from which a run is looked at in stretches of this many.
LONG = 1 << 14


def runs(member: np.ndarray, edges: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of at least ``least`` members that cross no edge."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = member.copy(), member.copy()
    begin[1:] &= ~member[:-1]
    end[:-1] &= ~member[1:]
    cut = edges[(edges > 0) & (edges < n)]
    begin[cut] = member[cut]
    end[cut - 1] = member[cut - 1]
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    keep = b - a >= least
    return a[keep], b[keep]


@lru_cache(maxsize=64)
def _run_pattern(chars: str, window: int) -> re.Pattern[bytes]:
    return re.compile(b"[" + re.escape(chars.encode()) + b"]{%d,}" % window)


def entropy_spans(text: bytes, cls: CharacterClass, window: int = WINDOW) -> list[tuple[int, int]]:
    """Joined windows of high entropy in the runs of a class."""
    found: list[tuple[int, int]] = []
    for m in _run_pattern(cls.chars, window).finditer(text):
        i, j = m.span()
        at = _high(text, i, j, cls, window) if j - i < LONG else _high_in_strides(text, i, j, cls, window)
        for a in at:
            b = a + window
            if found and a <= found[-1][1]:
                found[-1] = (found[-1][0], b)
            else:
                found.append((a, b))
    return found


def _high(text: bytes, i: int, j: int, cls: CharacterClass, window: int) -> Iterator[int]:
    """Where windows of high entropy begin in the run text[i:j]: one character leaves, one enters."""
    gain = [0.0] + [c * log2(c) for c in range(1, window + 1)]
    counts, total, digits = [0] * 256, 0.0, 0  # total: sum of c * log2(c)
    for x in range(i, j):
        if x - i >= window:  # one leaves before one enters: no count passes the window's length
            c = text[x - window]
            total += gain[counts[c] - 1] - gain[counts[c]]
            counts[c] -= 1
            digits -= 47 < c < 58
        c = text[x]
        total += gain[counts[c] + 1] - gain[counts[c]]
        counts[c] += 1
        digits += 47 < c < 58
        if x - i >= window - 1 and 0 < digits < window and log2(window) - total / window >= cls.bits:
            yield x - window + 1


def _high_in_strides(text: bytes, i: int, j: int, cls: CharacterClass, window: int) -> Iterator[int]:
    """The same for a long run: the running counts of each character of the class as arrays, a stretch at a time."""
    gain = np.array([0.0] + [c * log2(c) for c in range(1, window + 1)])
    for at in range(i, j - window + 1, LONG):
        part = np.frombuffer(text, np.uint8)[at : min(at + LONG + window - 1, j)]
        total = np.zeros(len(part) - window + 1)
        digits = np.zeros(len(total), np.int64)
        for c in np.unique(part).tolist():
            sums = np.concatenate([[0], np.cumsum(part == c)])
            inside = sums[window:] - sums[:-window]
            total += gain[inside]
            if 47 < c < 58:
                digits += inside
        yield from (at + np.flatnonzero((digits > 0) & (digits < window) & (log2(window) - total / window >= cls.bits))).tolist()


def unlisted(text: bytes, cls: CharacterClass, spans: list[tuple[int, int]], listed: list[tuple[int, int]], window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans without what the allow-list matched at ``listed``.

    A span goes with the separated parts it lies in. If a match touches these, only parts free of any count, by windows
    of their own; parts next to each other stay together across '_' and '-'.
    """
    out: list[tuple[int, int]] = []
    if not spans:
        return out
    cuts = np.flatnonzero(_IS_SEPARATOR[np.frombuffer(text, np.uint8)])
    a, b = np.array(spans).T
    before, after = np.searchsorted(cuts, a, "left") - 1, np.searchsorted(cuts, b, "left")
    lows = np.where(before >= 0, np.append(cuts, 0)[before] + 1, 0)
    highs = np.append(cuts, len(text))[after]
    hit = _Touched(listed)
    done = 0  # parts up to here were looked at
    for span, low, high in zip(spans, lows.tolist(), highs.tolist(), strict=True):
        if not hit(low, high):
            out.append(span)
            continue
        free: list[tuple[int, int]] = []
        for m in _PART.finditer(text, max(low, done), high) if high > done else ():
            if hit(m.start(), m.end()):
                continue
            if free and not text[free[-1][1] : m.start()].strip(b"_-"):
                free[-1] = (free[-1][0], m.end())
            else:
                free.append(m.span())
        out += [(f + x, f + y) for f, g in free for x, y in entropy_spans(text[f:g], cls, window)]
        done = max(done, high)
    return out


class _Touched:
    """Whether a range has a place in common with any of some ranges."""

    def __init__(self, ranges: list[tuple[int, int]]):
        lo, hi = np.array([r for r in ranges if r[0] < r[1]], np.int64).reshape(-1, 2).T
        lo, hi = bt.union_ranges(lo, hi)
        self.lo, self.hi = lo.tolist(), hi.tolist()

    def __call__(self, low: int, high: int) -> bool:
        i = bisect_right(self.hi, low)
        return i < len(self.lo) and self.lo[i] < high


def find_secrets(docs: DataFrame, carry: list[str], classes: tuple[CharacterClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW, window: int = WINDOW) -> DataFrame:
    """row (struct of the ``carry`` columns), spans (kind, start, end in code points, by start and then kind): one row per document.

    Base kinds (assign, access, hex) are leftmost and non-overlapping within a kind and are never suppressed; entropy
    kinds follow them. Whole texts of any length, about 15 bytes of memory a byte beyond the first megabyte; a null or
    empty text has no spans; an empty table gives an empty result; repeated rows stay; extra columns matter only if carried.
    """
    small_batches(docs.sparkSession)
    order = {kind: i for i, kind in enumerate([*BASE, *(c.kind for c in classes)])}
    kinds = list(order)
    patterns = [re.compile(x.encode()) for x in allow]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col("text").cast("string").alias("text"))
    schema = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)").alias("spans")).schema
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(s: bt.Slice) -> dict[int, list[tuple[int, int, int]]]:
        """Spans (start, kind number, end) in bytes of the slice, by document."""
        raw = s.data.tobytes()
        found: list[tuple[int, int, int]] = []
        doc_end = lambda i: int(s.offsets[np.searchsorted(s.offsets, i, "right")])
        lower, at = raw.lower(), 0
        while m := _KEYWORD.search(lower, at):
            hit = _ASSIGN.match(raw, m.start(), doc_end(m.start()))
            at = hit.end() if hit else m.start() + 1
            if hit and len(hit[1]) >= 8:
                found.append((hit.start(), 0, hit.end()))
        at = 0
        while (at := raw.find(b"AKIA", at)) >= 0:
            hit = _ACCESS.match(raw, at, doc_end(at))
            if hit and hit.end() - at >= 16:
                found.append((at, 1, hit.end()))
            at = hit.end() if hit else at + 1
        found += [(a, 2, b) for a, b in zip(*(x.tolist() for x in runs(_HEX[s.data], s.offsets, 32)), strict=True)]
        for a, b in zip(*(x.tolist() for x in runs(_TOKEN[s.data], s.offsets, window)), strict=True):
            text = raw[a:b]
            listed = [m.span() for p in patterns for m in p.finditer(text)]
            if (0, b - a) in listed:
                continue
            for c in classes:
                spans = entropy_spans(text, c, window)
                spans = unlisted(text, c, spans, listed, window) if listed else spans
                found += [(a + x, order[c.kind], a + y) for x, y in spans if not c.needs or any(n in text[x:y] for n in c.needs.encode())]
        out: dict[int, list[tuple[int, int, int]]] = {}
        for x in sorted(found):
            out.setdefault(int(np.searchsorted(s.offsets, x[0], "right")) - 1, []).append(x)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in bt.slices(batch.column(1)):
                result: list[list[dict]] = [[] for _ in range(s.count)]
                for d, spans in scan(s).items():
                    base = int(s.offsets[d])
                    points = np.concatenate([[0], np.cumsum((s.data[base : s.offsets[d + 1]] & 0xC0) != 0x80)])
                    result[d] = [{"kind": kinds[k], "start": int(points[a - base]), "end": int(points[b - base])} for a, k, b in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.count), pa.array(result, span)], names=["row", "spans"])
        bt.release()

    return rows.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select(F.col("row.doc_id").alias("doc_id"), *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
