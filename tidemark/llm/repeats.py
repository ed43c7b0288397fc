"""Stretches of W units (bytes or words) that occur more than once anywhere in a corpus.

1. ``anchors``: in every stretch of W units the smallest K-gram hash (the last of equals) is its anchor. Equal
   stretches have the same anchor at the same place in them, so nothing shared is missed; neighbouring stretches
   share an anchor, so there are about 2 / (W - K + 2) anchors a unit. One row stands for all stretches of an anchor.
2. An anchor hash that occurs once belongs to no repeat. The others are candidates; the caller finds them.
3. ``segments``: the bytes around each candidate, fetched by joining candidates with the texts.
4. ``match``: candidates of an anchor hash meet in one task and are compared byte by byte through a ``classify``
   function. A hash of very many candidates is salted; its salts then compare the distinct stretches they have
   by 128-bit fingerprints in a partially aggregated group-by, so no task gets a hot group.
5. ``cover``: the ranges found, joined with the texts once more.

Rows are told apart by two 64-bit hashes of the text, one of them of the doc_id too, so several rows may have one
doc_id, or none. Rows equal in both columns are copies: all their stretches are repeats, and one row stands for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt

#: Candidates of one anchor hash that may meet in a task.
GROUP_ROWS = 4096
#: Candidates compared at a time; whole groups only.
CHUNK_ROWS = 20_000
#: Window starts looked at together in one long document.
STRIDE = 1 << 18
#: An end beyond every text.
END = 2**31 - 1
_POS = np.uint64((1 << 24) - 1)

ANCHORS = "k long, th long, h long, lo int, n short, d short"
RANGES = "k long, th long, lo int, hi int"


@dataclass(frozen=True)
class Unit:
    """What a stretch is counted in."""

    word: bool
    width: int  # W
    gram: int  # K

    def symbols(self, s: bt.Slice) -> tuple[np.ndarray, np.ndarray]:
        """A symbol a unit (bytes, or 64-bit hashes of words), and where each document's units begin."""
        if not self.word:
            return s.data, s.offsets
        starts, ends, at = bt.word_spans(s, bt.NOT_SPACE)
        return bt.word_hashes(s, starts, ends), at


def keys(doc_id: Column, text: Column) -> dict[str, Column]:
    """Hashes that tell rows apart."""
    return {"k": F.xxhash64(doc_id, text), "th": F.xxhash64(text, F.lit(7))}


def keyed(docs: DataFrame) -> DataFrame:
    """k, th, doc_id, text."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(*(v.alias(n) for n, v in keys(doc_id, text).items()), doc_id.alias("doc_id"), text.alias("text"))


def select(symbols: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """hash, document, first stretch (within the document), further stretches, distance from the first to the anchor."""
    found: list[tuple[np.ndarray, ...]] = []
    w = width - gram + 1
    for base in range(0, max(0, len(symbols) - width + 1), STRIDE):
        part = symbols[base : base + STRIDE + width - 1]
        hashes = bt.grams(part, gram)
        order = (hashes & ~_POS) | (_POS - np.arange(len(hashes), dtype=np.uint64))
        low = bt.window_min(order, w)
        first = np.clip(offsets[:-1] - base, 0, len(low))
        last = np.clip(offsets[1:] - width + 1 - base, first, np.maximum(first, len(low)))
        starts = bt.ragged(first, last - first)
        if not len(starts):
            continue
        anchor = (_POS - (low[starts] & _POS)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        end = np.concatenate([new[1:], [len(starts)]]) - 1
        lo, hi, a = starts[new], starts[end], anchor[new]
        doc = np.searchsorted(offsets, lo + base, "right") - 1
        found.append((hashes[a].view(np.int64), doc, lo + base - offsets[doc], hi - lo, a - lo))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def anchors(docs: DataFrame, unit: Unit) -> DataFrame:
    """One row per anchor of the keyed documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, th = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for s in bt.slices(batch.column(2)):
                h, doc, lo, n, d = select(*unit.symbols(s), unit.width, unit.gram)
                yield pa.RecordBatch.from_arrays([pa.array(k[s.first + doc]), pa.array(th[s.first + doc]), pa.array(h), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(d.astype(np.int16))], names=["k", "th", "h", "lo", "n", "d"])

        bt.release()

    return docs.select("k", "th", "text").mapInArrow(run, ANCHORS)


def copies(anchors: DataFrame) -> DataFrame:
    """Ranges over the whole of rows that occur more than once: each row has one anchor for its first stretch."""
    many = anchors.filter("lo = 0").groupBy("k", "th").agg(F.count("*").alias("m")).filter("m > 1")
    return many.select("k", "th", F.lit(0).alias("lo"), F.lit(END).alias("hi"))


def salted(candidates: DataFrame) -> DataFrame:
    """candidates (anchor rows with m, the rows of their hash) with the number of salts and one salt each."""
    salts = F.ceil(F.col("m") / GROUP_ROWS).cast("int")
    return candidates.withColumn("salts", salts).withColumn("salt", F.pmod(F.hash("k", "th", "lo"), F.col("salts")).cast("int")).drop("m")


def segments(docs: DataFrame, candidates: DataFrame, unit: Unit) -> DataFrame:
    """The bytes of each candidate: its stretches, put end to end where they overlap; words are joined by one space.

    Of copies that come one after another, as they do from a sorted join, one is looked at.
    """
    lists = candidates.groupBy("k", "th").agg(F.collect_set(F.struct("h", "lo", "n", "d", "salts", "salt")).alias("c"))
    kinds = {"h": pa.int64(), "lo": pa.int32(), "n": pa.int16(), "d": pa.int16(), "salts": pa.int32(), "salt": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            ids = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            if not len(ids):
                continue
            first = np.concatenate([[before is None or bool((ids[0] != before).any())], (ids[1:] != ids[:-1]).any(axis=1)])
            before = ids[-1]
            batch = batch.filter(pa.array(first))
            k, th, lists = batch.column(0), batch.column(1), batch.column(3)
            for s in bt.slices(batch.column(2)):
                part = lists.slice(s.first, s.count)
                flat, count = part.flatten(), part.value_lengths().to_numpy(zero_copy_only=False)
                get = {name: flat.field(name) for name in kinds}
                row = np.repeat(np.arange(s.count), count)
                lo = get["lo"].to_numpy(zero_copy_only=False).astype(np.int64)
                end = lo + get["n"].to_numpy(zero_copy_only=False) + unit.width
                raw = s.data.tobytes()
                if unit.word:
                    starts, ends, at = bt.word_spans(s, bt.NOT_SPACE)
                    a, b = starts[at[row] + lo], ends[at[row] + end - 1]
                    texts = [b" ".join(raw[i:j].split()) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                else:
                    a, b = s.offsets[row] + lo, s.offsets[row] + end
                    texts = [raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                take = pa.array(row + s.first)
                yield pa.RecordBatch.from_arrays([k.take(take), th.take(take), *get.values(), pa.array(texts, pa.binary())], names=["k", "th", *kinds, "seg"])
        bt.release()

    joined = docs.select("k", "th", "text").join(lists, ["k", "th"])
    return joined.mapInArrow(run, "k long, th long, h long, lo int, n short, d short, salts int, salt int, seg binary")


#: From a buffer, starts, lengths and group numbers to class numbers: equal where group and bytes are equal.
Classify = Callable[[bytes, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _compare(t: pa.Table, unit: Unit, classify: Classify) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Repeated ranges among whole groups, and what the salts of hot hashes have to compare."""
    col = {x: t.column(x).to_numpy() for x in ("k", "th", "h", "lo", "n", "d", "salts", "salt")}
    seg = t.column("seg").combine_chunks().cast(pa.large_binary())
    ends = np.frombuffer(seg.buffers()[1], np.int64)[seg.offset : seg.offset + len(seg) + 1]
    at, size, buf = ends[:-1] - ends[0], np.diff(ends), seg.buffers()[2].to_pybytes()[ends[0] : ends[-1]]
    h, lo, n, d = col["h"], col["lo"].astype(np.int64), col["n"].astype(np.int64), col["d"].astype(np.int64)
    group = np.cumsum(np.concatenate([[0], (h[1:] != h[:-1]) | (col["salt"][1:] != col["salt"][:-1])]))
    # whole segments first: copies need no look inside
    shape = np.unique(np.stack([group, n, d, size]), axis=1, return_inverse=True)[1].ravel()
    whole = classify(buf, at, size, shape)
    times = np.bincount(whole)[whole]
    out = [(np.flatnonzero(times > 1), lo[times > 1], (lo + n + unit.width)[times > 1])]
    # then the stretches of one segment of each kind, where a group has several kinds
    rep = np.sort(np.unique(whole, return_index=True)[1])
    kinds = np.bincount(group[rep], minlength=group[-1] + 1)
    rep = rep[(kinds[group[rep]] > 1) | (col["salts"][rep] > 1)]
    row = np.repeat(rep, n[rep] + 1)
    j = bt.ragged(np.zeros(len(rep), np.int64), n[rep] + 1)
    if unit.word:
        gaps = np.frombuffer(buf, np.uint8) == 0x20
        # starts and ends of the words of a segment, in order
        spaces = np.flatnonzero(gaps)
        before = np.searchsorted(spaces, at[row])
        start = np.where(j == 0, at[row], spaces[np.minimum(before + j - 1, max(len(spaces) - 1, 0))] + 1) if len(spaces) else at[row]
        last = before + j + unit.width - 1
        stop = np.where(j == n[row], at[row] + size[row], spaces[np.minimum(last, len(spaces) - 1)]) if len(spaces) else at[row] + size[row]
        length = stop - start
    else:
        start, length = at[row] + j, np.full(len(row), unit.width, np.int64)
    shared = np.zeros((0, 2), np.uint64)
    mine = np.zeros(0, np.int64)
    alone = np.zeros(0, bool)
    if len(row):
        inner = classify(buf, start, length, group[row] * 65536 + (d[row] - j))
        seen = np.bincount(inner)[inner]
        hit = (seen > 1) & (times[row] == 1)
        r, p = row[hit], lo[row[hit]] + j[hit]
        out.append((r, p, p + unit.width))
        hot = np.flatnonzero(col["salts"][row] > 1)
        mine = np.sort(hot[np.unique(inner[hot], return_index=True)[1]])
        if len(mine):
            data = np.frombuffer(buf, np.uint8)
            shared = np.stack([bt.span_hashes(data, start[mine], start[mine] + length[mine], x) for x in (0, 1)], axis=1)
            alone = (seen[mine] == 1) & (times[row[mine]] == 1)
    r, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    # ranges of a row that overlap become one
    base = np.int64(2**31)
    key = np.unique(r, return_inverse=True)
    x, y = bt.union_ranges(key[1].astype(np.int64) * base + a, key[1].astype(np.int64) * base + b)
    r = key[0][x // base] if len(x) else r
    ranges = [pa.array(col["k"][r]), pa.array(col["th"][r]), pa.array((x % base).astype(np.int32)), pa.array(((y - 1) % base + 1).astype(np.int32))]
    m, none = len(r), lambda kind, size: pa.nulls(size, kind)
    r2 = row[mine] if len(mine) else np.zeros(0, np.int64)
    p2 = lo[r2] + j[mine]
    names = ["k", "th", "lo", "hi", "h", "f1", "f2", "alone"]
    return (
        pa.RecordBatch.from_arrays([*ranges, none(pa.int64(), m), none(pa.int64(), m), none(pa.int64(), m), none(pa.bool_(), m)], names=names),
        pa.RecordBatch.from_arrays([pa.array(col["k"][r2]), pa.array(col["th"][r2]), pa.array(p2.astype(np.int32)), pa.array((p2 + unit.width).astype(np.int32)), pa.array(h[r2]), pa.array(shared[:, 0].view(np.int64) if len(mine) else np.zeros(0, np.int64)), pa.array(shared[:, 1].view(np.int64) if len(mine) else np.zeros(0, np.int64)), pa.array(alone)], names=names),
    )


def match(segs: DataFrame, unit: Unit, classify: Classify, keep: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    """Ranges (in units of the document) covered by stretches that occur again. ``keep`` materialises a frame under a name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                t = pa.Table.from_batches(held).combine_chunks()
                h, salt = t.column("h").to_numpy(), t.column("salt").to_numpy()
                cut = np.flatnonzero((h[1:] != h[:-1]) | (salt[1:] != salt[:-1]))
                if len(cut):
                    yield from _compare(t.slice(0, cut[-1] + 1), unit, classify)
                    t = t.slice(cut[-1] + 1)
                held, rows = t.to_batches(), len(t)
        if rows:
            yield from _compare(pa.Table.from_batches(held), unit, classify)
        bt.release()

    parts = int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = segs.repartition(parts, "h", "salt").sortWithinPartitions("h", "salt")
    found = keep("found", dealt.mapInArrow(run, RANGES + ", h long, f1 long, f2 long, alone boolean"))
    several = found.filter("h is not null").groupBy("h", "f1", "f2").agg(F.count("*").alias("m")).filter("m > 1")
    across = found.filter("h is not null and alone").join(several, ["h", "f1", "f2"])
    return found.filter("h is null").select("k", "th", "lo", "hi").unionByName(across.select("k", "th", "lo", "hi"))


def cover(docs: DataFrame, ranges: DataFrame, unit: Unit) -> DataFrame:
    """doc_id, n_units, n_removed, spans (removed runs as [start, end) units), kept (what is left: bytes, or words joined by one space)."""
    lists = ranges.groupBy("k", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("r"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in bt.slices(batch.column(1)):
                ids = batch.column(0).slice(s.first, s.count)
                raw = s.data.tobytes()
                totals, removed, spans, kept = [], [], [], []
                for i, ranges in enumerate(batch.column(2).slice(s.first, s.count).to_pylist()):
                    body = raw[s.offsets[i] : s.offsets[i + 1]]
                    units = body.split() if unit.word else body
                    lo = np.array([x["lo"] for x in ranges or ()], np.int64)
                    hi = np.minimum(np.array([x["hi"] for x in ranges or ()], np.int64), len(units))
                    lo, hi = bt.union_ranges(lo, hi)
                    left, at = [], 0
                    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                        left.append(units[at:a])
                        at = b
                    left.append(units[at:])
                    kept.append(b" ".join(w for part in left for w in part) if unit.word else b"".join(left))
                    totals.append(len(units))
                    removed.append(int((hi - lo).sum()))
                    spans.append([{"start": a, "end": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([ids, pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_units", "n_removed", "spans", "kept"])
        bt.release()

    joined = docs.join(lists, ["k", "th"], "left").select("doc_id", "text", "r")
    return joined.mapInArrow(run, "doc_id long, n_units long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")
