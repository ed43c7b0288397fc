"""Benchmark decontamination by winnowing.

Of every window of ``width`` words the smallest ``gram``-word hash is kept (``repeats.select``), for benchmark items
and documents alike, so a shared span of ``width`` words or more always shares a fingerprint. Fingerprints are joined
against the benchmark's, a block of it at a time: a block has a bounded number of bytes and is broadcast; a larger
benchmark takes several passes over the documents. A fingerprint that is found is extended to the windows around it,
which are then compared with the item's windows word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from . import repeats as rp
from .scratch import Scratch, small_batches

#: Bytes of benchmark text broadcast at a time; with its hashes a block takes about eight times as many.
BLOCK_BYTES = 4 << 20
_TABLE = bytes(int(bt.LOWER[x]) if bt.ALNUM[x] else 0x20 for x in range(256))
_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def words_of(text: str | None) -> bytes:
    """Lower-cased (A-Z) runs of ASCII letters, digits and anything beyond ASCII, joined by single spaces."""
    return b" ".join((text or "").encode().translate(_TABLE).split())


class Block:
    """Some benchmark items, prepared for lookups, in arrays. Items are (id, words joined by spaces); one of fewer words than ``width`` is one window."""

    def __init__(self, items: list[tuple[str, bytes]], width: int, gram: int):
        self.width, self.gram = width, gram
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.text = b"\n".join(body for _, body in items)
        s = bt.Slice(0, np.frombuffer(self.text, np.uint8), np.cumsum([0, *(len(body) + 1 for _, body in items)]))
        s.offsets[-1] = len(self.text)
        self.starts, self.ends, at = bt.word_spans(s, bt.NOT_SPACE)
        symbols = bt.word_hashes(s, self.starts, self.ends)
        other = bt.word_hashes(s, self.starts, self.ends, which=1)
        self.item = np.array([number[name] for name, _ in items], np.int32)
        words = np.diff(at)
        length = np.minimum(words, width)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by length: hashes in order, first words, items
        for n in np.unique(length[length > 0]).tolist():
            of = np.flatnonzero(length == n)
            p = bt.ragged(at[of], words[of] - n + 1)
            item = np.repeat(self.item[of], words[of] - n + 1)
            h, h2 = bt.span_hashes(symbols, p, p + n), bt.span_hashes(other, p, p + n, 1)
            order = np.lexsort((item, h2, h))
            h, h2, p, item = h[order], h2[order], p[order], item[order]
            # a window that an item has several times is there once
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]) | (item[1:] != item[:-1])])
            self.windows[n] = h[new], p[new].astype(np.int32), item[new]
        self.starts, self.ends = self.starts.astype(np.int32), self.ends.astype(np.int32)
        whole = np.flatnonzero(words >= width)
        at = np.concatenate([[0], np.cumsum(words[whole])])
        symbols = symbols[np.repeat(words >= width, words)]
        self.prints = np.unique(rp.select(symbols, at, width, gram)[0])

    @staticmethod
    def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(values), bool)
        return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values

    def look(self, s: bt.Slice) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], set[int]]]]:
        """Words per document, and for documents with hits the hit windows and the items."""
        starts, ends, at = bt.word_spans(s, bt.ALNUM)
        symbols = bt.word_hashes(s, starts, ends, lower=True)
        found: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        if len(symbols) and self.windows:
            raw = s.data.tobytes().translate(_TABLE)
            for length, (table, first, item) in self.windows.items():
                if length == self.width:
                    h, doc, lo, n, _ = rp.select(symbols, at, self.width, self.gram)
                    hit = self._among(h, self.prints)
                    p = bt.ragged((at[doc] + lo)[hit], n[hit] + 1)
                else:
                    p = bt.ragged(at[:-1], np.maximum(np.diff(at) - length + 1, 0))
                h = bt.span_hashes(symbols, p, p + length)
                use = self._among(h, table)
                p, h = p[use], h[use]
                low, high = np.searchsorted(table, h), np.searchsorted(table, h, "right")
                docs = np.searchsorted(at, p, "right") - 1
                for x, d, i, j in zip(p.tolist(), docs.tolist(), low.tolist(), high.tolist(), strict=True):
                    words = b" ".join(raw[starts[x] : ends[x + length - 1]].split())
                    same = [int(item[y]) for y in range(i, j) if self.text[self.starts[first[y]] : self.ends[first[y] + length - 1]] == words]
                    if same:
                        spans, names = found.setdefault(d, ([], set()))
                        spans.append((x - int(at[d]), x - int(at[d]) + length))
                        names.update(same)
        return np.diff(at), found


def blocks(benchmark: DataFrame, width: int, gram: int, limit: int) -> Iterator[Block]:
    """The benchmark in blocks of about ``limit`` bytes; a longer item is split into parts that overlap by a window less a word."""
    held: list[tuple[str, bytes]] = []
    size = 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").toLocalIterator():
        for part in _parts(words_of(row.text), width, limit):
            held.append((row.item, part))
            size += len(part) + 1
            if size >= limit:
                yield Block(held, width, gram)
                held, size = [], 0
    yield Block(held, width, gram)


def _parts(text: bytes, width: int, limit: int) -> Iterator[bytes]:
    """Pieces of about ``limit`` bytes that share ``width - 1`` words with the next one."""
    while len(text) > limit:
        end = text.find(b" ", limit)
        if end < 0:
            break
        yield text[:end]
        # the next piece begins with the last width - 1 words of this one
        back = end
        for _ in range(width - 1):
            back = max(text.rfind(b" ", 0, back), 0)
        if back == 0:  # the piece has fewer words than a window
            limit += len(text[:end])
            continue
        text = text[back + 1 :]
    if text:
        yield text


def find_contamination(docs: DataFrame, benchmark: DataFrame, carry: list[str], width: int = 10, gram: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: row (struct of the ``carry`` columns), n_words, hits (hit word ranges), items (ids of items with occurring windows).

    A window is ``width`` consecutive words of an item, or all words of a shorter one. Every window that occurs
    anywhere in a document is found. Null and empty texts have no words; an item without words has no window; a null
    item_id counts as the empty string; repeated rows are rows of their own; empty tables give no hits; extra columns
    matter only if carried. Texts of any length are taken whole, about 10 bytes of memory a byte beyond the first megabyte.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "winnow")
    state = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"))
    schema = state.schema

    def one_pass(state: DataFrame, block: Block, last: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                for s in bt.slices(batch.column(1)):
                    part = batch.slice(s.first, s.count)
                    counts, found = block.look(s)
                    hits, items = part.column(3).to_pylist(), part.column(4).to_pylist()
                    for d, (spans, numbers) in found.items():
                        all_spans = np.array([*spans, *((x["start"], x["end"]) for x in hits[d])], np.int64)
                        lo, hi = bt.union_ranges(all_spans[:, 0], all_spans[:, 1])
                        hits[d] = [{"start": a, "end": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                        items[d] = sorted({*items[d], *(block.names[i] for i in numbers)})
                    text = pa.nulls(s.count, pa.string()) if last else part.column(1)
                    yield pa.RecordBatch.from_arrays([part.column(0), text, pa.array(counts), pa.array(hits, _HITS), pa.array(items, pa.list_(pa.string()))], names=schema.names)
            bt.release()

        return state.mapInArrow(run, schema)

    todo, number = None, 0
    for block in blocks(benchmark, width, gram, block_bytes):
        if todo is not None:
            state = scratch.keep(f"pass{number}", one_pass(state, todo, last=False))
            scratch.drop(f"pass{number - 1}")
            number += 1
        todo = block
    return one_pass(state, todo, last=True).drop("text")


def digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
