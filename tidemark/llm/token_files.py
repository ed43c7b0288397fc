"""Token ids in files of Simple-8b words.

A table of chunks, written and read by Spark (so a lost executor's part files are simply made anew). A chunk holds whole
documents, in ascending order of doc_id, and is a sequence of blocks of ``BLOCK`` ids. A 64-bit word has a selector in
its top four bits and as many ids as the selector says in the other sixty; no word crosses a block. Ids of 60 bits or
more are escaped: selector 15 with all other bits set announces a raw word. ``block_words`` says at which word each
block begins, so any block decodes alone and all words of a selector decode in one vectorised step.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import bytetext as bt
from .scratch import Scratch, small_batches

#: Ids packed by one word, by selector, and the bits of each. Selectors 0 and 1 stand for runs of zeros.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 512
#: Ids of a chunk, if no single document has more; blocks packed and unpacked at a time.
CHUNK_IDS, CHUNK_BLOCKS = 1 << 17, 256
ESCAPE = np.uint64((15 << 60) | ((1 << 60) - 1))
_LARGEST = (1 << 60) - 2
#: Pieces of text and ids of theirs that are remembered in a Python worker, from task to task (in arrays of 53 MB in all); then it starts afresh.
REMEMBERED, REMEMBERED_IDS = 1_000_000, 5_000_000
#: Bytes of pieces that go to the library at a time.
CALL_BYTES = 1 << 17


def _needs(ids: np.ndarray) -> np.ndarray:
    """For each id the first selector wide enough for it."""
    limits = np.array([(1 << int(b)) - 1 for b in BITS[2:15]], np.uint64)  # selectors 2 to 14
    if len(ids) and ids.max() < 1 << 16:
        table = np.searchsorted(limits, np.arange(1 << 16, dtype=np.uint64)).astype(np.int8) + np.int8(2)
        table[0] = 0
        return table[ids]
    out = np.searchsorted(limits, ids).astype(np.int8) + np.int8(2)
    out[ids == 0] = 0
    return out


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64) of unsigned ids, and the word at which each block begins."""
    words, blocks, have = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for i in range(0, len(ids), CHUNK_BLOCKS * BLOCK):
        part, begin = _encode_blocks(np.ascontiguousarray(ids[i : i + CHUNK_BLOCKS * BLOCK], np.uint64))
        words.append(part)
        blocks.append(begin + have)
        have += len(part)
    return np.concatenate(words), np.concatenate(blocks)


def _encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids)
    need = _needs(ids)
    inside = np.arange(n, dtype=np.int32) % BLOCK
    best = np.full(n, 15, np.int8)
    rows, have = need, 1
    for sel in range(14, -1, -1):  # the widest run whose largest id fits and that stays in its block
        count = int(COUNTS[sel])
        if count > min(n, BLOCK):
            break
        while have < count:
            step = min(have, count - have)
            rows = np.maximum(rows[: len(rows) - step], rows[step:])
            have += step
        best[: len(rows)][(rows <= sel) & (inside[: len(rows)] <= BLOCK - count)] = sel
    # all blocks take a word at a time together
    jump = COUNTS[best]
    at = np.arange(0, n, BLOCK)
    end = np.minimum(at + BLOCK, n)
    taken = []
    while len(at):
        taken.append(at)
        at = at + jump[at]
        go = at < end
        if not go.all():
            at, end = at[go], end[go]
    at = np.sort(np.concatenate(taken))
    sel = best[at]
    body = np.zeros(len(at), np.uint64)
    for s in np.unique(sel).tolist():
        if s > 1:
            rows = np.flatnonzero(sel == s)
            shift = np.arange(int(COUNTS[s]), dtype=np.uint64) * np.uint64(BITS[s])
            body[rows] = np.bitwise_or.reduce(ids[at[rows][:, None] + np.arange(int(COUNTS[s]))] << shift, axis=1)
    raw = (sel == 15) & (ids[at] > np.uint64(_LARGEST))
    words = (sel.astype(np.uint64) << np.uint64(60)) | body
    words[raw] = ESCAPE
    place = np.arange(len(at)) + np.cumsum(raw) - raw
    out = np.zeros(len(at) + int(raw.sum()), np.uint64)
    out[place] = words
    out[place[raw] + 1] = ids[at[raw]]
    return out, place[np.searchsorted(at, np.arange(0, n, BLOCK))]


def decode(words: np.ndarray) -> np.ndarray:
    """All ids of a run of words that begins at a block."""
    words = np.ascontiguousarray(words, np.uint64)
    raw = np.flatnonzero(words == ESCAPE)
    if len(raw):
        # a raw word may look like an escape: take them in order
        real, last = [], -2
        for x in raw.tolist():
            if x != last + 1:
                real.append(x)
                last = x
        raw = np.array(real)
    keep = np.ones(len(words), bool)
    keep[raw + 1 if len(raw) else raw] = False
    values = words[raw + 1] if len(raw) else np.zeros(0, np.uint64)
    marks = words[keep]
    sel = (marks >> np.uint64(60)).astype(np.int64)
    count = COUNTS[sel]
    start = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(sel).tolist():
        if s < 2:
            continue
        rows = np.flatnonzero(sel == s)
        shift = np.arange(int(COUNTS[s]), dtype=np.uint64) * np.uint64(BITS[s])
        mask = np.uint64((1 << int(BITS[s])) - 1)
        out[start[rows][:, None] + np.arange(int(COUNTS[s]))] = (marks[rows][:, None] >> shift) & mask
    if len(raw):
        out[start[np.flatnonzero(marks == ESCAPE)]] = values
    return out


def decode_strides(words: np.ndarray, block_words: list[int]) -> Iterator[np.ndarray]:
    """Ids of a chunk, some blocks at a time."""
    edges = [*block_words[::CHUNK_BLOCKS], len(words)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield decode(words[a:b])


#: Kinds of pieces: those that go to the library by themselves, those led by a space or line feed, those that follow a letter.
ALONE, LED, TRAILING = range(3)
#: What stands before each ``TRAILING`` piece of a text: a piece that ends in a letter.
LETTER = b" a"


class Encoder:
    """Ids of whole texts by the tokenizers library.

    Byte-level BPE with this vocabulary's splitting pattern never merges across the point before a space or line feed,
    unless that has white space (or an end of the text) on both sides, nor across the point between an ASCII letter and
    an ASCII character that is none. So a text is the sequence of the pieces between such points. Ids of pieces are
    remembered under 64-bit hashes in an open-addressing table of fixed size. The unseen pieces of a slice go to the
    library many at a time, as one text whose ids are dealt to the pieces by the bytes that each id stands for: those
    led by a space or line feed and a letter or mark as they are, those that follow a letter behind a ``LETTER`` each,
    whose ids are left out. Others, which white space might tie to what is before them or which may hold a special
    token, go by themselves.
    """

    SLOTS = 1 << 21

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a special token is not cut: behind its letters only "|" may come
        self.fine = all(re.fullmatch(r"<\|[A-Za-z]*\|>", t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # bytes that an id stands for
        for token, number in self.tokenizer.get_vocab().items():
            self.width[number] = len(token)
        self.keys = np.zeros(self.SLOTS, np.uint64)  # 0: free
        self.entry = np.zeros(self.SLOTS, np.int32)
        self.starts, self.lengths = np.zeros(REMEMBERED, np.int32), np.zeros(REMEMBERED, np.int32)
        self.ids, self.used, self.count = np.zeros(REMEMBERED_IDS, np.int32), 0, 0

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each hash, and whether it is taken (else it is the free slot where the search ended)."""
        mask = np.uint64(self.SLOTS - 1)
        slot = (h & mask).astype(np.int64)
        open_ = np.arange(len(h))
        taken = np.zeros(len(h), bool)
        while len(open_):
            there = self.keys[slot[open_]]
            same = there == h[open_]
            taken[open_[same]] = True
            open_ = open_[~same & (there != 0)]
            slot[open_] = (slot[open_] + 1) & (self.SLOTS - 1)
        return slot, taken

    def _learn(self, h: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Remember the ids of pieces with distinct unseen hashes, as far as there is room; a full table is emptied first."""
        if self.count + len(h) > REMEMBERED or self.used + len(ids) > REMEMBERED_IDS:
            self.keys[:] = 0
            self.used = self.count = 0
        ends = np.cumsum(counts)
        m = min(len(h), REMEMBERED, int(np.searchsorted(ends, REMEMBERED_IDS, "right")))
        if not m:
            return
        h, total = h[:m], int(ends[m - 1])
        self.starts[self.count : self.count + m] = self.used + ends[:m] - counts[:m]
        self.lengths[self.count : self.count + m] = counts[:m]
        self.ids[self.used : self.used + total] = ids[:total]
        left = np.arange(m)
        while len(left):
            slot, _ = self._find(h[left])
            _, winner = np.unique(slot, return_index=True)
            self.keys[slot[winner]] = h[left[winner]]
            self.entry[slot[winner]] = self.count + left[winner]
            left = np.delete(left, winner)
        self.count += m
        self.used += total

    def _encode(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.int32)

    def _encode_pieces(self, pieces: list[bytes], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and the number of each. Pieces of one kind are neighbours; all but ``ALONE`` ones share texts."""
        ids, counts, i = [], [], 0
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        while i < len(pieces):
            kind = kinds[i]
            if kind == ALONE:
                ids.append(self._encode(pieces[i]))
                counts.append([len(ids[-1])])
                i += 1
                continue
            j = int(np.searchsorted(ends, ends[i] - sizes[i] + CALL_BYTES, "right"))
            j = max(i + 1, min(j, int(np.searchsorted(kinds, kind, "right"))))
            if kind == LED:
                made, bounds = self._encode(b"".join(pieces[i:j])), np.cumsum([0, *sizes[i:j]])
            else:
                made, bounds = self._encode(LETTER + LETTER.join(pieces[i:j])), np.zeros(2 * (j - i) + 1, np.int64)
                bounds[1::2], bounds[2::2] = len(LETTER), sizes[i:j]
                bounds = np.cumsum(bounds)
            count = np.diff(np.searchsorted(np.cumsum(self.width[made]), bounds, "right"))
            if kind == TRAILING:
                own = np.arange(len(count)) % 2 == 1
                made, count = made[np.repeat(own, count)], count[own]
            ids.append(made)
            counts.append(count)
            i = j
        return (np.concatenate(ids), np.concatenate(counts).astype(np.int64)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def slice(self, s: bt.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of each text's."""
        n, docs = len(s.data), s.count
        if not n:
            return np.zeros(0, np.int32), np.zeros(docs, np.int64)
        data, raw = s.data, s.data.tobytes()
        first = np.zeros(n + 1, bool)
        first[s.offsets] = True
        lead = (data == 0x20) | (data == 0x0A)
        before = np.concatenate([[True], _MAY_END[data[:-1]]]) | first[:n]
        opens = (data == 0x3C) & np.concatenate([data[1:] == 0x7C, [False]])
        # a special token is an end of the text to the white space before it
        after = np.concatenate([_MAY_BEGIN[data[1:]] | opens[1:], [True]]) | first[1:]
        # pieces: from one point that may be cut at to the next
        trails = np.zeros(n, bool)
        if self.fine:
            trails[1:] = _LETTER[data[:-1]] & _ENDS_LETTERS[data[1:]]
            trails &= ~first[:n]
        begin = np.flatnonzero((lead & ~(before & after)) | trails | first[:n])
        kinds = np.where((lead & ~after)[begin], LED, np.where((trails & ~lead)[begin], TRAILING, ALONE))
        end = np.append(begin[1:], n)
        kinds[np.searchsorted(begin, np.flatnonzero(opens), "right") - 1] = ALONE
        h = np.maximum(bt.span_hashes(data, begin, end), np.uint64(1))
        slot, seen = self._find(h)
        entry = self.entry[slot]
        sizes = np.where(seen, self.lengths[entry], 0).astype(np.int64)
        new = np.flatnonzero(~seen)
        keys, at, of = np.unique(h[new], return_index=True, return_inverse=True)
        turn = np.argsort(kinds[new[at]], kind="stable")
        at = new[at][turn]
        made, counts = self._encode_pieces([raw[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)], kinds[at])
        place = np.empty(len(turn), np.int64)
        place[turn] = np.arange(len(turn))
        of = place[of.ravel()]
        sizes[new] = counts[of]
        # remembered ids and those made now, in the order of the pieces
        where = np.zeros(len(h), np.int64)
        where[seen] = self.starts[entry[seen]]
        where[new] = (np.cumsum(counts) - counts)[of]
        ids = np.empty(int(sizes.sum()), np.int32)
        owner = np.repeat(seen, sizes)
        known = np.flatnonzero(seen)
        ids[owner] = self.ids[bt.ragged(where[known], sizes[known])]
        ids[~owner] = made[bt.ragged(where[new], sizes[new])]
        self._learn(keys[turn], made, counts)
        doc = np.searchsorted(s.offsets, begin, "right") - 1
        return ids, np.bincount(doc, sizes, docs).astype(np.int64)


#: The encoder of a Python worker, by its file.
_kept: dict[str, Encoder] = {}


def kept_encoder(path: str) -> Encoder:
    """The encoder that this process keeps for its next task; of one file at a time."""
    if path not in _kept:
        _kept.clear()
        _kept[path] = Encoder(path)
    return _kept[path]


#: Bytes that may end, and begin, a white-space character in UTF-8.
_MAY_END, _MAY_BEGIN = bt.SPACE.copy(), bt.SPACE.copy()
_MAY_END[[*range(0x1C, 0x20), 0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True
_MAY_BEGIN[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: ASCII letters, and the ASCII characters that end a run of them; not "|", which special tokens have behind their letters.
_LETTER, _ENDS_LETTERS = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_ENDS_LETTERS[:0x80] = ~_LETTER[:0x80]
_ENDS_LETTERS[0x7C] = False

CHUNKS = "shard int, chunk int, first long, n_ids long, doc_ids array<long>, lengths array<long>, block_words array<long>, words binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, parts: int | None = None) -> None:
    """Encode every text and write chunks to ``path``: ascending doc_id over shards, chunks and places within a chunk.

    A null text is empty, an empty text is its end id alone; rows with one doc_id are neighbours, null doc_ids come
    first; an empty table makes empty files. A text of any length is one piece of one chunk, about 40 bytes of memory a
    byte beyond the first megabyte. ``first`` counts the ids before the chunk within its shard. Extra columns are not carried.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder = TaskContext.get().partitionId(), kept_encoder(tokenizer)
        state = {"chunk": 0, "first": 0}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # doc_ids, lengths, ids

        def flush() -> pa.RecordBatch:
            docs, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            words, blocks = encode(ids)
            row = [shard, state["chunk"], state["first"], len(ids), [None if x == _NONE else x for x in docs.tolist()], lengths.tolist(), blocks.tolist(), words.astype("<u8").tobytes()]
            state["chunk"] += 1
            state["first"] += len(ids)
            held.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in CHUNKS.split(", ")])

        for batch in batches:
            doc_ids = batch.column(0).fill_null(_NONE).to_numpy(zero_copy_only=False)
            for s in bt.slices(batch.column(1)):
                ids, counts = encoder.slice(s)
                lengths = counts + 1
                full = np.full(int(lengths.sum()), end_id, np.int32)
                at = np.cumsum(lengths) - lengths
                full[bt.ragged(at, counts)] = ids
                held.append((doc_ids[s.first : s.first + s.count], lengths, full))
                if sum(len(x[2]) for x in held) >= CHUNK_IDS:
                    yield flush()
        if held:
            yield flush()
        bt.release()

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = kept.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, CHUNKS).write.mode("overwrite").parquet(path)


#: Stands for a null doc_id within a chunk.
_NONE = -(2**63)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (binary: little-endian unsigned 32-bit; larger ids do not fit and are an error), from the files alone."""
    files = spark.read.schema(CHUNKS).parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = shards.select("shard", (F.sum("total").over(W.Window.orderBy("shard")) - F.col("total")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, raw = np.frombuffer(row["words"], "<u8"), bytearray()
                for ids in decode_strides(words, row["block_words"]):
                    if len(ids) and ids.max() >= 2**32:
                        raise ValueError("a token id needs more than 32 bits")
                    raw += ids.astype("<u4").tobytes()
                ends = np.cumsum(row["lengths"]) * 4
                begins = np.concatenate([[0], ends[:-1]])
                start = begins // 4 + row["first"] + row["base"]
                parts = [bytes(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(parts, pa.binary())], names=["doc_id", "start", "ids"])
        bt.release()

    # one row a shard: as many as the write had partitions
    rows = files.select("shard", "first", "doc_ids", "lengths", "block_words", "words").join(F.broadcast(before), "shard")
    return rows.mapInArrow(run, "doc_id long, start long, ids binary")


def digest(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of each document's ids."""
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write docs as token files in the shared folder and read them back."""
    path = Scratch(docs.sparkSession, "tokens").path("files")
    write_token_files(docs, path, tokenizer, end_id)
    return digest(read_token_files(docs.sparkSession, path))


