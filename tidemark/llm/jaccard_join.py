"""Jaccard self-join of documents on word shingles, by size-banded tiles of bitmap signatures.

Shingles are 64-bit hashes of their words. Documents with one set of shingles are one class; only class
representatives go on. Two sets of Jaccard similarity t or more must share one of their first (1 - t) * size + 1
shingles in any common order. The order here puts shingles that are frequent in the corpus (by a count-min sketch of
fixed size) last, so these prefixes hold rare ones. Classes that share a prefix shingle form a tile, in order of size.
The place of the first shared shingle bounds what a pair can share, so a row whose place allows no partner in its tile
goes at once. A tile is cut into blocks; a row is sent only to blocks that hold a set of a matching size and of another
component. There the popcounts of hashed bitmap signatures (a bit an element) bound the intersection from above; what
passes is bounded once more by signatures of four bits an element, and then intersected exactly.

No group is expanded into all its pairs. First, members of a tile are paired with a neighbour in size only, then with
the likeliest partner outside their component; the links found give components. Then tiles that still span several
components, each set of members once, are compared block against block; only pairs from different components that the
bitmaps cannot exclude come out and are intersected, so no link between different components is lost. Sets are made
again from the texts of those that take part in such a pair; only signatures are kept for all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from . import repeats as rp
from .components import components
from .scratch import Scratch, small_batches

#: Cells of the sketch of shingle frequencies; its size does not depend on the corpus.
SKETCH = 1 << 18
#: Bits of a signature: the power of two at four times the set's size or above, within these.
LEAST_BITS, MOST_BITS = 256, 1 << 17
#: Signatures in tiles are folded to a part of that.
FOLD = 4
#: Representatives of one block of a tile.
TILE = 512
#: Pairs of one class that are verified in one group.
PARTNERS = 256
#: Rows before it in its tile among which a row looks for a neighbour that its place allows.
NEIGHBOURS = 8
#: Bits of a class's name.
NAME_BITS = 64
#: Rows looked at together where groups are read in order.
CHUNK_ROWS = 100_000


def shingle_sets(s: bt.Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, one after another, and the number of each document's."""
    starts, ends, at = bt.word_spans(s, bt.NOT_SPACE)
    words = bt.word_hashes(s, starts, ends, lower=True)
    total = np.diff(at)
    width = np.where(total > 0, np.minimum(total, k), 0)
    count = np.where(total > 0, total - width + 1, 0)
    p = bt.ragged(at[:-1], count)
    doc = np.repeat(np.arange(s.count), count)
    h = bt.span_hashes(words, p, p + width[doc])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        h, doc = h[first], doc[first]
    return h, np.bincount(doc, minlength=s.count)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of n of which a partner of the needed similarity must share one."""
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def needed(n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection with 100 * intersection >= percent * union."""
    return (percent * (n1 + n2) + 99 + percent) // (100 + percent)


def signature_bits(n: np.ndarray) -> np.ndarray:
    return np.clip(1 << np.ceil(np.log2(np.maximum(4 * n, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)


def signatures(h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """A bitmap of hashed elements for each set."""
    bits = signature_bits(n)
    first = np.cumsum(bits) - bits
    out = np.zeros(int(bits.sum()), bool)
    out[np.repeat(first, n) + (bt.mix(h) & (np.repeat(bits, n) - 1).astype(np.uint64)).astype(np.int64)] = True
    raw = np.packbits(out).tobytes()
    cuts = [*(first // 8).tolist(), len(raw)]
    return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def folded(g: np.ndarray, words: int) -> np.ndarray:
    """Signatures (rows, words of 64 bits) as those of fewer bits."""
    while g.shape[-1] > words:
        half = g.shape[-1] // 2
        g = g[..., :half] | g[..., half:]
    return g


def class_ids(h: np.ndarray, n: np.ndarray, bits: int = 64, split: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each set: sums over its elements, the same for equal sets in any order.

    The first one, cut to ``bits``, names the class. Where it is among ``split`` (names that different sets were found to have), the
    name is made of both.
    """
    ends = np.concatenate([[0], np.cumsum(n)])
    out = []
    for x in (1, 2):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(bt.mix(h ^ np.uint64(x)), dtype=np.uint64)])
        out.append(bt.mix(bt.mix(sums[ends[1:]] - sums[ends[:-1]]) + n.astype(np.uint64)).view(np.int64))
    out[0] = out[0] >> (64 - bits)
    if split is not None and len(split):
        out[0] = np.where(np.isin(out[0], split), renamed(*out), out[0])
    return out[0], out[1]


def renamed(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return bt.mix(bt.mix(c.view(np.uint64)) ^ d.view(np.uint64)).view(np.int64)


def _classes(docs: DataFrame, k: int) -> DataFrame:
    """k, th, id, c, d (names of the set), e (c and d in one), n, g (signature) of each document, and pages of this task's sketch of shingle frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "th", "id", "c", "d", "e", "n", "g", "page", "counts"]
        cells = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for s in bt.slices(batch.column(3)):
                part = batch.slice(s.first, s.count)
                h, n = shingle_sets(s, k)
                cells += np.bincount(_cell(h), minlength=SKETCH)
                c, d = class_ids(h, n, NAME_BITS)
                made = [pa.array(c), pa.array(d), pa.array(renamed(c, d)), pa.array(n.astype(np.int32)), pa.array(signatures(h, n), pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *made, pa.nulls(s.count, pa.int32()), pa.nulls(s.count, pa.binary())], names=names)
        if cells.any():
            pages = cells.reshape(-1, PAGE)
            m = len(pages)
            empty = [pa.nulls(m, pa.int64())] * 6 + [pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(np.arange(m, dtype=np.int32)), pa.array([x.tobytes() for x in pages], pa.binary())], names=names)
        bt.release()

    return docs.select("k", "th", "id", "text").mapInArrow(run, "k long, th long, id long, c long, d long, e long, n int, g binary, page int, counts binary")


#: Cells of a page of the sketch.
PAGE = 1 << 12


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64) & (SKETCH - 1)


def _sketch(pages: DataFrame) -> np.ndarray:
    """Sums of all tasks' pages: SKETCH numbers, however large the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[page] = sums.get(page, 0) + np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["page", "counts"])

    out = np.zeros((SKETCH // PAGE, PAGE), np.int64)
    for row in pages.repartition(16, "page").mapInArrow(run, "page int, counts binary").collect():
        out[row.page] = np.frombuffer(row.counts, np.int64)
    return out.ravel()


def _prefixes(docs: DataFrame, k: int, percent: int, counts: np.ndarray, split: np.ndarray) -> DataFrame:
    """t, c, n, u: the prefix shingles of every document's set, frequent shingles last; u is the largest partner that the shingle's place allows, if it is the first shared one."""
    mean = max(1.0, float(counts.mean()))
    rank = np.floor(np.log2(np.maximum(counts, 1) / mean).clip(0)).astype(np.uint64)  # 0 unless it stands out
    sent = docs.sparkSession.sparkContext.broadcast((rank, split))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, split = sent.value
        for batch in batches:
            for s in bt.slices(batch.column(0)):
                h, n = shingle_sets(s, k)
                c = class_ids(h, n, NAME_BITS, split)[0]
                _, once = np.unique(c, return_index=True)  # copies have the same rows
                doc = np.repeat(np.arange(s.count), n)
                if rank.any():
                    h = h[np.lexsort((h, rank[_cell(h)], doc))]
                first, length = (np.cumsum(n) - n)[once], prefix_length(n[once], percent)
                at, of = bt.ragged(first, length), np.repeat(once, length)
                place = at - np.repeat(first, length)
                u = np.maximum((100 + percent) * (n[of] - place) // percent - n[of], 0)
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(c[of]), pa.array(n[of].astype(np.int32)), pa.array(u.astype(np.int32))], names=["t", "c", "n", "u"])
        bt.release()

    return docs.select("text").mapInArrow(run, "t long, c long, n int, u int")


def _runs(prefixes: DataFrame, percent: int) -> DataFrame:
    """Prefix rows of shingles that several classes have, with their place in the shingle's tile in order of size, and a class before that may be a partner.

    Left out are rows whose u, and the u of others in the tile, allow no pair; a tile that goes beyond a chunk stays whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None  # the row before
        place, waiting = 0, False  # its place in its tile; whether it has not come out yet

        def work(x: list[np.ndarray], more_to_come: bool) -> Iterator[pa.RecordBatch]:
            nonlocal last, place, waiting
            if last is not None:
                x = [np.concatenate([[a], b]) for a, b in zip(last, x, strict=True)]
            t, c, n, u = x
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])])  # copies have the same rows
            t, c, n, u = t[new], c[new], n[new].astype(np.int64), u[new].astype(np.int64)
            m = len(t)
            start = np.concatenate([[True], t[1:] != t[:-1]])
            first = np.maximum.accumulate(np.where(start, np.arange(m), 0))
            at = np.arange(m) - first + np.where(first == 0, place if last is not None else 0, 0)
            more = np.concatenate([~start[1:], [False]])
            out = (at > 0) | more
            # which rows may have a partner: before them, or after
            tile = np.cumsum(start) - 1
            sizes = (tile << 33) + n
            reach = np.searchsorted(sizes, (tile << 33) + u, "right")  # sets of at most u
            most = np.maximum.accumulate((tile << 33) + u) - (tile << 33)
            end = np.minimum(reach, np.arange(m)) - 1
            before = (end >= first) & (most[np.maximum(end, 0)] >= n)
            inside = (tile > 0) | (last is None)
            inside &= (tile < tile[-1]) | (not more_to_come)
            out &= before | (reach > np.arange(m) + 1) | ~inside
            if last is not None and not waiting:
                out[0] = False
            partner, near = np.zeros(m, np.int64), np.zeros(m, bool)
            for back in range(1, min(NEIGHBOURS, m - 1) + 1):
                j = np.arange(back, m)
                ok = ~near[j] & (j - back >= first[j]) & (n[j - back] <= u[j]) & (n[j] <= u[j - back]) & (100 * n[j - back] >= percent * n[j])
                near[j[ok]], partner[j[ok]] = True, c[j[ok] - back]
            last, place, waiting = [t[-1], c[-1], n[-1], u[-1]], int(at[-1]), not out[-1]
            i = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(t[i]), pa.array(c[i]), pa.array(n[i].astype(np.int32)), pa.array(at[i]), pa.array(partner[i], mask=~near[i])], names=["t", "c", "n", "place", "before"])

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                x = pa.Table.from_batches(held)
                held, rows = [], 0
                yield from work([x.column(i).to_numpy() for i in range(4)], True)
        if rows:
            x = pa.Table.from_batches(held)
            yield from work([x.column(i).to_numpy() for i in range(4)], False)
        bt.release()

    parts = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = prefixes.repartition(parts, "t").sortWithinPartitions("t", "n", "c")
    return dealt.mapInArrow(run, "t long, c long, n int, place long, before long")


#: Bits of the filter that spares documents without a part in a pair; its size does not depend on the corpus.
FILTER = 1 << 22


def _filter(rows: DataFrame) -> np.ndarray:
    """Which remainders of th by FILTER occur in rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy() & (FILTER - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(FILTER // 8, np.uint8)
    # a few tasks: each sends one bitmap
    for row in rows.select("th").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return out


def _sets(docs: DataFrame, bits: np.ndarray, k: int, split: np.ndarray) -> DataFrame:
    """k, th, c, s (sorted shingle hashes) of the documents that pass the filter; of rows equal in k and th one a task."""
    sent = docs.sparkSession.sparkContext.broadcast((bits, split))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, split = sent.value
        wanted = np.unpackbits(bits).astype(bool)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            use = wanted[batch.column(1).to_numpy() & (FILTER - 1)]
            for i in np.flatnonzero(use).tolist():
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                use[i] = key not in seen
                seen.add(key)
            batch = batch.filter(pa.array(use))
            for s in bt.slices(batch.column(2)):
                part = batch.slice(s.first, s.count)
                h, n = shingle_sets(s, k)
                raw, cuts = h.astype("<u8").tobytes(), np.concatenate([[0], np.cumsum(n) * 8]).tolist()
                sets = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(class_ids(h, n, NAME_BITS, split)[0]), pa.array(sets, pa.binary())], names=["k", "th", "c", "s"])
        bt.release()

    return docs.select("k", "th", "text").mapInArrow(run, "k long, th long, c long, s binary")


def _bounds(n1: np.ndarray | int, n2: np.ndarray | int, g1: np.ndarray, g2: np.ndarray) -> np.ndarray:
    """The most elements that sets with these signatures can share: a bit that only one has is an element that only it has."""
    one = n1 - np.bitwise_count(g1 & ~g2).sum(axis=-1, dtype=np.int64)
    two = n2 - np.bitwise_count(g2 & ~g1).sum(axis=-1, dtype=np.int64)
    return np.minimum(one, two)


def _possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that signatures cannot exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 4))
            most = []
            for x, y, p, q in zip(na.tolist(), nb.tolist(), batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                words = min(len(p), len(q))
                most.append(_bounds(x, y, folded(p, words), folded(q, words)))
            ok = pa.array(np.array(most) >= needed(na, nb, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    left, right = (reps.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("g").alias(f"g{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "ga", "nb", "gb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int, split: np.ndarray, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of classes that are similar enough, by exact intersection of sorted arrays.

    The pairs of a class a meet in groups of about PARTNERS: its set comes first, those of its partners pass by.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("groups"))
    dealt = pairs.join(many, "a").select(F.col("a").alias("g"), F.pmod(F.hash("b"), F.col("groups")).alias("i"), "b")
    roles = dealt.select("g", "i", F.explode(F.array(F.struct(F.col("g").alias("c"), F.lit(0).alias("role")), F.struct(F.col("b").alias("c"), F.lit(1).alias("role")))).alias("x")).select("g", "i", "x.c", "x.role").distinct()
    where = scratch.keep(f"{name}-where", roles.join(reps.select("c", "k", "th"), "c"))
    rows = _sets(docs, _filter(where), k, split).join(where, ["k", "th", "c"]).select("g", "i", "role", "c", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = None  # the set of the group's class
        for batch in batches:
            found = []
            for g, role, c, s in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                y = np.frombuffer(s, "<u8")
                if role == 0:
                    x = y
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    found.append((g, c))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])
        bt.release()

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = rows.repartition(parts, "g", "i").sortWithinPartitions("g", "i", "role", "c")
    out = scratch.keep(name, together.mapInArrow(run, "a long, b long").distinct())
    scratch.drop(f"{name}-where")
    scratch.sweep()
    return out


def _across(runs: DataFrame, comp: DataFrame, reps: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """Pairs of classes of one tile and different components that bitmaps cannot exclude; with ``nearest`` only the likeliest partner of each class in each tile."""
    rows = runs.select("t", "c", "n", "place").join(comp.withColumnRenamed("node", "c"), "c", "left")
    rows = rows.withColumn("component", F.coalesce("component", "c"))
    # of tiles with the same members one is enough
    members = [F.count("*").alias("size"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("x1"), F.bit_xor(F.xxhash64("c", F.lit(2))).alias("x2")]
    mixed = rows.groupBy("t").agg(F.min("component").alias("x"), F.max("component").alias("y"), (F.floor(F.max("place") / TILE) + 1).cast("int").alias("blocks"), *members)
    mixed = mixed.filter("x != y").groupBy("size", "x1", "x2").agg(F.min(F.struct("t", "blocks")).alias("tile")).select("tile.*")
    rows = rows.join(mixed, "t").withColumn("block", F.floor(F.col("place") / TILE).cast("int"))
    one = rows.filter("blocks = 1").select("t", F.lit(0).alias("i"), F.lit(0).alias("j"), "block", "c", "n", "component")
    # a row meets the blocks of its tile that hold a set of a matching size and of another component
    several = rows.filter("blocks > 1")
    bands = several.groupBy("t", F.col("block").alias("other")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("component").alias("from"), F.max("component").alias("to"))
    fits = (100 * F.col("high") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("low")) & ((F.col("from") != F.col("component")) | (F.col("to") != F.col("component")))
    sent = several.join(bands, "t").filter(fits).select("t", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "c", "n", "component")
    rows = one.unionByName(sent).join(reps.select("c", F.col("small").alias("g")), "c").select("t", "i", "j", "block", "c", "n", "component", "g")

    def tile(c: np.ndarray, n: np.ndarray, comp: np.ndarray, g: list[bytes], block: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        words = signature_bits(n) // (64 * FOLD)
        # signatures of each length, and of twice that length folded: partners differ by no more
        place, table = {}, {}
        for w in np.unique(words).tolist():
            rows = np.flatnonzero((words == w) | (words == 2 * w))
            table[w] = np.stack([folded(np.frombuffer(g[r], np.uint64), w) for r in rows.tolist()])
            place[w] = np.full(len(c), -1)
            place[w][rows] = np.arange(len(rows))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for x in left.tolist():  # one row of the tile at a time: memory stays that of a block
            y = right[right > x] if i == j else right
            y = y[(comp[y] != comp[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
            shorter = np.minimum(words[y], words[x])
            most = np.empty(len(y), np.int64)
            for w in np.unique(shorter).tolist():
                z = shorter == w
                most[z] = _bounds(n[x], n[y[z]], table[w][place[w][x]], table[w][place[w][y[z]]])
            spare = most - needed(n[x], n[y], percent)
            y = y[spare >= 0]
            if nearest and len(y):
                y = y[[np.argmax(spare[spare >= 0])]]
            found.append((np.full(len(y), c[x]), c[y]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = (np.concatenate(z) for z in zip(*found, strict=True))
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(x: pa.Table) -> Iterator[pa.RecordBatch]:
            t, i, j, block, c, n, comp = (x.column(m).to_numpy() for m in range(7))
            n = n.astype(np.int64)
            g = x.column(7).to_pylist()
            cut = np.flatnonzero((t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            pairs: set[tuple[int, int]] = set()
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(t)], strict=True):
                a, b = tile(c[lo:hi], n[lo:hi], comp[lo:hi], g[lo:hi], block[lo:hi], int(i[lo]), int(j[lo]))
                pairs.update(zip(a.tolist(), b.tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

        yield from in_groups(batches, ["t", "i", "j"], work)
        bt.release()

    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "t", "i", "j").sortWithinPartitions("t", "i", "j", "n", "c")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def in_groups(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], rows: int = 4 * TILE) -> Iterator[pa.RecordBatch]:
    """Call work on whole groups of sorted rows, several small ones at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            change = np.zeros(len(t) - 1, bool)
            for key in keys:
                v = t.column(key).to_numpy()
                change |= v[1:] != v[:-1]
            cut = np.flatnonzero(change)
            if len(cut):
                yield from work(t.slice(0, cut[-1] + 1))
                t = t.slice(cut[-1] + 1)
            held, size = t.to_batches(), len(t)
    if size:
        yield from work(pa.Table.from_batches(held).combine_chunks())


def _folded_signatures(reps: DataFrame) -> DataFrame:
    """reps with ``small``, the signature that tiles get."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = [folded(x, len(x) // FOLD).tobytes() for x in (np.frombuffer(g, np.uint64) for g in batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(small, pa.binary())], names=["c", "k", "th", "n", "g", "small"])

    return reps.select("c", "k", "th", "n", "g").mapInArrow(run, "c long, k long, th long, n int, g binary, small binary")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """k, th (keys of the row, see ``repeats.keyed``), doc_id, n_shingles, component_id (smallest doc_id reachable by links): one row per document.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text with fewer words than a shingle has one
    shingle, all its words; a text without words, or null, has none, links with nothing and is its own component.
    Repeated rows link with one another. A null doc_id counts as -2**63. An empty table gives an empty result. Texts of
    any length are taken whole, about 15 bytes of memory a byte beyond the first megabyte. Extra columns are not carried.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "jaccard")
    keyed = rp.keyed(docs).select("k", "th", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "text")
    first = scratch.keep("first", _classes(keyed, shingle))
    counts = _sketch(first.filter("page is not null").select("page", "counts"))
    member = first.filter("page is null").drop("page", "counts")
    # names that two sets share by chance: some two dozen among 3 * 10**10 documents
    split = np.array([r.c for r in member.groupBy("c").agg(F.min("d").alias("x"), F.max("d").alias("y")).filter("x != y").select("c").limit(MOST_SPLIT + 1).collect()], np.int64)
    if len(split) > MOST_SPLIT:
        raise RuntimeError("more sets share a name than chance explains")
    if len(split):
        member = member.withColumn("c", F.when(F.col("c").isin(split.tolist()), F.col("e")).otherwise(F.col("c")))
    runs = scratch.keep("runs", _runs(_prefixes(keyed, shingle, percent, counts, split), percent))
    chosen = member.filter("n > 0").groupBy("c").agg(F.min(F.struct("k", "th", "n", "g")).alias("r"))
    reps = scratch.keep("reps", _folded_signatures(chosen.select("c", "r.k", "r.th", "r.n", "r.g")))

    def links_of(pairs: DataFrame, name: str) -> DataFrame:
        possible = scratch.keep(f"{name}-possible", _possible(pairs, reps, percent))
        return _verified(possible, keyed, reps, shingle, percent, split, scratch, name)

    pairs = runs.filter("before is not null").select(F.least("c", "before").alias("a"), F.greatest("c", "before").alias("b")).distinct()
    links = links_of(pairs, "near")
    comp = scratch.keep("comp", components(links, scratch, "near-c"))
    # likeliest partners first: they bring most families together, so that few pairs are left between components
    links = links.unionByName(links_of(_across(runs, comp, reps, percent, nearest=True), "likely"))
    comp = scratch.keep("comp2", components(links, scratch, "likely-c"))
    rest = links_of(_across(runs, comp, reps, percent), "rest")
    scratch.drop("runs", "reps", "comp", "near-possible", "likely-possible", "rest-possible")
    if not rest.isEmpty():
        comp = scratch.keep("all", components(links.unionByName(rest), scratch, "far"))
    scratch.sweep()
    named = member.select("k", "th", "id", "c", "n").join(comp.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = named.filter("n > 0").groupBy("component").agg(F.min("id").alias("least"))
    named = named.join(least, "component", "left")
    return named.select("k", "th", F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


#: Names of sets that may be split; the list is sent to all tasks.
MOST_SPLIT = 10_000


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without near duplicates: of each component one row of its smallest doc_id stays (of rows that share it, the one of smallest text hash).

    Rows without words link with nothing and all stay; an empty table stays empty. Columns are those of docs, clashing
    names too. Rows that are equal in doc_id and text but not in other columns are copies: one of them stays.
    """
    found = near_duplicates(docs, shingle, percent)
    some, none = found.filter("n_shingles > 0"), found.filter("n_shingles = 0")
    first = some.groupBy("component_id").agg(F.min(F.struct("doc_id", "th", "k")).alias("x")).select("x.k", "x.th")
    rows_of = some.groupBy("k", "th").agg(F.count("*").alias("copies"))
    stay = first.join(rows_of, ["k", "th"]).unionByName(none.select("k", "th", F.lit(1).cast("long").alias("copies")).distinct())
    stay = Scratch(docs.sparkSession, "stay").keep("rows", stay)
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumns(rp.keys(F.col("row.doc_id").cast("long"), F.col("row.text").cast("string")))
    rows = keyed.join(stay, ["k", "th"])
    one = rows.filter("copies > 1").groupBy("k", "th").agg(F.first("row").alias("row"))
    return rows.filter("copies = 1").select("row.*").unionByName(one.select("row.*"))

