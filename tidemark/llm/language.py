"""Language identification with bit-sliced Bloom filters of n-grams.

One array of masks stands for a Bloom filter a language: bit l of a cell belongs to language l. The AND of an n-gram's
cells is the mask of all languages whose filter has it. Per document, the bits of each language are counted over all
n-grams, and the share is corrected for the filter's false positives: (share - f) / (1 - f).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import bytetext as bt
from .folds import held_out
from .scratch import small_batches

#: Cells of the filters, and cells of an n-gram.
CELLS, PROBES = 1 << 20, 2
#: Bytes of an n-gram: letters, and one space between words.
GRAM = 4
#: Documents per language that the filters are fitted on.
FITTED = 1500
#: An n-gram enters a language's filter if its rate is at least this share of its highest rate in any language.
CHARACTERISTIC = 0.25

#: Languages that may be broadcast.
BROADCAST_ROWS = 100_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def grams(s: bt.Slice) -> tuple[np.ndarray, np.ndarray]:
    """n-grams (as numbers) of all documents and the number of each document's."""
    data = bt.LOWER[s.data]
    if len(data):
        # capitals of the Latin-1 block, in UTF-8 after C3
        after = np.concatenate([[False], data[:-1] == 0xC3])
        data = np.where(after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97), data + np.uint8(0x20), data)
        data = np.where(_LETTER[data], data, np.uint8(0x20))
    # every document begins and ends with a space; runs of others are one space
    sizes = np.diff(s.offsets)
    padded = np.full(len(data) + 2 * s.count, 0x20, np.uint8)
    at = s.offsets[:-1] + 2 * np.arange(s.count)
    padded[bt.ragged(at + 1, sizes)] = data
    first = np.zeros(len(padded), bool)
    first[at] = True
    keep = (padded != 0x20) | np.concatenate([[True], padded[:-1] != 0x20])[: len(padded)] | first
    kept = padded[keep].astype(np.uint32)
    begin = np.concatenate([[0], np.cumsum(keep)])[np.append(at, len(padded))]
    count = np.maximum(np.diff(begin) - GRAM + 1, 0)
    g = np.zeros(max(len(kept) - GRAM + 1, 0), np.uint32)
    for x in range(GRAM):
        g = (g << np.uint32(8)) | kept[x : x + len(g)]
    return g[bt.ragged(begin[:-1], count)], count


class Filters:
    """Bit-sliced Bloom filters of several languages."""

    def __init__(self, languages: list[str], cells: int = CELLS, probes: int = PROBES):
        self.languages, self.cells, self.probes = languages, cells, probes
        self.masks = np.zeros(((len(languages) + 63) // 64 or 1, cells), np.uint64)

    def _places(self, g: np.ndarray) -> list[np.ndarray]:
        h = bt.mix(g.astype(np.uint64) + np.uint64(1))
        return [((h >> np.uint64(24 * i)) % np.uint64(self.cells)).astype(np.int64) for i in range(self.probes)]

    def add(self, language: int, g: np.ndarray) -> None:
        for place in self._places(g):
            self.masks[language // 64][place] |= np.uint64(1) << np.uint64(language % 64)

    def look(self, g: np.ndarray) -> np.ndarray:
        """Masks (words of 64 languages, n-grams)."""
        out = None
        for place in self._places(g):
            out = self.masks[:, place] if out is None else out & self.masks[:, place]
        return out

    def false_rates(self) -> np.ndarray:
        fill = [((self.masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.languages))]
        return np.array(fill) ** self.probes

    def shares(self, g: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Corrected shares (languages, documents), 0 to 1; 0 for a document without n-grams."""
        rates, hits = self.false_rates(), np.zeros((len(self.languages), len(count)), np.int64)
        ends = np.cumsum(count)
        for at in range(0, len(g), bt.STRIDE):
            part = g[at : at + bt.STRIDE]
            masks, doc = self.look(part), np.searchsorted(ends, np.arange(at, at + len(part)), "right")
            for i in range(len(self.languages)):
                bits = ((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(bool)
                hits[i] += np.bincount(doc[bits], minlength=len(count))
        share = hits / np.maximum(count, 1)
        return np.clip((share - rates[:, None]) / np.maximum(1 - rates[:, None], 1e-9), 0, 1)


def fit(docs: DataFrame, per_language: int = FITTED) -> Filters:
    """Filters from text and lang of rows that are not held out, at most ``per_language`` of each (lowest hashes; of equal rows one)."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # the rows of lowest hash by a threshold per language, found by a percentile: no language is sorted whole
    known = known.withColumn("h", F.xxhash64("doc_id", "text", F.lit(3))).withColumn("u", F.pmod("h", F.lit(1 << 30)).cast("long"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("m"))
    # one row a language, by which no row is dealt out, unless there are too many to send
    near = F.broadcast if sizes.count() <= BROADCAST_ROWS else lambda x: x
    few = known.join(near(sizes), "lang").filter(F.col("u") < F.lit(2.0 * per_language) / F.col("m") * (1 << 30) + 64 / F.col("m") * (1 << 30))
    # equal rows count once, however many there are
    rows = few.select("lang", "u", "h").distinct().withColumn("place", F.row_number().over(W.Window.partitionBy("lang").orderBy("u", "h"))).filter(F.col("place") <= per_language)
    sample = few.join(rows.select("lang", "h"), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in bt.slices(batch.column(1)):
                g, n = grams(s)
                langs = batch.column(0).slice(s.first, s.count).dictionary_encode()
                lang = np.repeat(langs.indices.to_numpy(), n).astype(np.uint64)
                keys, times = np.unique((lang << np.uint64(32)) | g, return_counts=True)
                names = langs.dictionary.take(pa.array((keys >> np.uint64(32)).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([names, pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(times)], names=["lang", "g", "n"])
        bt.release()

    table = sample.mapInArrow(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")).filter("n > 1").toArrow()
    lang, g, n = np.array(table.column("lang").to_pylist(), object), table.column("g").to_numpy(), table.column("n").to_numpy()
    # every language of the table is learnt, even one whose texts have no n-gram
    languages = sorted(r.lang for r in sizes.select("lang").collect())
    total = {x: max(1, int(n[lang == x].sum())) for x in languages}
    unique, at = np.unique(g, return_inverse=True)
    highest = np.zeros(len(unique))
    rates = n / np.array([total[x] for x in lang], float) if len(lang) else np.zeros(0)
    np.maximum.at(highest, at, rates)
    out = Filters(languages)
    for i, x in enumerate(languages):
        out.add(i, g[(lang == x) & (rates >= CHARACTERISTIC * highest[at])])
    return out


def identify(docs: DataFrame, filters: Filters, carry: list[str]) -> DataFrame:
    """row (struct of the ``carry`` columns), lang_pred, score (corrected share of the chosen language, 0 to 1): one row per document.

    Only the text is read. Null, empty and letterless texts are ``und`` with score 0, as is everything if no language
    was learnt. Equal shares go to the first language by code point. Repeated rows are rated alike; an empty table gives
    an empty result; extra columns matter only if carried. Texts of any length are taken whole, about 30 bytes of memory a
    byte beyond the first megabyte.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(filters)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col("text").cast("string").alias("text"))
    schema = rows.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = sent.value
        ascii_letter = _LETTER.copy()
        ascii_letter[0x80:] = False
        for batch in batches:
            for s in bt.slices(batch.column(1)):
                shares = filters.shares(*grams(s))
                sums = np.concatenate([[0], np.cumsum(ascii_letter[s.data])])
                letters = sums[s.offsets[1:]] > sums[s.offsets[:-1]]
                for d in np.flatnonzero(~letters & (np.diff(s.offsets) > 0)).tolist():
                    letters[d] = any(c.isalpha() for c in s.data[s.offsets[d] : s.offsets[d + 1]].tobytes().decode())
                if not filters.languages:
                    letters[:] = False
                best = shares.argmax(axis=0) if filters.languages else np.zeros(s.count, np.int64)
                names = [filters.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                score = np.where(letters, shares[best, np.arange(s.count)] if filters.languages else 0.0, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.count), pa.array(names, pa.string()), pa.array(score.astype(np.float64))], names=["row", "lang_pred", "score"])
        bt.release()

    return rows.mapInArrow(run, schema)
