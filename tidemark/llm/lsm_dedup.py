"""Incremental substring deduplication over a log-structured index of window fingerprints.

The index is a list of immutable runs. A run has two tables. Its fingerprints: one row per anchor hash (see
``repeats``) with its count, bucketed and sorted by hash, so that runs are merge-joined bucket by bucket without a
shuffle; counts are added up before they are dealt out, so a hash that stands in a third of all windows is one row like
any other. And its anchors: where each hash stands, written as they come, without a shuffle. A new batch becomes a run
and is merge-joined with every older run: hashes that both have, or that the batch has twice, are repeats, and all
anchors of theirs, old and new, are candidates, verified word by word. Runs of one level are compacted into a run of
the next by merge-joining their fingerprints; anchors stay where they are.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats as rp
from .scratch import Scratch, small_batches


class FingerprintIndex:
    """Runs of fingerprints. ``fanout`` runs of a level become one of the next.

    All tables are in the catalog under ``name`` (lower case there); with a name given before and a catalog that outlives the
    session the index is found again as it was. A batch whose addition was broken off is not in it and can be added again.
    ``drop`` removes it.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = 64, fanout: int = 2):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.name = (name or f"fingerprints_{uuid.uuid4().hex}").lower()
        if not re.fullmatch("[a-z_][a-z0-9_]*", self.name):
            raise ValueError(f"not a plain name: {name!r}")
        self.runs: list[tuple[int, str]] = []  # level, table
        self.anchors: list[str] = []
        self._made = 0
        for row in spark.sql(f"SHOW TABLES LIKE '{self.name}_*'").collect():
            table = re.fullmatch(rf"{self.name}_(run|anchors|pending)_(\d+)_(\d+)", row.tableName)
            if table is None:  # of another index, whose name goes on
                continue
            self._made = max(self._made, int(table[2]) + 1)
            if table[1] == "run":
                self.runs.append((int(table[3]), row.tableName))
            elif table[1] == "anchors":
                self.anchors.append(row.tableName)
            else:
                spark.sql(f"DROP TABLE {row.tableName}")
        self.runs.sort(key=lambda r: (-r[0], r[1]))

    def _name(self, kind: str, level: int) -> str:
        self._made += 1
        return f"{self.name}_{kind}_{self._made - 1}_{level}"

    def _write_run(self, counts: DataFrame, level: int) -> str:
        """counts: h (once each), m; dealt out by h already, or to be."""
        table = self._name("run", level)
        counts.write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").option("compression", "zstd").saveAsTable(table)
        self.runs.append((level, table))
        return table

    def add(self, batch: DataFrame) -> DataFrame:
        """Index a batch of anchor rows; return the hashes (h) that it made repeats, or that were and are in it."""
        # the anchors get their name when the run is there: a run too many only makes more candidates, one too few loses repeats
        pending = self._name("pending", 0)
        batch.write.format("parquet").option("compression", "zstd").saveAsTable(pending)
        older = [t for _, t in self.runs]
        counts = self.spark.table(pending).groupBy("h").agg(F.count("*").alias("m"))
        new = self.spark.table(self._write_run(counts.repartition(self.buckets, "h"), 0))
        table = pending.replace(f"{self.name}_pending", f"{self.name}_anchors", 1)
        self.spark.sql(f"ALTER TABLE {pending} RENAME TO {table}")
        self.anchors.append(table)
        hits = new.filter("m > 1").select("h")
        for run in older:
            hits = hits.unionByName(new.select("h").hint("merge").join(self.spark.table(run).select("h"), "h"))
        return hits

    def compact(self) -> None:
        """Merge runs until no level has ``fanout`` of them."""
        while True:
            level = next((n for n, _ in self.runs if sum(m == n for m, _ in self.runs) >= self.fanout), None)
            if level is None:
                return
            old = [r for r in self.runs if r[0] == level]
            for run in old:
                self.runs.remove(run)
            merged = old[0][1]
            for _, table in old[1:]:
                both = self._write_run(_merged(self.spark.table(merged), self.spark.table(table)), level + 1)
                self.runs.pop()
                for done in (merged, table):
                    self.spark.sql(f"DROP TABLE {done}")
                merged = both
            self.runs.append((level + 1, merged))

    def counts(self, hashes: DataFrame) -> DataFrame:
        """h and m of the hashes (distinct) in each run: a hash of several runs has several rows."""
        return reduce(DataFrame.unionByName, (self.spark.table(t).join(hashes, "h") for _, t in self.runs))

    def where(self, hashes: DataFrame) -> DataFrame:
        """Anchor rows of the hashes (distinct), of all batches."""
        return self.all_anchors().join(hashes, "h")

    def all_anchors(self) -> DataFrame:
        return reduce(DataFrame.unionByName, map(self.spark.table, self.anchors))

    def drop(self) -> None:
        for table in [*(t for _, t in self.runs), *self.anchors]:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.runs, self.anchors = [], []


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs in one. Both are bucketed by h alike, so bucket meets bucket and nothing is shuffled."""
    both = a.hint("merge").join(b.withColumnRenamed("m", "m2"), "h", "full")
    return both.select("h", (F.coalesce("m", F.lit(0)) + F.coalesce("m2", F.lit(0))).alias("m"))


def same_words(buf: bytes, pos: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Class numbers of byte strings: equal where group and bytes are equal."""
    seen: dict[tuple[int, bytes], int] = {}
    out = np.empty(len(pos), np.int64)
    for x, (g, p, n) in enumerate(zip(group.tolist(), pos.tolist(), length.tolist(), strict=True)):
        out[x] = seen.setdefault((g, buf[p : p + n]), len(seen))
    return out


def remove_repeated_passages(docs: DataFrame, width: int = 35, gram: int = 12, batches: int = 4, buckets: int | None = None, fanout: int = 2) -> DataFrame:
    """Remove every word covered by a window of ``width`` words whose words also start anywhere else in the corpus.

    Words are runs of anything but ASCII white space. Documents enter the index in ``batches`` (by a hash of their
    id); hits reach back into older batches, so the result is that of the whole corpus at once and does not depend on
    the number of batches. A null text has no words. Repeated rows are copies of one another; texts shorter than
    ``width`` words and empty tables lose nothing; a text of any length is taken whole, about 20 bytes of memory a byte
    beyond the first megabyte. Returns doc_id, n_units (words), n_removed, spans, kept (binary: words joined by one
    space). Extra columns are not carried.
    """
    spark = docs.sparkSession
    small_batches(spark)
    unit = rp.Unit(True, width, gram)
    scratch = Scratch(spark, "lsm")
    docs = rp.keyed(docs)
    index = FingerprintIndex(spark, None, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    try:
        for b in range(batches):
            found = index.add(rp.anchors(docs.filter(F.pmod("k", F.lit(batches)) == b), unit))
            scratch.keep(f"hits{b}", found)
            index.compact()
        hits = scratch.read("hits0", found.schema)
        for b in range(1, batches):
            hits = hits.unionByName(scratch.read(f"hits{b}", found.schema))
        # tables of their own: sums over a union of bucketed tables cannot be trusted to be whole in Spark 4.1, and the
        # join may split a hot hash
        often = scratch.keep("counts", index.counts(hits.distinct())).groupBy("h").agg(F.sum("m").alias("m"))
        often = scratch.keep("often", often)
        scratch.drop("counts", *(f"hits{b}" for b in range(batches)))
        candidates = rp.salted(index.where(often))
        found = rp.match(rp.segments(docs, candidates, unit), unit, same_words, scratch.keep)
        ranges = scratch.keep("ranges", found.unionByName(rp.copies(index.all_anchors())))
    finally:
        index.drop()
    scratch.drop("found", "often")
    scratch.sweep()
    return rp.cover(docs, ranges, unit)
