"""Passages removed from one new batch after another, against a named index that later sessions find again.

Beside the runs and anchors of ``lsm_dedup.FingerprintIndex`` the index keeps, per batch, the texts (verification needs
those of old batches too) and the repeated ranges that the batch made, in itself and in older documents. Only hashes that
a batch made repeats are looked at: their anchors, of all batches, and the texts that have one. A pair of equal windows is
found when the later of the two comes, so the ranges of all batches together are those of the whole corpus at once.

A batch counts from when its table of ranges is there, which is written last.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats as rp
from .lsm_dedup import FingerprintIndex, same_words
from .scratch import Scratch, small_batches


def _number(table: str) -> int:
    return int(table.rsplit("_", 2)[1])


class PassageIndex:
    """Documents that came in batches, and which of their words repeat.

    All tables are in the catalog under ``name``; an index opened under a name used before goes on where it was, in the same ``width``,
    ``gram`` and ``buckets`` (others are refused). A batch whose addition was broken off is taken out when the index is opened and can be added again.
    One session at a time may add. ``drop`` removes it.
    """

    def __init__(self, spark: SparkSession, name: str, width: int = 35, gram: int = 12, buckets: int = 64, fanout: int = 2):
        self.spark, self.unit = spark, rp.Unit(True, width, gram)
        self.index = FingerprintIndex(spark, name, buckets, fanout)
        self.name = self.index.name
        self._settings({"width": width, "gram": gram, "buckets": buckets})
        made: dict[str, dict[int, str]] = {"texts": {}, "ranges": {}}
        for row in spark.sql(f"SHOW TABLES LIKE '{self.name}_*'").collect():
            table = re.fullmatch(rf"{self.name}_(texts|ranges)_(\d+)_0", row.tableName)
            if table:
                made[table[1]][int(table[2])] = row.tableName
        self.batches = sorted(made["ranges"])
        for table in [a for a in self.index.anchors if _number(a) not in self.batches]:
            spark.sql(f"DROP TABLE {table}")
            self.index.anchors.remove(table)
        for table in [t for n, t in made["texts"].items() if n not in self.batches]:
            spark.sql(f"DROP TABLE {table}")

    def _settings(self, given: dict[str, int]) -> None:
        """Keep the settings with the index, or refuse others than those kept."""
        table = f"{self.name}_settings"
        if self.spark.catalog.tableExists(table):
            kept = self.spark.table(table).first().asDict()
            if kept != given:
                raise ValueError(f"the index {self.name} was made with {kept}")
        else:
            self.spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} int" for k in given)).coalesce(1).write.format("parquet").saveAsTable(table)

    def _all(self, kind: str, batches: list[int]) -> DataFrame:
        return reduce(DataFrame.unionByName, (self.spark.table(f"{self.name}_{kind}_{n}_0") for n in batches))

    def _write(self, df: DataFrame, kind: str, batch: int) -> None:
        df.write.format("parquet").option("compression", "zstd").saveAsTable(f"{self.name}_{kind}_{batch}_0")

    def add(self, new: DataFrame) -> DataFrame:
        """Add a batch of documents (doc_id, text); return its rows as ``remove_repeated_passages`` does, judged with all that came before.

        Nulls, ties, repeated rows and long texts are as there; a row that came before is a copy of it. An empty batch adds nothing.
        """
        small_batches(self.spark)
        scratch = Scratch(self.spark, "passages")
        docs = scratch.keep("new", rp.keyed(new))
        found = self.index.add(rp.anchors(docs, self.unit))
        batch = _number(self.index.anchors[-1])
        self._write(docs, "texts", batch)
        hits = scratch.keep("hits", found.distinct())
        # tables of their own, as in remove_repeated_passages
        often = scratch.keep("counts", self.index.counts(hits)).groupBy("h").agg(F.sum("m").alias("m"))
        candidates = scratch.keep("candidates", self.index.where(scratch.keep("often", often)))
        texts = self._all("texts", [*self.batches, batch])
        ranges = rp.match(rp.segments(texts, rp.salted(candidates), self.unit), self.unit, same_words, scratch.keep)
        # the first anchor of a copy is a repeat, so it is among the candidates
        self._write(ranges.unionByName(rp.copies(candidates)), "ranges", batch)
        self.batches.append(batch)
        scratch.drop("new", "hits", "counts", "often", "candidates", "found")
        self.index.compact()
        return self._cover(self._all("texts", [batch]))

    def _cover(self, docs: DataFrame) -> DataFrame:
        return rp.cover(docs, self._all("ranges", self.batches), self.unit)

    def revised(self) -> DataFrame:
        """Rows of the documents of earlier batches of which the latest batch repeats something, as they are now."""
        if not self.batches:
            raise ValueError("no batch was added")
        *earlier, last = self.batches
        docs = self._all("texts", earlier or [last])
        return self._cover(docs.join(self._all("ranges", [last]).select("k", "th"), ["k", "th"], "left_semi").filter(F.lit(bool(earlier))))

    def result(self) -> DataFrame:
        """Rows of all documents of all batches: what ``remove_repeated_passages`` gives of all at once."""
        if not self.batches:
            raise ValueError("no batch was added")
        return self._cover(self._all("texts", self.batches))

    def drop(self) -> None:
        for n in self.batches:
            for kind in ("texts", "ranges"):
                self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{kind}_{n}_0")
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_settings")
        self.index.drop()
        self.batches = []
