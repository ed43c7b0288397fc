"""Tables as immutable versions behind a pointer, for stores where a directory cannot be replaced at once.

A version is a folder of its own that is never changed. It counts from when an empty file of its name is there in ``current``, which
is one create; no directory is renamed or copied, so it is the same on an object store. Readers take the last name: there is always one
whole table, through any publication and after a crash at any step of one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.sinks import _fs, delete


class Versions:
    """A table under ``root``. Publications at the same time are all whole; the last name wins."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(root).rstrip("/")

    def _names(self, kind: str) -> list[str]:
        fs, folder = _fs(self.spark, f"{self.root}/{kind}")
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(folder)) if not n.startswith((".", "_"))) if fs.exists(folder) else []

    def publish(self, df: DataFrame, by: Sequence[str] = ()) -> str:
        """Write df as a new version (in folders ``by`` columns, if given) and point to it; returns its folder."""
        names = self._names("current")
        number = int(names[-1].split("-")[0]) + 1 if names else 1
        name = f"{number:012d}-{uuid.uuid4().hex}"
        place = f"{self.root}/versions/{name}"
        (df.write.partitionBy(*by) if by else df.write).parquet(place)
        fs, pointer = _fs(self.spark, f"{self.root}/current/{name}")
        fs.create(pointer, False).close()
        return place

    def current(self) -> str:
        """The folder of the version that counts."""
        names = self._names("current")
        if not names:
            raise FileNotFoundError(f"no version of {self.root}")
        return f"{self.root}/versions/{names[-1]}"

    def read(self) -> DataFrame:
        """The version that counts now; it stays readable until it is expired."""
        return self.spark.read.parquet(self.current())

    def expire(self, keep: int = 2) -> list[str]:
        """Delete all but the last ``keep`` versions, and folders that a broken publication before these left. Returns what is deleted."""
        if keep < 1:
            raise ValueError("the version that counts is kept")
        kept = self._names("current")[-keep:]
        gone = [n for n in self._names("versions") if kept and n not in kept and n < kept[0]]
        for n in gone:  # no reader begins with it from here on
            delete(self.spark, f"{self.root}/current/{n}")
        for n in gone:
            delete(self.spark, f"{self.root}/versions/{n}")
        return gone
