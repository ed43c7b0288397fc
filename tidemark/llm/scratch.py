"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Unset, a local master gets a temporary one; on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="shared-"))
    return shared_root(spark)


class Scratch:
    """Tables written once and read again, so that a lost executor costs no more than its own tasks.

    What is not dropped before is deleted when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"
        self._listed = False

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write df as Parquet and return the reader of the files."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        if not self._listed:
            fs, path = self._hadoop(self.root)
            fs.deleteOnExit(path)
            self._listed = True
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that are no longer read."""
        for name in names:
            fs, path = self._hadoop(self.path(name))
            fs.delete(path, True)

    def sweep(self) -> None:
        """Let Spark's cleaner take the shuffle files of finished steps: it looks at what the collectors of Python and the JVM have found."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Texts are long: cut the batches that Python gets by bytes as well as by rows.

    The setting must hold when the caller runs the lazy result, so it stays; a value of the caller's own is left alone.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, size)
