"""Readers with a declared schema, and guards that fire before anything is changed."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from tidemark.functions.keys import require_columns

#: The part of a raw card-transaction file that is read; other columns stay in the file.
RAW_SCHEMA = T.StructType([T.StructField("TransactionID", T.LongType()), T.StructField("isFraud", T.IntegerType()), T.StructField("TransactionDT", T.LongType()), T.StructField("TransactionAmt", T.DoubleType()), *(T.StructField(c, T.DecimalType(18, 1)) for c in ("card1", "card2", "card5", "addr1", "D1"))])
FACT_SCHEMA = T.StructType([T.StructField("transaction_id", T.LongType()), T.StructField("uid", T.StringType()), T.StructField("event_ts", T.TimestampNTZType()), T.StructField("amount", T.DoubleType()), T.StructField("label", T.ShortType())])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def require_path(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(f"nothing at {path}")
    return str(path)


def read_csv(spark: SparkSession, path: str, columns: Iterable[str] | None = None, infer: bool = False) -> DataFrame:
    """A CSV file with a header. Columns of ``RAW_SCHEMA`` get its types by name, others are text, unless types are inferred (a second pass, for looking only)."""
    require_path(spark, path)
    reader = spark.read.option("header", True)
    if infer:
        df = reader.option("inferSchema", True).csv(path)
        if columns is not None:
            require_columns(df, columns)
        return df
    df = reader.csv(path)
    if columns is not None:
        require_columns(df, columns)
    kinds = {f.name: f.dataType for f in RAW_SCHEMA}
    return df.select(*(df[c].cast(kinds[c]).alias(c) if c in kinds else df[c] for c in df.columns))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """A stored fact table; reading never changes it."""
    return spark.read.schema(FACT_SCHEMA).parquet(require_path(spark, path))


def column_names(df: DataFrame) -> set[str]:
    """Known without running a job."""
    return set(df.columns)


def in_order(df: DataFrame, *keys: str) -> Iterator[Row]:
    """Rows in order, a partition at a time on the driver, the next one fetched meanwhile."""
    return df.orderBy(*keys).toLocalIterator(prefetchPartitions=True)
