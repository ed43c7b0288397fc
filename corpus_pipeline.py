"""A corpus from raw documents to token files: what is bad goes, copies go, benchmark passages go, sources are mixed, texts are encoded.

Every stage but the last returns the columns of its input, whatever their names; an empty table stays empty, and rows
repeated in all columns are rows of their own unless the stage says otherwise. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard_join, line_quality, mixing, token_files
from tidemark.llm.queries import vocabulary
from tidemark.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the quality rules and whose words are mostly content. Null and empty texts have no words and go."""
    field = line_quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_quality.rate_quality(docs, field, docs.columns, only_kept=True).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest doc_id. Repeated rows are copies; rows without words all stay; a null doc_id is the smallest."""
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark. Rows without words have none and stay; without a benchmark all stay."""
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), docs.columns)
    return found.filter(F.size("hits") == 0).select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the target weights of their sources ask for, none included. A null source is one of its own; rows without words come as often as is certain."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files of all rows hold: one row per document and copy, in order of doc_id, nulls first. A text without words or null is its end id alone."""
    return token_files.token_files(docs, vocabulary())


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID output", tokens),
]

#: No stage's method can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(f"stage{i}", stage(spark, docs, sf_dir))
        if i:
            scratch.drop(f"stage{i - 1}")
    return docs
