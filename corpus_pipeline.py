"""The corpus pipeline over ``documents``: quality, near duplicates, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns
the columns of ``docs``; the last one returns a row per document of the token files.  Null
texts count as empty; the second stage keeps rows without an id and one of exact repeats;
other columns pass through, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reapline.llm.common import shared_folder, table
from reapline.llm.decontaminate import drop_contaminated
from reapline.llm.mixing import mix
from reapline.llm.neardup import drop_near_duplicates
from reapline.llm.quality import keep_quality
from reapline.llm.queries import tokenizer_path
from reapline.llm.tokens import token_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return drop_near_duplicates(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to half as often again."""
    return mix(docs, max_repeats=1.5)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files, as read back."""
    return token_table(docs, tokenizer_path(), end_id=2)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_files", token_files)]

ORACLE_SQL = None  # a trained model and a tokenizer have no SQL; tests/llm holds brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
