"""A training-data pipeline over ``documents``: the stages, and ``run``."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from graphweft.llm import decontamination, minhash, mixing, quality, tokenbin
from graphweft.llm.common import staged, table
from graphweft.llm.entry import tokenizer_path


def few_rows(stage: Callable) -> Callable:
    """``stage`` with few rows in a batch of those that go into Python, as a row is a whole text."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        return stage(spark, docs, sf_dir)

    return run_stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_filter(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture_sample(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenbin.token_output(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", few_rows(minhash_near_dedup)),
    ("benchmark_decontamination", few_rows(benchmark_decontamination)),
    ("source_mixing", source_mixing),
    ("token_ids", few_rows(token_ids)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
