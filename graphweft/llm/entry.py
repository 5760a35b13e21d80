"""Queries over the training-data operators, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontamination, exactdedup, linededup, lmscore, minhash, mixing, oracle, quality, spelling, suffixdedup, tokenbin, toxicity
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.repeats_removed(table(spark, sf_dir, "documents")).drop("kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_output(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.scores(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.injection_probe(spark))
    return chat.conversation_digests(chat.formatted_conversations(rows))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_report(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_report(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_toxicity": op2_toxicity,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_quality_rules": op4_quality_rules,
        "op5_token_ids": op5_token_ids,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_chat_formatting": op8_chat_formatting,
        "op9_mixing": op9_mixing,
        "op10_line_dedup": op10_line_dedup,
        "op11_exact_dedup": op11_exact_dedup,
        "op12_tokenizer_alignment": op12_tokenizer_alignment,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": oracle.CONTAMINATION,
        "op3_suffix_dedup": oracle.REPEATS,
        "op4_quality_rules": oracle.QUALITY,
        "op7_minhash_near_dedup": oracle.NEAR_DUPLICATES,
        "op9_mixing": oracle.MIXTURE,
        "op10_line_dedup": oracle.LINES,
        "op11_exact_dedup": oracle.COPIES,
        "op13_spelling_variants": oracle.SPELLING,
    }
