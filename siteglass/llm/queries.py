"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, line_dedup, main_text, near_dup, packing, pii, quality, repeats, tokens, toxicity
from .common import table
from .oracle import ORACLE_SQL  # noqa: F401


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(table(spark, sf_dir, "documents"), line_dedup.Params(fold_short=True)))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.pii(table(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("clean_text")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(table(spark, sf_dir, "documents")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokens.write_files(table(spark, sf_dir, "documents"), vocabulary())
    return tokens.digest(tokens.read_files(spark, folder))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing operator on instruction data, where roles tell which tokens bear loss."""
    return packing.pack_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"), vocabulary())


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.digest(main_text.main_text(table(spark, sf_dir, "pages")))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_pii, op3_toxicity, op4_quality, op5_repeats, op6_decontamination, op7_token_files, op8_packing, op9_near_duplicates, op10_main_text, conversation_packing)}
