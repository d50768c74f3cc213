"""The queries of the operators, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekmill.llm import chat, exact_dedup, fingerprints, line_dedup, mixing, near_dedup, packing, quality, token_counts, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents found toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(_documents(spark, sf_dir), labels).filter("toxic")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, sf_dir)).select("doc_id", "source", "copy")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.corpus_containment(_documents(spark, sf_dir))


def op5_containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document contains which."""
    return fingerprints.corpus_pairs(_documents(spark, sf_dir))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).select("doc_id", "score", "keep")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir)).select("doc_id", "keeper_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_documents(spark, sf_dir), counts=True).select("doc_id", "text", "n_lines", "n_deleted")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir)).select("doc_id", "n_copies")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = chat.as_records(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.format_chat(records).select(F.col("id").alias("conv_id"), "turn", "role", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_mixing": op4_mixing,
    "op5_fingerprints": op5_fingerprints,
    "op5_containment_pairs": op5_containment_pairs,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_near_dedup": op7_near_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_chat_formatting": op10_chat_formatting,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mixing": mixing.ORACLE_SQL,
    "op8_line_dedup": line_dedup.ORACLE_SQL,
    "op9_exact_dedup": "SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY text",
    "op10_chat_formatting": chat.ORACLE_SQL,
}
