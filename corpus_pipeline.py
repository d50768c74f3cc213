"""The corpus pipeline: quality filter, line dedup, near dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents; mixing emits a row for every copy of a document, packing gives the place of
every piece of every copy.

All stages take NULLs in any column, empty and very long texts (whole), repeated rows and an empty table, and keep columns of any name: quality judges rows one by
one, a NULL or empty text as one without words; line and near dedup leave rows without text alone, treat rows of equal id and text alike and
let the first of equal texts by (id, hash of the text) stay, NULL ids first; mixing takes NULL for a source of its own and draws for a
NULL id as for the string 'null'; packing gives no piece to texts without words. Ties: a score at the threshold stays, so does a similarity at the threshold link.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekmill.llm import line_dedup, mixing, near_dedup, packing, quality
from seekmill.llm.common import Scratch

#: Packing can't be expressed in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, rejects go. Without labels all stay."""
    return quality.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are cut; n_chars follows the text, and documents of which lines were cut and nothing is left go."""
    left = line_dedup.line_dedup(docs, counts=True).filter("n_deleted = 0 OR text <> ''")
    return left.drop("n_lines", "n_deleted").withColumn("n_chars", F.length("text").cast("bigint"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the first by (id, hash of the text); rows without words stay."""
    return near_dedup.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Smaller sources are repeated, towards weights of tokens ** 0.7; the largest is taken once, so nothing is lost."""
    return mixing.mix_sources(docs, copy_col=None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens; longer documents are cut into pieces, of which none is lost."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{n}_{name}")
        if n:
            scratch.drop(f"{n - 1}_{STAGES[n - 1][0]}")
    return docs
