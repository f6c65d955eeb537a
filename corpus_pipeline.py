"""The corpus pipeline: language, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All
but the last return the columns of documents. Nulls, empty tables, repeated rows and further columns are handled as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import common, exact_dedup, language, packing, simhash, suffix_dedup, tokens


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; texts without letters and unrecognisable ones go."""
    return language.recognised(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that an earlier one, or an earlier part of the same, holds; n_chars follows the text."""
    cut = suffix_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))) if "n_chars" in cut.columns else cut


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    pieces = packing.pack(docs, tokens.vocabulary_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", F.expr("cast(octet_length(ids) / 4 as bigint)").alias("length"), "ids", "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("exact_copies", exact_copies), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("packing", packed)]
#: SQL can't express the stages (a learned model, fingerprints, byte strings, a tokenizer); tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
