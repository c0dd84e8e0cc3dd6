"""Corpus pipeline: quality, near duplicates, benchmark leaks, personal data, tokens.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and is written as Parquet and read again before the next one.  All but the last
return the columns of ``documents``, with whatever further columns came in."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from orderloom.llm import bpe_chunks, decontaminate, ngram_join, pii, quality_fm
from orderloom.llm.common import stored, table

#: Word shingles of near duplicates and the least similarity of a link, in percent.
NEAR = ngram_join.Rule(width=5, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.7 or more)."""
    return quality_fm.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents, that with the least id; documents without words stay."""
    return ngram_join.one_per_component(docs, NEAR)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows; personal data in texts becomes marks such as [EMAIL], and n_chars follows."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, counts and digests of every text that is left."""
    return bpe_chunks.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("personal_data", personal_data), ("tokens", tokens)]

#: A trained classifier and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
