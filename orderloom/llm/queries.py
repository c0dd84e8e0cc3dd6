"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..plans.workdir import work_dir
from . import bpe_chunks, decontaminate, fill_in_middle, line_rules, ngram_join, pii, quality_fm, ranked_search, secret_scan, sentence_spans, token_files, toxicity, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they hold, with distance and place."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_fp")


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.rewrite(table(spark, sf_dir, "documents"), work_dir(spark, "token-files"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query
def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.apply(table(spark, sf_dir, "documents"))


@query
def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.report(table(spark, sf_dir, "documents"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, fold=1, threshold=0.7)


@query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"), ngram_join.Rule(width=3, percent=90)).drop("_fp", "first")


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.rewrite(table(spark, sf_dir, "pages"), work_dir(spark, "warc"), min_bytes=0).drop("url", "record_id")


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=4, fold=2, threshold=0.7)


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")).drop("ids")


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query
def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.report(table(spark, sf_dir, "documents"), fill_in_middle.Rule(seed=7, percent=100, spm=50))
