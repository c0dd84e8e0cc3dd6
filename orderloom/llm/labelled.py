"""Labelled rows for the two classifiers: held-out rule and bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int) -> DataFrame:
    """(doc_id, text, y): at most ``rows`` labelled training rows, evenly by a hash of
    the id, so the sample is the same in every run.  Rows with a null label are no
    labels; of several labels of an id the greatest counts."""
    known = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return text.join(picked, "doc_id")
