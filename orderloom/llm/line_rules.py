"""Quality rules with cross-document line frequency (DataFrame functions only).

Lines are normalised and hashed; a line standing in too many distinct documents
of one host is boilerplate.  ``without_boilerplate`` takes those lines out of the
documents that carry them; a document left with too little is rejected.

Defined cases: a null text is empty; a null source is the host ''.  Rows that
are equal in id, source and text are one document for the counts and each get
the same result row.  An empty or wordless text has zero counts, fails the base
rules and is not kept.  An empty table gives an empty table.  Columns other than
doc_id, text and source are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, fingerprint, text_of, unused

WINDOW = 8


@dataclass(frozen=True)
class Limits:
    """A line is boilerplate on its host in more than ``max_docs`` documents, or in
    more than ``min_docs`` documents and ``max_share`` of the host's.  A document
    is depleted with under ``min_words`` words or ``min_left`` of its words left."""

    max_docs: int = 30
    min_docs: int = 10
    max_share: float = 0.2
    min_words: int = 20
    min_left: float = 0.3


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACES, " ")))


def _covered(positions: Column) -> Column:
    """Words under windows that start at these ascending positions."""
    return F.aggregate(
        F.transform(positions, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(positions, i + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x)


def base_metrics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    base_failed to (doc_id, _fp, text); text goes, further columns stay.

    Repeated windows: window hashes are sorted with their positions, so equal
    ones are neighbours; nothing compares a window with all others."""
    d = docs.withColumns({"_w": words_of(F.col("text")), "_l": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    more = [c for c in docs.columns if c not in ("doc_id", "_fp", "text")]
    d = d.select("doc_id", "_fp", *more, "_w",
                 F.size("_w").cast("long").alias("n_words"), F.length(F.concat_ws("", "_w")).cast("long").alias("word_chars"),
                 F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                 (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"))
    d = d.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).drop("_w")
    d = d.withColumn("_v", F.when(F.size("_h") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_h", i, WINDOW))))).drop("_h")
    twice = F.size(F.array_distinct("_v")) < F.size("_v")
    d = d.withColumn("_s", F.when(twice, F.array_sort(F.transform("_v", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_v")
    same = lambda x, i: F.coalesce(F.get("_s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_s", i + 1)["h"] == x["h"], F.lit(False))
    d = d.withColumn("_p", F.array_sort(F.transform(F.filter("_s", same), lambda x: x["i"]))).drop("_s")
    d = d.withColumn("n_repeat_words", F.coalesce(_covered(F.col("_p")), F.lit(0).cast("long"))).drop("_p")
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def host_lines(docs: DataFrame) -> DataFrame:
    """(host, line, doc_id, _fp, words): a distinct normalised line of a document and its words there."""
    at = F.explode(F.filter(F.transform(F.split("text", "\n"), lambda x: F.struct(normal_line(x).alias("x"), F.size(words_of(x)).alias("n"))), lambda s: s["n"] > 0))
    rows = docs.select("doc_id", "_fp", "_host", at.alias("_at"))
    rows = rows.select(F.col("_host").alias("host"), F.xxhash64("_at.x").alias("line"), "doc_id", "_fp", F.col("_at.n").alias("words"))
    return rows.groupBy("host", "line", "doc_id", "_fp").agg(F.sum("words").alias("words"))


def boilerplate(lines: DataFrame, docs: DataFrame, limits: Limits) -> DataFrame:
    """(host, line, n_docs) above the limits; counts are combined before the shuffle."""
    hosts = docs.select("_host", "doc_id", "_fp").distinct().groupBy(F.col("_host").alias("host")).agg(F.count("*").alias("host_docs"))
    often = lines.groupBy("host", "line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > min(limits.min_docs, limits.max_docs))
    return often.join(hosts, "host").filter(
        (F.col("n_docs") > limits.max_docs) | ((F.col("n_docs") > limits.min_docs) & (F.col("n_docs") > limits.max_share * F.col("host_docs")))
    ).select("host", "line", "n_docs")


def _cleaned(documents: DataFrame, limits: Limits, left: str = "_left", removed: str = "_removed") -> DataFrame:
    """Every column of ``documents``, and ``left`` (the text without boilerplate lines; null
    counts as empty) and ``removed`` (how many distinct lines went).

    The join of lines with the boilerplate list is a plain equi-join, whose hot
    partitions Spark splits; a document then meets the hashes of its own lines."""
    docs = documents.select("doc_id", text_of().alias("text"), F.coalesce("source", F.lit("")).alias("_host"), fingerprint("source", "text").alias("_fp"))
    lines = host_lines(docs)
    cut = lines.join(boilerplate(lines, docs, limits), ["host", "line"]).groupBy("doc_id", "_fp").agg(F.collect_list("line").alias("_cut"))
    of, gone = unused(documents, "_of"), unused(documents, "_cut")
    c = cut.select(F.col("doc_id").alias("_id"), F.col("_fp").alias("_f"), F.col("_cut").alias(gone))
    d = documents.withColumn(of, fingerprint("source", "text"))
    out = d.join(c, d["doc_id"].eqNullSafe(c["_id"]) & (d[of] == c["_f"]), "left")
    rest = F.array_join(F.filter(F.split(text_of(), "\n"), lambda x: ~F.array_contains(gone, F.xxhash64(normal_line(x)))), "\n")
    n = F.greatest(F.coalesce(F.size(gone), F.lit(0)), F.lit(0)).cast("long")
    return out.select(*[d[c] for c in documents.columns], F.when(F.col(gone).isNull(), text_of()).otherwise(rest).alias(left), n.alias(removed))


def without_boilerplate(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The same rows and columns; boilerplate lines are taken out of ``text``.  A null text stays null."""
    left, removed = unused(documents, "_left"), unused(documents, "_removed")
    out = _cleaned(documents, limits, left, removed)
    return out.withColumn("text", F.when(F.col("text").isNotNull(), F.col(left))).select(*documents.columns)


def apply(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, the base metrics, removed_words, left_words, depleted and kept, the
    latter four from the text without boilerplate lines."""
    d = _cleaned(documents.select("doc_id", "source", "text"), limits)
    d = d.select("doc_id", fingerprint("source", "text").alias("_fp"), text_of().alias("text"), F.col("_removed").alias("removed_lines"),
                 F.size(words_of(F.col("_left"))).cast("long").alias("left_words"))
    out = base_metrics(d).drop("_fp").withColumn("removed_words", F.col("n_words") - F.col("left_words"))
    depleted = (F.col("left_words") < limits.min_words) | (F.col("left_words") < limits.min_left * F.col("n_words"))
    return out.withColumn("depleted", depleted).withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
