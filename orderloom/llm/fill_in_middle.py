"""Fill-in-middle: whole lines move, so that a model learns to write what stands between.

A unit is a line with its line feed.  One full match of (unit)* in the regex
library keeps every repetition of its group, so ``ends(1)`` says at once how many
units a text has and where each ends; both cuts are read off that list.  Where
they fall, and the form, is decided by a digest of seed and doc_id alone: the
same row gives the same output wherever and however often it is computed.

Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is <S>suffix<P>prefix<M>middle,
``plain`` is the text itself.

Defined cases: null and empty texts are plain, with no units; so are texts that
hold one of the three marks, which could not be told from those put in; a cut at
the beginning or the end gives empty parts; rows equal in doc_id are cut alike
where they have as many units, and each gets its row; a null doc_id counts as an
empty one; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import slices, text_of

P, S, M = MARKS = ("<P>", "<S>", "<M>")
UNITS = r"([^\n]*\n|[^\n]+)*"
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
ROWS = 128


@dataclass(frozen=True)
class Rule:
    """``percent`` of the documents are cut at all, ``spm`` percent of those suffix first."""

    seed: int = 7
    percent: int = 100
    spm: int = 50

    def draws(self, doc_id: int | None) -> tuple[int, int, int, int]:
        h = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def rearranged(units: regex.Pattern, rule: Rule, doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of prefix and middle, output)."""
    ends = [0, *units.fullmatch(text).ends(1)]
    n = len(ends) - 1
    h1, h2, h3, h4 = rule.draws(doc_id)
    if not text or h3 % 100 >= rule.percent or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    a, b = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < rule.spm:
        return n, "spm", a, b - a, f"{S}{suffix}{P}{prefix}{M}{middle}"
    return n, "psm", a, b - a, f"{P}{prefix}{S}{suffix}{M}{middle}"


def transform(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """RESULT, one row per document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = regex.compile(UNITS)
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for b in slices(batches, ROWS):
            rows = [(d, *rearranged(units, rule, d, t)) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in RESULT.split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, RESULT)


def restored(output: str = "output", form: str = "form"):
    """The exact text behind an output: the parts between the marks, put back in order.
    No mark stands in a text that was cut, and a part that ends or begins with a
    piece of one does not make another."""
    part = F.split(F.col(output), "|".join(MARKS), -1)
    at = lambda i: F.get(part, F.lit(i))
    return (F.when(F.col(form) == "psm", F.concat(at(1), at(3), at(2))).when(F.col(form) == "spm", F.concat(at(2), at(3), at(1)))
            .otherwise(F.col(output)))


def report(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """What ``transform`` gives, with digests of the output and of the text restored from it in their place."""
    return transform(documents, rule).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                                             F.sha2(restored(), 256).alias("restored_sha256"))
