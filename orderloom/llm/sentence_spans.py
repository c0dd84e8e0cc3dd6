"""Substring duplicates: sliding sentence spans.

Units are sentences: a word that ends with a mark of ``ENDS`` ends one.  A sentence of
over ``LONG`` words is cut further, so that a passage shared by two endless ones is
met as well: in every ``WINDOW`` consecutive words of it the one of the least hash
begins a unit, which depends on the words around it alone.  A span starts at every
unit and takes the fewest consecutive units with ``sentences`` units and ``words``
words.  A span's hash joins globally; every occurrence but the first, by (doc_id,
fingerprint, unit), loses its units.

Texts are cut once: each document's hashes are stored as one array, counted,
and filtered from there.  Only documents that lose something are cut again.

Defined cases: null and empty texts have no units; a text shorter than a span
loses nothing; rows equal in id and text are one document, so that copy removes
nothing from itself, and each row gets the same result; null ids sort first; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bitset, fingerprint, in_bitset, slices, stored, text_of

TOKEN = re.compile(r"\S+")
#: Which bytes end a sentence.
ENDS = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
LONG, WINDOW = 16, 7
SEEN_BITS = 26
P = 0x9E3779B97F4A7C15
SPANS = "doc_id long, _fp long, h long, i int, j int"
RESULT = "doc_id long, n_sentences int, n_removed int, removed_words int, removed string, kept string"


def _powers(n: int, cache: list[np.ndarray] = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if not cache or cache[0].size <= n:
        size = max(1024, 2 * n)
        with np.errstate(over="ignore"):
            cache[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, p, np.uint64))]) for p in (P, pow(P, -1, 1 << 64))]
    return cache[0], cache[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _polynomial(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of values[lo:hi] for all pairs, equal for equal runs wherever they stand."""
    up, down = _powers(values.size)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: values.size])])
        return _mixed((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def cut_words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(first word of every unit, hashes of all words)."""
    data = " ".join(text.lower().split()).encode("utf-8", "surrogatepass")
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    b = np.frombuffer(data, np.uint8)
    blank = np.flatnonzero(b == 32)
    lo, hi = np.concatenate([[0], blank + 1]), np.append(blank, b.size)
    h = _polynomial(b.astype(np.uint64) + np.uint64(1), lo, hi)
    n = h.size
    ends = ENDS[b[hi - 1]]
    ends[-1] = True
    sentence = np.cumsum(ends) - ends  # number of each word's sentence
    starts = np.flatnonzero(np.concatenate([[True], ends[:-1]]))
    long = np.diff(np.append(starts, n)) > LONG
    if not long.any():
        return starts, h
    inside = (sentence[WINDOW - 1:] == sentence[: n - WINDOW + 1]) & long[sentence[: n - WINDOW + 1]]
    m = n - WINDOW + 1
    best, place = h[:m].copy(), np.arange(m)
    for k in range(1, WINDOW):  # of equal ones the last
        lower = h[k:k + m] <= best
        np.copyto(best, h[k:k + m], where=lower)
        place[lower] = np.flatnonzero(lower) + k
    begins = np.zeros(n, bool)
    begins[starts] = True
    begins[place[inside]] = True
    return np.flatnonzero(begins), h


def units(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of every unit."""
    starts, words = [m.start() for m in TOKEN.finditer(text)], text.lower().split()
    if not words:
        return []
    at = [*cut_words(text)[0].tolist(), len(words)]
    place = [0, *(starts[k] for k in at[1:-1]), len(text)]
    return [(place[x], place[x + 1], words[at[x]:at[x + 1]]) for x in range(len(at) - 1)]


def spans(cuts: np.ndarray, words: np.ndarray, sentences: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of units) of the span at every unit that has one."""
    at = np.append(cuts, words.size)
    i = np.arange(cuts.size)
    end = np.maximum(i + sentences, np.searchsorted(at, cuts + least))
    end = end[end <= cuts.size]
    i = i[: end.size]
    # how the units divide the words is not hashed: the same words are the same passage
    return _polynomial(words, at[i], at[end]).view(np.int64) if i.size else np.empty(0, np.int64), end - i


def span_arrays(docs: DataFrame, sentences: int, least: int) -> DataFrame:
    """(doc_id, _fp, n, h, m): units, and the hash and number of units of the span at each unit that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, at, hs, ms = [], [0], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for text in b.column("text").to_pylist():
                cuts, words = cut_words(text)
                h, m = spans(cuts, words, sentences, least)
                n.append(cuts.size)
                at.append(at[-1] + h.size)
                hs.append(h)
                ms.append(m)
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_fp"), pa.array(n, pa.int32()), pa.ListArray.from_arrays(at, pa.array(np.concatenate(hs))),
                                              pa.ListArray.from_arrays(at, pa.array(np.concatenate(ms).astype(np.int32)))], ["doc_id", "_fp", "n", "h", "m"])

    return docs.select("doc_id", "_fp", "text").mapInArrow(run, "doc_id long, _fp long, n int, h array<long>, m array<int>")


def span_table(arrays: DataFrame, seen: np.ndarray) -> DataFrame:
    """SPANS whose hash the filter ``seen`` may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            lists = b.column("h")
            k = np.asarray(lists.value_lengths())
            h, m = np.asarray(lists.flatten()), np.asarray(b.column("m").flatten())
            row = np.repeat(np.arange(b.num_rows), k)
            i = np.arange(h.size) - np.repeat(np.cumsum(k) - k, k)
            keep = np.flatnonzero(in_bitset(seen, h))
            row = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), b.column("_fp").take(row), pa.array(h[keep]), pa.array(i[keep].astype(np.int32)),
                                              pa.array((i + m - 1)[keep].astype(np.int32))], [x.split()[0] for x in SPANS.split(", ")])

    return arrays.select("doc_id", "_fp", "h", "m").mapInArrow(run, SPANS)


def repeated(arrays: DataFrame) -> DataFrame:
    """(doc_id, _fp, cut): the runs of units that repeat an earlier span.

    Hashes are counted first; a filter of fixed size then lets only spans through
    that may occur again.  The first occurrence and the count are combined before
    the shuffle.  The join back is a plain equi-join, whose hot partitions Spark splits."""
    often = arrays.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    table = stored(span_table(arrays, bitset(often, "h", SEEN_BITS)), "sentence-spans")
    place = F.struct("doc_id", "_fp", "i")
    first = table.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(F.col("first") != F.col("last")).drop("last")
    first = stored(first, "first-spans")  # both sides of the join then come from scans
    again = table.join(first, "h").filter(F.col("first") != place)
    return again.groupBy("doc_id", "_fp").agg(F.collect_list(F.struct("i", "j")).alias("cut"))


def _kept(text: str, cut) -> tuple[str, list[tuple[int, int]], int, int, int]:
    """(text left, removed character spans, units, removed units, removed words)."""
    u = units(text)
    gone = np.zeros(len(u) + 1, np.int64)
    for c in cut or ():
        gone[c["i"]] += 1
        gone[c["j"] + 1] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    out, at, lost = [], 0, []
    for x in np.flatnonzero(gone):
        start, end, _ = u[x]
        if lost and lost[-1][1] == start:
            lost[-1] = (lost[-1][0], end)
        else:
            lost.append((start, end))
    for start, end in lost:
        out.append(text[at:start])
        at = end
    return "".join(out) + text[at:], lost, len(u), int(gone.sum()), sum(len(u[x][2]) for x in np.flatnonzero(gone))


def deduplicated(documents: DataFrame, sentences: int = 3, least: int = 24) -> DataFrame:
    """RESULT: one row per document; ``removed`` lists start:end in code points, ``kept`` is the text that is left."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("_fp", fingerprint("text"))
    arrays = stored(span_arrays(docs, sentences, least), "span-arrays")
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}._fp") == F.col(f"{b}._fp"))
    sizes = arrays.groupBy("doc_id", "_fp").agg(F.first("n").alias("n"))
    found = sizes.alias("s").join(repeated(arrays).alias("r"), same("s", "r"), "left").select("s.doc_id", "s._fp", "n", "cut")
    both = docs.alias("d").join(found.alias("f"), same("d", "f"), "left").select("d.doc_id", "text", "n", "cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for b in slices(batches):
            out = []
            for doc_id, text, n, cut in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "n", "cut")]):
                left, lost, n, gone, words = _kept(text, cut) if cut else (text, [], n, 0, 0)
                out.append((doc_id, n, gone, words, ",".join(f"{a}:{z}" for a, z in lost), left))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [x.split()[0] for x in RESULT.split(", ")])

    return both.mapInArrow(run, RESULT)


def report(documents: DataFrame, sentences: int = 3, least: int = 24) -> DataFrame:
    """What ``deduplicated`` gives, with a digest of the text that is left in its place."""
    return deduplicated(documents, sentences, least).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
