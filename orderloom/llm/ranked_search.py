"""Ranked lexical search: hybrid of term-at-a-time and document-at-a-time.

1. One pass over all texts keeps, per document, its length and the occurrences
   of terms that some query holds; this narrow table is stored.
2. One aggregation over it gives the number of documents, of terms, and each
   term's document frequency (the driver gets a row per query term).
3. Each task cuts its part of the table into segments, inverts a segment into
   lists with block maxima, and answers every query on it:
   the short lists are summed term at a time into accumulators, which then are
   one more list with block maxima; document at a time, blocks are visited in
   document order, and skipped where the maxima of the long lists and of the
   accumulators together stay below the k-th score so far.  What a task has
   found so far bounds its later segments.
4. Of all tasks' k best per query a window keeps k.

Queries come in blocks of at most ``ITEMS`` items and ``TERMS`` terms; the driver
holds one block.  Scores are whole numbers, so no order of summation matters.

Defined cases: null, empty and termless texts of documents match nothing and
count neither in N nor L; those of items have no results; repeated items (equal
id and text) are answered once, other items with a used id on their own;
repeated documents are ranked each; null doc_ids come last among equal scores,
null item_ids are an id; empty tables give an empty table; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import slices, stored, text_of

ITEMS, TERMS = 4096, 200_000
#: Postings of a segment, documents of a block, and how many postings a short list has at most.
SEGMENT, BLOCK, SHORT = 1_000_000, 64, 256
#: Term characters are a-z and 0-9 after lower-casing A-Z, and all of 128 and above.
TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
OCCURRENCES = "doc_id long, n long, t array<int>, f array<int>"
FOUND = "q int, item_id long, doc_id long, score long"


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TO_TERMS).split()


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """(item_id, distinct terms) of distinct items that have terms, block by block."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).distinct().orderBy("item_id", "text")
    block, size = [], 0
    for r in rows.toLocalIterator():
        ts = sorted(set(terms(r.text)))
        if block and (len(block) == ITEMS or size + len(ts) > TERMS):
            yield block
            block, size = [], 0
        if ts:
            block.append((r.item_id, ts))
            size += len(ts)
    if block:
        yield block


def occurrences(documents: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """OCCURRENCES of documents with at least one term: n of all terms, t and f of those in ``numbers``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.get
        for b in slices(batches):
            n, ends, ts, fs = [], [0], [], []
            for text in b.column("text").to_pylist():
                words = terms(text)
                t, f = np.unique(np.array([x for x in map(known, words) if x is not None], np.int32), return_counts=True)
                n.append(len(words))
                ts.append(t)
                fs.append(f)
                ends.append(ends[-1] + t.size)
            at = pa.array(ends, pa.int32())
            flat = lambda x: pa.ListArray.from_arrays(at, pa.array(np.concatenate(x).astype(np.int32)))
            if n:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), flat(ts), flat(fs)], ["doc_id", "n", "t", "f"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return docs.mapInArrow(run, OCCURRENCES).filter("n > 0")


def statistics(table: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(documents, all their terms, documents per query term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(n_terms + 2, np.int64)
        for b in slices(batches, 4096):
            count[0] += b.num_rows
            count[1] += np.asarray(b.column("n")).sum()
            count[2:] += np.bincount(np.asarray(b.column("t").flatten()), minlength=n_terms)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used])], ["at", "n"])

    got = table.select("n", "t").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_terms + 2, np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return int(out[0]), int(out[1]), out[2:]


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... (n[0] of them), lo[1], ..."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if x.size else np.zeros(0, np.int64)


class Best:
    """The k best (score, document) of a query: higher scores, then smaller ids, null ids last."""

    __slots__ = ("k", "score", "doc", "null")

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """A smaller score does not matter any more."""
        return max(1, int(self.score[-1])) if self.score.size == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        s, d, z = np.concatenate([self.score, score]), np.concatenate([self.doc, doc]), np.concatenate([self.null, null])
        top = np.lexsort((d, z, -s))[: self.k]
        self.score, self.doc, self.null = s[top], d[top], z[top]


class Segment:
    """Inverted lists of a run of documents, each by place, with its maximum per block."""

    def __init__(self, doc: np.ndarray, null: np.ndarray, m: np.ndarray, lengths: np.ndarray, t: np.ndarray, f: np.ndarray, w: np.ndarray):
        self.doc, self.null, self.blocks = doc, null, -(-doc.size // BLOCK)
        row = np.repeat(np.arange(doc.size), lengths)
        order = np.argsort(t, kind="stable")
        t, self.row, f = t[order], row[order], f[order].astype(np.int64)
        self.score = w[t] * ((1_000_000_000 * f) // (1000 * f + 8 * m[self.row]))
        self.at = np.searchsorted(t, np.arange(w.size + 1))
        start = _starts(t.astype(np.int64) * self.blocks + self.row // BLOCK)
        self.first = np.append(start, t.size)
        self.block = self.row[start] // BLOCK
        self.most = np.maximum.reduceat(self.score, start) if start.size else np.zeros(0, np.int64)
        self.entry = np.searchsorted(t[start], np.arange(w.size + 1))

    def accumulators(self, short: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, sums) over the short lists, term at a time."""
        p = _ranges(self.at[short], sizes)
        row, score = self.row[p], self.score[p]
        order = np.argsort(row, kind="stable")
        row, score = row[order], score[order]
        start = _starts(row)
        return row[start], np.add.reduceat(score, start) if start.size else score

    def search(self, query: np.ndarray, best: Best) -> None:
        sizes = self.at[query + 1] - self.at[query]
        few = sizes <= SHORT
        place, total = self.accumulators(query[few], sizes[few])
        # the accumulators as one list with block maxima
        start = _starts(place // BLOCK)
        cut = np.append(start, place.size)
        held = place[start] // BLOCK
        bound = np.zeros(self.blocks, np.int64)
        if start.size:
            bound[held] = np.maximum.reduceat(total, start)
        many = query[~few]
        entries = _ranges(self.entry[many], self.entry[many + 1] - self.entry[many])
        np.add.at(bound, self.block[entries], self.most[entries])
        if total.size >= best.k:  # a document's sum is at least its accumulator
            least = max(best.least(), int(np.partition(total, total.size - best.k)[total.size - best.k]))
        else:
            least = best.least()
        block_of = self.block[entries]
        live, at, step = np.flatnonzero(bound >= least), 0, 4
        while at < live.size:
            some = live[at:at + step]
            at, step = at + step, min(64, 2 * step)
            some = some[bound[some] >= max(least, best.least())]
            if not some.size:
                continue
            # every list and the accumulators move to these blocks
            dense = np.full(self.blocks, -1, np.int64)
            dense[some] = np.arange(some.size)
            sums = np.zeros(some.size * BLOCK, np.int64)
            e = entries[dense[block_of] >= 0]
            p = _ranges(self.first[e], self.first[e + 1] - self.first[e])
            np.add.at(sums, dense[self.row[p] // BLOCK] * BLOCK + self.row[p] % BLOCK, self.score[p])
            a = np.flatnonzero(dense[held] >= 0)
            p = _ranges(cut[a], cut[a + 1] - cut[a])
            sums[dense[place[p] // BLOCK] * BLOCK + place[p] % BLOCK] += total[p]
            hit = np.flatnonzero(sums >= max(least, best.least()))
            if hit.size:
                where = some[hit // BLOCK] * BLOCK + hit % BLOCK
                best.add(sums[hit], self.doc[where], self.null[where])


def best_of_tasks(table: DataFrame, items: list[tuple[int | None, np.ndarray]], w: np.ndarray, n_docs: int, n_all: int, k: int) -> DataFrame:
    """FOUND: the k best documents of every query among those of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]

        def settle(parts: list[pa.RecordBatch]) -> None:
            b = pa.Table.from_batches(parts).combine_chunks()
            doc, t, f = (b.column(c).combine_chunks() for c in ("doc_id", "t", "f"))
            n = b.column("n").to_numpy()
            segment = Segment(np.asarray(doc.fill_null(0)), np.asarray(doc.is_null()), 10 + (90 * n * n_docs) // n_all,
                              np.asarray(t.value_lengths()), np.asarray(t.flatten()), np.asarray(f.flatten()), w)
            for (_, query), mine in zip(items, best):
                segment.search(query, mine)

        held, size = [], 0
        for b in slices(batches, 2048):
            held.append(b)
            size += len(b.column("t").flatten())
            if size >= SEGMENT:
                settle(held)
                held, size = [], 0
        if held:
            settle(held)
        q = np.repeat(np.arange(len(items)), [x.score.size for x in best])
        if q.size:
            doc, null, score = (np.concatenate([getattr(x, c) for x in best]) for c in ("doc", "null", "score"))
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array([items[i][0] for i in q], pa.int64()), pa.array(doc, mask=null), pa.array(score)], ["q", "item_id", "doc_id", "score"])

    return table.mapInArrow(run, FOUND)


def search(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's k best documents with a score above 0."""
    spark = documents.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in item_blocks(items):
        numbers = {t: i for i, t in enumerate(sorted({t for _, ts in block for t in ts}))}
        queries = [(item, np.array([numbers[t] for t in ts], np.int64)) for item, ts in block]
        table = stored(occurrences(documents, numbers), "occurrences")
        n_docs, n_all, df = statistics(table, len(numbers))
        if not n_docs:
            break
        found = best_of_tasks(table, queries, weights(n_docs, df), n_docs, n_all, k)
        w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        out = out.unionByName(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    return out
