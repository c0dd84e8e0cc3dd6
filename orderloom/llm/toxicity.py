"""Toxicity by nearest labelled examples: exact TF-IDF cosine on a block-max inverted index.

A term is the first four letters of a word (inflected words share them), its
weight the frequency in the text times log((2 N + 2) / (2 df + 1)).  The index
holds the vectors of all rows of a bounded labelled sample, whatever their
label, over all their terms; N and df are counted over all documents.  The
sample's vectors are cut into blocks; long lists keep their greatest weight per
block, short lists are summed, so a query bounds a whole block and opens only
blocks that could still change its nearest examples: the cosine is exact.  Votes
are weighted by distance, and calibrated on a quarter of the sample that does
not stand in the index.

Terms are 63-bit hashes.  Terms of a text that no example has are left out of
its vector.  Defined cases: null and empty texts, and texts without a known term,
have no neighbours and get the calibrated score of such examples; ties in cosine
go to the smaller example number; repeated rows get equal results; without
labels of both kinds all scores are the share of label 1 (0 without labels); an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import slices, text_of
from .labelled import held_out, sample

#: The first four letters of each word.
STEM = re.compile(r"([^\W\d_]{1,4})[^\W\d_]*")
#: Bound of what is learned: labelled rows.
SAMPLE_ROWS = 4_000
BLOCK, NEAREST = 64, 25
#: A list over a LONG-th of all examples is long; stems a task remembers.
LONG, MEMO = 8, 200_000
RESULT = "doc_id long, score double, evidence array<long>"


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... (n[0] of them), lo[1], ..."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Vocabulary:
    """Term counts of texts.  With ``keys`` (sorted hashes) terms are numbers of
    known ones, else hashes; what a stem stands for is remembered (-1: unknown)."""

    def __init__(self, keys: np.ndarray | None = None):
        self.keys = keys
        self.known: dict[str, int] = {}

    def _learn(self, stems: list[str]) -> None:
        h = np.array([xxhash.xxh3_64_intdigest(s) >> 1 for s in stems], np.int64)
        if self.keys is not None:
            at = np.minimum(np.searchsorted(self.keys, h), max(self.keys.size - 1, 0))
            h = np.where(self.keys[at] == h, at, -1) if self.keys.size else np.full(h.size, -1)
        self.known.update(zip(stems, h.tolist()))

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each text's terms begin and the last one's end, terms, how often)."""
        counted = [Counter(STEM.findall(t.lower())) for t in texts]
        if new := set().union(*counted).difference(self.known):
            if len(self.known) + len(new) > MEMO:
                self.known.clear()
                new = set().union(*counted)
            self._learn(list(new))
        known = self.known
        t = np.array([known[s] for c in counted for s in c], np.int64)
        n = np.array([n for c in counted for n in c.values()], np.int64)
        ends = np.concatenate([[0], np.cumsum(t >= 0)])[np.cumsum([0, *map(len, counted)])]
        return ends, t[t >= 0], n[t >= 0]

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(terms, how often)."""
        return self.batch([text])[1:]


class BlockMaxIndex:
    """Unit vectors of examples by term, cut at every BLOCK examples.

    Lists that hold a LONG-th of all examples are stored as whole columns, with
    their greatest weight in every block; the others are postings.  A query sums
    its short lists, which with the block maxima of its long lists bounds every
    block; long lists are read in blocks that can still change the result alone."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.blocks = -(-len(vectors) // BLOCK)
        rows = np.repeat(np.arange(len(vectors), dtype=np.int32), [t.size for t, _ in vectors])
        t = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        w = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        long = np.bincount(t, minlength=n_terms) * LONG >= max(len(vectors), 1)
        self.column = np.where(long, np.cumsum(long) - 1, -1)
        mine = long[t]
        self.long = np.zeros((self.blocks, BLOCK, int(long.sum())))
        self.long[rows[mine] // BLOCK, rows[mine] % BLOCK, self.column[t[mine]]] = w[mine]
        self.most = self.long.max(axis=1, initial=0.0)
        t, rows, w = t[~mine], rows[~mine], w[~mine]
        order = np.argsort(t, kind="stable")
        self.row, self.weight = rows[order], w[order]
        self.at = np.searchsorted(t[order], np.arange(n_terms + 1))

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, examples) of the k nearest with a positive cosine."""
        column = self.column[t]
        long = column >= 0
        q = np.zeros(self.most.shape[1])
        q[column[long]] = w[long]
        lo = self.at[t[~long]]
        n = self.at[t[~long] + 1] - lo
        p = _ranges(lo, n)
        short = np.bincount(self.row[p], np.repeat(w[~long], n) * self.weight[p], self.blocks * BLOCK).reshape(self.blocks, BLOCK)
        bound = short.max(axis=1, initial=0.0) + self.most @ q
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best_s, best_i, at, size = np.zeros(0), np.zeros(0, np.int64), 0, 4
        while at < order.size:  # a few blocks first, then ever more of those that may still matter
            some = order[at:at + size]
            if best_s.size == k:
                some = some[bound[some] >= best_s[-1] - 1e-11]
                if not some.size:
                    break
            score = np.concatenate([short[b] + self.long[b] @ q for b in some])
            where = (some[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            s, i = np.concatenate([best_s, score[score > 0]]), np.concatenate([best_i, where[score > 0]])
            if s.size > 4 * k:
                some = s >= np.partition(s, s.size - k)[s.size - k] - 1e-11
                s, i = s[some], i[some]
            top = np.lexsort((i, -np.round(s, 12)))[:k]
            best_s, best_i = s[top], i[top]
            at += size
            size *= 2
        return best_s, best_i


class Model:
    """Terms, weights, index, and calibration; its size is bounded by that of the sample."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, n_docs: int, rows: list[tuple[int, tuple, int]], apart: list[tuple[int, tuple, int]], default: float):
        self.keys = keys
        self.idf = np.log((2 * n_docs + 2) / (2 * df + 1))
        self.default, self.fit = default, None
        # Rows of one language share their commonest term, and so come to stand in the same blocks.
        kept = sorted(((int(c[0][np.argmax(c[1])]), c[0].size, doc, y, c) for doc, c, y in rows if c[0].size), key=lambda r: r[:4])
        self.y = np.array([r[3] for r in kept], float)
        self.ids = np.array([r[2] for r in kept], np.int64)
        self.index = BlockMaxIndex([self.vector(r[4]) for r in kept], keys.size)
        bare = [y for _, c, y in apart if not c[0].size]
        self.bare = (sum(bare) + default) / (len(bare) + 1)
        if 0 < default < 1:
            known = [(self.vote(*self.vector(c))[0], y) for _, c, y in apart if c[0].size]
            self.fit = _platt(np.array([v for v, _ in known]), np.array([y for _, y in known], float))

    def vector(self, c: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        w = c[1] * self.idf[c[0]]
        return c[0], w / np.linalg.norm(w)

    def vote(self, t: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Share of label 1 among the nearest, by weight; nearer counts more."""
        s, i = self.index.nearest(t, w, NEAREST)
        near = 1 / (1e-2 + np.arccos(np.clip(s, 0, 1)))
        return float((near @ self.y[i] + 0.5 * self.default) / (near.sum() + 0.5)) if s.size else self.default, i

    def score(self, c: tuple[np.ndarray, np.ndarray]) -> tuple[float, list[int]]:
        if self.fit is None:
            return self.default, []
        if not c[0].size:
            return self.bare, []
        v, i = self.vote(*self.vector(c))
        a, b = self.fit
        return float(1 / (1 + np.exp(-(a * _logit(v) + b)))), self.ids[i].tolist()


def _logit(v):
    v = np.clip(v, 1e-4, 1 - 1e-4)
    return np.log(v / (1 - v))


def _platt(votes: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic calibration of a vote, by Newton steps with a small ridge towards (1, 0)."""
    x, p = np.column_stack([_logit(votes), np.ones_like(votes)]), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ p))
        step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + np.eye(2), x.T @ (q - y) + (p - [1.0, 0.0]))
        p = p - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(p[0]), float(p[1])


def fit(documents: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, rows: int = SAMPLE_ROWS) -> Model:
    train = sample(documents, labels, "toxic", folds, fold, rows)
    apart = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary()
        for b in slices(batches):
            c = [words.counts(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([t for t, _ in c], pa.list_(pa.int64())), pa.array([n for _, n in c], pa.list_(pa.int32())), b.column("apart")], ["doc_id", "y", "t", "n", "apart"])

    got = train.withColumn("apart", apart).mapInArrow(counted, "doc_id long, y int, t array<long>, n array<int>, apart boolean").toArrow()
    doc, y, held = (got.column(c).to_numpy() for c in ("doc_id", "y", "apart"))
    examples = [(int(doc[i]), (t.values.to_numpy(), n.values.to_numpy()), int(y[i] > 0), bool(held[i])) for i, (t, n) in enumerate(zip(got.column("t"), got.column("n")))]
    examples.sort(key=lambda r: (r[0], r[1][0].tobytes(), r[1][1].tobytes()))
    keys = np.unique(np.concatenate([np.zeros(0, np.int64), *[c[0] for _, c, _, a in examples if not a]]))

    def numbered(c: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, c[0]), keys.size - 1)
        known = keys[at] == c[0] if keys.size else np.zeros(at.size, bool)
        return at[known], c[1][known].astype(float)

    examples = [(d, numbered(c), y, a) for d, c, y, a in examples]
    shared = documents.sparkSession.sparkContext.broadcast(keys)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = Vocabulary(shared.value), np.zeros(shared.value.size + 1, np.int64)
        for b in slices(batches):
            n[-1] += b.num_rows
            n[:-1] += np.bincount(known.batch(b.column("text").to_pylist())[1], minlength=n.size - 1)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], ["t", "n"])

    df = documents.select(text_of().alias("text")).mapInArrow(frequency, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(keys.size + 1, np.int64)
    n[df.column("t").to_numpy()] = df.column("n").to_numpy()
    share = sum(e[2] for e in examples) / len(examples) if examples else 0.0
    return Model(keys, n[:-1], int(n[-1]), [e[:3] for e in examples if not e[3]], [e[:3] for e in examples if e[3]], share)


def score(documents: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of the nearest examples, nearest first)."""
    model = fit(documents, labels, folds, fold)
    model = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        known = Vocabulary(m.keys)
        for b in slices(batches):
            ends, t, n = known.batch(b.column("text").to_pylist())
            got = [m.score((t[lo:hi], n[lo:hi])) for lo, hi in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s for s, _ in got], pa.float64()), pa.array([e for _, e in got], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    out = documents.select("doc_id", text_of().alias("text")).mapInArrow(run, RESULT)
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
