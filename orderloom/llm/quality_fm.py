"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

score = sigmoid(w0 + w.x + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)):
all pairwise interactions in time linear in the features.  It is fitted on a
bounded labelled sample; every document is then scored over its whole text.

Defined cases: null and empty texts have zero features, hence the score of the
intercept and the scaled statistics of an empty text; a missing, null or absent
n_chars counts as the text's own length; repeated rows get equal scores;
without labels of both kinds every score is the share of label 1 (0.5 without
labels); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices, text_of
from .labelled import held_out, sample

#: Bounds of what is learned: labelled rows, word buckets, rank.
SAMPLE_ROWS, BUCKETS, RANK = 6_000, 2_048, 8
EPOCHS, BATCH, RATE, RIDGE = 12, 64, 0.02, 1e-4
SYMBOL = re.compile(r"[#*$%&|<>]")
MARK = re.compile(r"[!?.,;:]")
DIGIT = re.compile(r"[0-9]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
STATS = 14


class Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return h


def structure(text: str, words: list[str], n_chars: int | None) -> list[float]:
    """Statistics of layout and repetition, each of moderate size."""
    n, c = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    uses = Counter(words)
    symbols, marks, digits, upper = (len(p.findall(text)) for p in (SYMBOL, MARK, DIGIT, UPPER))
    return [np.log1p(len(text)), np.log1p(len(words)), len(text) / n / 10, 10 * symbols / n, marks / n, 10 * digits / c, 10 * upper / c,
            text.count("!!") / n, len(uses) / n, uses.most_common(1)[0][1] / n if uses else 0.0, np.log1p(len(lines)),
            1 - len(set(lines)) / len(lines) if lines else 0.0, np.log1p(n / max(1, len(lines))), np.log1p(len(text) if n_chars is None else max(0, n_chars))]


def features(text: str, n_chars: int | None, known: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, their weights on the unit sphere, statistics)."""
    words = text.lower().split()
    uses = np.bincount(np.array([known[w] for w in words], np.int64), minlength=BUCKETS) if words else np.zeros(BUCKETS, np.int64)
    at = np.flatnonzero(uses)
    x = np.sqrt(uses[at])
    return at, x / (np.linalg.norm(x) or 1), np.array(structure(text, words, n_chars))


class Machine:
    """Parameters: BUCKETS + STATS weights and as many vectors of RANK, whatever the data."""

    def __init__(self, share: float):
        d = BUCKETS + STATS
        rng = np.random.default_rng(7)
        self.share, self.fitted = share, False
        self.w0, self.w, self.v = 0.0, np.zeros(d), rng.normal(0, 0.02, (d, RANK))
        self.mean, self.dev = np.zeros(STATS), np.ones(STATS)

    def row(self, at: np.ndarray, x: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((stats - self.mean) / self.dev, -4, 4) / 4
        return np.concatenate([at, np.arange(BUCKETS, BUCKETS + STATS)]), np.concatenate([x, z])

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.v[at]
        s = x @ v
        return float(self.w0 + x @ self.w[at] + 0.5 * (s @ s - (x * x) @ (v * v).sum(1)))

    def score(self, at: np.ndarray, x: np.ndarray, stats: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*self.row(at, x, stats)), -30, 30)))) if self.fitted else self.share

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray) -> Machine:
        """Adaptive gradient steps over shuffled batches; a rare label weighs more, up to threefold."""
        stats = np.array([r[2] for r in rows])
        self.mean, self.dev, self.fitted = stats.mean(0), stats.std(0) + 1e-6, True
        x = np.zeros((len(rows), BUCKETS + STATS), np.float32)
        for i, r in enumerate(rows):
            at, val = self.row(*r)
            x[i, at] = val
        rare = min(3.0, np.sqrt((1 - self.share) / max(self.share, 1e-9)) if self.share < 0.5 else np.sqrt(self.share / max(1 - self.share, 1e-9)))
        weight = np.where((y > 0) == (self.share < 0.5), rare, 1.0)
        rng = np.random.default_rng(11)
        g0, gw, gv = 1e-8, np.full(self.w.shape, 1e-8), np.full(self.v.shape, 1e-8)
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
                b = x[part].astype(np.float64)
                s = b @ self.v
                raw = self.w0 + b @ self.w + 0.5 * ((s * s).sum(1) - (b * b) @ (self.v * self.v).sum(1))
                err = weight[part] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / part.size
                d0, dw = err.sum(), b.T @ err + RIDGE * self.w
                dv = b.T @ (err[:, None] * s) - ((b * b).T @ err)[:, None] * self.v + RIDGE * self.v
                g0, gw, gv = g0 + d0 * d0, gw + dw * dw, gv + dv * dv
                self.w0 -= 5 * RATE * d0 / np.sqrt(g0)
                self.w -= 5 * RATE * dw / np.sqrt(gw)
                self.v -= RATE * dv / np.sqrt(gv)
        return self


def _length(name_present: bool) -> Column:
    return F.expr("try_cast(n_chars AS long)") if name_present else F.lit(None).cast("long")


def fit(documents: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, rows: int = SAMPLE_ROWS) -> Machine:
    picked = sample(documents, labels, "quality", folds, fold, rows)
    if "n_chars" in documents.columns:  # the metadata of the same rows
        meta = documents.select("doc_id", text_of().alias("text"), _length(True).alias("n_chars"))
        picked = picked.select("doc_id", "y").distinct().join(meta, "doc_id")
    else:
        picked = picked.withColumn("n_chars", F.lit(None).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets()
        for b in slices(batches):
            got = [features(t, n, known) for t, n in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.float64())),
                                              pa.array([g[2] for g in got], pa.list_(pa.float64()))], ["doc_id", "y", "at", "x", "stats"])

    got = picked.select("doc_id", "text", "n_chars", "y").mapInArrow(run, "doc_id long, y int, at array<long>, x array<double>, stats array<double>").toArrow().sort_by("doc_id")
    y = (got.column("y").to_numpy() > 0).astype(float)
    share = float(y.mean()) if y.size else 0.5
    machine = Machine(share)
    if not 0 < y.sum() < y.size:
        return machine
    rows_ = [tuple(np.asarray(c, t) for c, t in zip(r, (np.int64, float, float))) for r in zip(*[got.column(c).to_pylist() for c in ("at", "x", "stats")])]
    return machine.fit(rows_, y)


def score(documents: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    machine = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, folds, fold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = machine.value, Buckets()
        for b in slices(batches):
            s = [m.score(*features(t, n, known)) for t, n in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    out = documents.select("doc_id", text_of().alias("text"), _length("n_chars" in documents.columns).alias("n_chars")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = 0.7) -> DataFrame:
    """Documents, all columns as they are, without those that score below the threshold.

    The score is computed beside the row, so nothing is joined or shuffled."""
    machine = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, folds, fold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = machine.value, Buckets()
        for b in slices(batches):
            keep = [m.score(*features(t or "", k, known)) >= threshold for t, k in zip(b.column("text").to_pylist(), b.column(length).to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_())).select(names)

    names, length = documents.columns, "_n_chars"  # the length that ``score`` reads, beside the columns
    while length in names:
        length += "_"
    given = documents.withColumn(length, _length("n_chars" in names))
    return given.mapInArrow(run, documents.schema)
