"""Benchmark decontamination by pigeonhole edit matching.

A test item of m normalised characters may be met with up to k = rate * m
character edits.  Cut into k + 1 pieces, at least one piece stands unedited in
any such match, so exact piece hits (one automaton pass over the whole text)
propose places, a q-gram count discards most of them, and Myers' bit-parallel
distance decides the rest.

Normalisation: words are runs of letters and digits, joined by one blank, in
lower case.  Items come in blocks of bounded size; the driver holds one block
at a time, and every document meets every block.

An item shorter than ``min_chars`` normalised characters would, with edits, be
met in passages that have nothing to do with it; it is looked for as it is, from
word bound to word bound.

Defined cases: null and empty texts match nothing; items without a letter or
digit (null and empty ones too) match nothing; repeated documents are each reported; repeated item
rows give one row each per item_id; an empty table on either side gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fingerprint, slices, text_of

WORD = re.compile(r"[^\W_]+")
Q = 3
HITS = "doc_id long, _fp long, item_id long, item_chars int, budget int, distance int, start int, end int"
#: Bounds of a block of items.
BLOCK_ITEMS, BLOCK_CHARS = 4096, 1 << 20


def normal(text: str) -> str:
    return " ".join(WORD.findall(text)).lower()


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    return [(j * m // (k + 1), (j + 1) * m // (k + 1)) for j in range(k + 1)]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(eq: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """(least distance of the pattern to a substring of ``text``, first end of one);
    ``anchored``: to a prefix of it."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(text, 1):
        e = eq.get(c, 0)
        xv = e | vn
        xh = (((e & vp) + vp) ^ vp) | e
        hp = (vn | ~(xh | vp)) & full
        hn = vp & xh
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 | anchored
        vp = ((hn << 1) | ~(xv | hp)) & full
        vn = hp & xv & full
        if score < best:
            best, end = score, i
    return best, end


class Items:
    """One block of test items, ready for matching."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int):
        self.items = []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            whole = len(text) < min_chars
            k = 0 if whole else int(rate * len(text))
            for lo, hi in pieces(len(text), k):
                found.setdefault(text[lo:hi], []).append((len(self.items), lo))
            grams = {text[i:i + Q] for i in range(len(text) - Q + 1)}
            self.items.append((item_id, text, k, masks(text), masks(text[::-1]), grams, whole))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def match(self, text: str) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(item_id, chars, budget, distance, start, end) of a normalised text: the first best place of each item met."""
        places: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for at, lo in where:
                places.setdefault(at, []).append(end - size + 1 - lo)
        for at, diagonals in places.items():
            item_id, item, k, eq, back, grams, whole = self.items[at]
            m, best = len(item), None
            if whole:  # its one piece is the item, so each place is an exact hit
                alone = [d for d in diagonals if text[d - 1:d] in ("", " ") and text[d + m:d + m + 1] in ("", " ")]
                if alone:
                    yield item_id, m, k, 0, min(alone), min(alone) + m
                continue
            for lo, hi in _windows(sorted(diagonals), m, k):
                part = text[max(0, lo):hi]
                exact = part.find(item)
                if exact >= 0:
                    got = (0, max(0, lo) + exact, max(0, lo) + exact + m)
                else:
                    common = sum(g in part for g in grams) if len(part) > 4 * m else len(grams & {part[i:i + Q] for i in range(len(part) - Q + 1)})
                    if common < len(grams) - k * Q:
                        continue
                    d, e = myers(eq, m, part)
                    if d > k:
                        continue
                    _, length = myers(back, m, part[max(0, e - m - k):e][::-1], True)
                    got = (d, max(0, lo) + e - length, max(0, lo) + e)
                if best is None or got < best:
                    best = got
            if best is not None:
                yield item_id, m, k, *best


def _windows(diagonals: list[int], m: int, k: int) -> Iterator[tuple[int, int]]:
    lo = hi = None
    for d in diagonals:
        if hi is not None and d - k <= hi - m:
            hi = d + m + k
            continue
        if hi is not None:
            yield lo, hi
        lo, hi = d - k, d + m + k
    if hi is not None:
        yield lo, hi


def _place(text: str, start: int, end: int) -> tuple[int, int]:
    """Positions in the text as it was of a span of its normalised form."""
    at, first, last = 0, None, 0
    for w in WORD.finditer(text):
        size = len(w.group().lower())
        if first is None and at + size > start:
            first = w.start() + min(start - at if start > at else 0, len(w.group()))
        if at < end:
            last = w.start() + min(end - at, len(w.group()))
        else:
            break
        at += size + 1
    return first or 0, last


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in bounded blocks, streamed to the driver."""
    held, chars = [], 0
    for row in benchmark.select("item_id", "text").distinct().toLocalIterator():
        text = normal(row.text or "")
        if not text:
            continue
        held.append((row.item_id, text))
        chars += len(text)
        if len(held) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def matches(documents: DataFrame, benchmark: DataFrame, rate: float = 0.08, min_chars: int = 24) -> DataFrame:
    """HITS: one row per document and item met within the budget, at its best place (code points of the text)."""
    docs = documents.select("doc_id", fingerprint("text").alias("_fp"), text_of().alias("text"))
    found = None
    for block in blocks(benchmark):
        part = docs.mapInArrow(_matcher(block, rate, min_chars), HITS)
        found = part if found is None else found.unionByName(part)
    return documents.sparkSession.createDataFrame([], HITS) if found is None else found


def _matcher(block: list[tuple[int, str]], rate: float, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(block, rate, min_chars)
        names = [x.split()[0] for x in HITS.split(", ")]
        types = [pa.int64()] * 3 + [pa.int32()] * 5
        for b in slices(batches):
            out = []
            for doc_id, fp, text in zip(*[b.column(c).to_pylist() for c in ("doc_id", "_fp", "text")]):
                for item_id, m, k, d, lo, hi in items.match(normal(text)):
                    out.append((doc_id, fp, item_id, m, k, d, *_place(text, lo, hi)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def clean(documents: DataFrame, benchmark: DataFrame, rate: float = 0.08, min_chars: int = 24) -> DataFrame:
    """Documents, all columns, without those that hold a test item: one pass over the
    rows per block of items, nothing is joined or shuffled."""

    def without(block: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(block, rate, min_chars)
            for b in slices(batches):
                yield b.filter(pa.array([next(items.match(normal(t or "")), None) is None for t in b.column("text").to_pylist()], pa.bool_()))

        return run

    for block in blocks(benchmark):
        documents = documents.mapInArrow(without(block), documents.schema)
    return documents
