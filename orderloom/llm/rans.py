"""Static range asymmetric numeral system over interleaved lanes.

A block codes token t in lane t % LANES; one step codes LANES tokens at once.
States are 64 bits, renormalised by 32-bit words.  A block carries its first
states, check-points (all states and the word position every CHECKPOINT steps,
so a reader may start there), and checksums of its body and of its tokens."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

LANES = 512
CHECKPOINT = 256
SCALE = 20
LOW = np.uint64(1 << 31)
MAGIC = b"RBLK"
HEAD = "<4sHHIIQIIII"
HEAD_BYTES = struct.calcsize(HEAD)


class Table:
    """Frequencies of symbols scaled to 2**SCALE, every used symbol at least 1."""

    def __init__(self, counts: np.ndarray):
        used = np.flatnonzero(counts)
        total = 1 << SCALE
        f = np.zeros(counts.size, np.int64)
        if used.size:
            if used.size > total // 2:
                raise ValueError("too many symbols for the frequency scale")
            c = counts[used].astype(np.float64)
            f[used] = np.maximum(1, np.floor(c * total / c.sum()).astype(np.int64))
            order = used[np.argsort(-counts[used], kind="stable")]
            short, at = total - int(f.sum()), 0
            while short:
                s = order[at % order.size]
                step = short if short > 0 else -min(-short, int(f[s]) - 1, max(1, int(f[s]) // 2))
                f[s] += step
                short -= step
                at += 1
        self.freq = f.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(f)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(counts.size, dtype=np.uint32), f)
        self.crc = zlib.crc32(f.astype("<u4").tobytes())


def encode(table: Table, tokens: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]], np.ndarray]:
    """(first states, check-points (step, words read before it, states), words)."""
    n = tokens.size
    steps = -(-n // LANES)
    x = np.full(LANES, LOW, np.uint64)
    words, marks, given = [], [], 0
    sb = np.uint64(SCALE)
    for step in range(steps - 1, -1, -1):
        part = tokens[step * LANES:(step + 1) * LANES]
        f, c = table.freq[part], table.start[part]
        y = x[: part.size]
        full = y >= f << np.uint64(63 - SCALE)
        if full.any():
            words.append((y[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            given += words[-1].size
            y[full] >>= np.uint64(32)
        q = y // f
        x[: part.size] = (q << sb) + (y - q * f) + c
        if step and step % CHECKPOINT == 0:
            marks.append((step, given, x.copy()))
    flat = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    return x, [(s, given - g, y) for s, g, y in marks[::-1]], flat


def decode(table: Table, n: int, x: np.ndarray, words: np.ndarray, step: int = 0, at: int = 0, stop: int | None = None) -> np.ndarray:
    """Tokens from ``step`` up to step ``stop``, the states being those of ``step``."""
    x = x.astype(np.uint64)
    steps = -(-n // LANES) if stop is None else stop
    out = np.empty(max(0, min(n, steps * LANES) - step * LANES), np.uint32)
    mask, sb = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for k in range(step, steps):
        m = min(LANES, n - k * LANES)
        y = x[:m]
        slot = y & mask
        s = table.symbol[slot.astype(np.int64)]
        y = table.freq[s] * (y >> sb) + slot - table.start[s]
        low = y < LOW
        need = int(np.count_nonzero(low))
        if need:
            y[low] = y[low] << np.uint64(32) | words[at:at + need].astype(np.uint64)
            at += need
        x[:m] = y
        out[(k - step) * LANES:(k - step) * LANES + m] = s
    return out


def pack(table: Table, docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """One block of whole documents (id, tokens)."""
    tokens = np.concatenate([t for _, t in docs]) if docs else np.zeros(0, np.uint32)
    x, marks, words = encode(table, tokens)
    body = b"".join([
        np.array([d or 0 for d, _ in docs], "<i8").tobytes(), np.array([d is None for d, _ in docs], "u1").tobytes(),
        np.array([t.size for _, t in docs], "<i8").tobytes(), x.astype("<u8").tobytes(),
        *[struct.pack("<II", s, at) + y.astype("<u8").tobytes() for s, at, y in marks], words.astype("<u4").tobytes()])
    head = struct.pack(HEAD, MAGIC, 1, LANES, table.crc, len(docs), tokens.size, words.size, len(marks), zlib.crc32(tokens.astype("<u4").tobytes()), zlib.crc32(body))
    return head + body


def _parts(head: tuple, body: memoryview) -> tuple:
    _, _, lanes, _, n_docs, _, n_words, n_marks, _, _ = head
    at = 0

    def take(dtype: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body, dtype, n, at)
        at += out.nbytes
        return out

    ids, null, sizes, x = take("<i8", n_docs), take("u1", n_docs), take("<i8", n_docs), take("<u8", lanes)
    marks = [(*take("<u4", 2).tolist(), take("<u8", lanes)) for _ in range(n_marks)]
    return ids, null, sizes, x, marks, take("<u4", n_words)


def unpack(table: Table, data: bytes) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Documents of every block of a file; each block's segments decode from their own
    check-points, and both checksums must hold."""
    at = 0
    while at < len(data):
        head = struct.unpack_from(HEAD, data, at)
        if head[0] != MAGIC or head[2] != LANES or head[3] != table.crc:
            raise ValueError("not a block of this table")
        n_docs, n, n_words, n_marks = head[4:8]
        size = 17 * n_docs + 8 * LANES + n_marks * (8 + 8 * LANES) + 4 * n_words
        body = memoryview(data)[at + HEAD_BYTES:at + HEAD_BYTES + size]
        if zlib.crc32(body) != head[9]:
            raise ValueError("block body is damaged")
        ids, null, sizes, x, marks, words = _parts(head, body)
        begin = [(0, 0, x), *marks]
        stops = [m[0] for m in marks] + [-(-n // LANES)]
        tokens = np.concatenate([decode(table, n, y, words, s, w, stop) for (s, w, y), stop in zip(begin, stops)])
        if zlib.crc32(tokens.astype("<u4").tobytes()) != head[8]:
            raise ValueError("block tokens are damaged")
        ends = np.cumsum(sizes)
        yield [(None if z else int(i), tokens[e - k:e]) for i, z, k, e in zip(ids, null, sizes, ends)]
        at += HEAD_BYTES + size + 1  # the writer's row separator
