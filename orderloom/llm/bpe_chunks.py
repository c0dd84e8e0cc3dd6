"""Byte-level BPE with content-defined chunk reuse.

A rolling hash cuts texts into chunks, so equal passages give equal chunks
wherever they stand.  Chunk hashes are counted over all documents; a chunk that
occurs once is encoded where it is, a chunk that occurs more often is encoded
once for all and its ids are joined to the documents that hold it.  Cuts fall
anywhere, so the words around a join are encoded again from their text, from an
anchor on the left to one on the right, and wider until the chunks agree.

An anchor is a blank between two ASCII letters: the pre-tokenizer begins a
piece there whatever stands around it.

Texts of Latin letters go through tiktoken, which has the same vocabulary and
pieces; any other text, and any that holds a special token's string, through the
tokenizers library itself.  Documents without a shared chunk are encoded whole.

Ids travel as 16-bit numbers; ``token_ids`` gives the ids of every document, ``decode`` their text; ``encode``
adds digests of both to the ids.

Defined cases: null and empty texts have no ids and the digests of empty input;
repeated rows each get their row; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .common import bitset, fingerprint, in_bitset, per_worker, slices, stored, text_of

WINDOW = 48
LEAST, MOST = 256, 8192
CUT_BITS = 10
SHARED_BITS = 24
P = 0xD6E8FEB86659FD93
#: Ids between tasks; the vocabulary has 50,257.
DTYPE = "<u2"
ANCHOR = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")
#: Fixed value: the tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
IDS = "doc_id long, ids array<int>"


def _powers(n: int, cache: list[np.ndarray] = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if not cache or cache[0].size <= n:
        with np.errstate(over="ignore"):
            cache[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(8192, 2 * n), p, np.uint64))]) for p in (P, pow(P, -1, 1 << 64))]
    return cache[0], cache[1]


def chunks(data: bytes) -> list[bytes]:
    """Content-defined chunks of UTF-8 text, cut between characters: at least LEAST
    bytes, at most about MOST where the content gives no cut."""
    n = len(data)
    if n <= LEAST + WINDOW:
        return [data] if data else []
    b = np.frombuffer(data, np.uint8)
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n])])
        h = (total[WINDOW:] - total[:-WINDOW]) * down[: n - WINDOW + 1]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    whole = (b & 0xC0) != 0x80  # a character starts here
    at = np.flatnonzero((h[:-1] >> np.uint64(64 - CUT_BITS)) == 0) + WINDOW
    cuts, last = [], 0
    for c in [*at[whole[at]].tolist(), n]:
        while c - last > MOST:
            last += MOST
            while not whole[last]:
                last -= 1
            cuts.append(last)
        if c - last >= LEAST and c < n:
            cuts.append(c)
            last = c
    return [data[i:j] for i, j in zip([0, *cuts], [*cuts, n])]


def key_of(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


#: Beyond these letters tiktoken is not asked.
WIDE = re.compile("[^\x00-\u024f]")


class Codec:
    """Ids of UTF-8 text and back, as the tokenizers library gives them."""

    def __init__(self, json_path: str, ranks_path: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(json_path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t: i for t, i in special.items() if i not in ranks.values()})
        self.special = [t.encode() for t in special]
        self.lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for t, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.lengths[i] = len(t)
        self.json_path, self.loaded = json_path, None

    @property
    def full(self) -> Tokenizer:
        """The library itself, loaded when a text needs it."""
        if self.loaded is None:
            self.loaded = Tokenizer.from_file(self.json_path)
            self.loaded.no_padding()
            self.loaded.no_truncation()
        return self.loaded

    def is_special(self, data: bytes) -> bool:
        return any(s in data for s in self.special)

    def encode(self, data: bytes) -> list[int]:
        text = data.decode("utf-8")
        if (text.isascii() or not WIDE.search(text)) and not self.is_special(data):
            return self.fast.encode_ordinary(text)
        return self.full.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> bytes:
        return self.fast.decode_bytes(ids)

    def offset(self, ids: list[int], at: int) -> int | None:
        """How many ids make the first ``at`` bytes; None if no id ends there."""
        n = i = 0
        while n < at:
            n += int(self.lengths[ids[i]])
            i += 1
        return i if n == at else None

    def offset_back(self, ids: list[int], size: int, at: int) -> int | None:
        """The same, counted from the end of ``size`` bytes."""
        n, i = size, len(ids)
        while n > at:
            i -= 1
            n -= int(self.lengths[ids[i]])
        return i if n == at else None


def _first_anchors(part: bytes, k: int) -> list[int]:
    out, m = [], ANCHOR.search(part)
    while m and len(out) < k:
        out.append(m.start())
        m = ANCHOR.search(part, m.end())
    return out


def _last_anchors(part: bytes, k: int) -> list[int]:
    """The last k anchors, nearest the end first."""
    reach = 64 * k
    while True:
        lo = max(0, len(part) - reach)
        got = [m.start() for m in ANCHOR.finditer(part, lo)]
        if len(got) >= k or lo == 0:
            return got[::-1][:k]
        reach *= 4


def _joint(codec: Codec, left: bytes, left_ids: list[int], between: bytes, right: bytes, right_ids: list[int]) -> tuple[int, list[int], int] | None:
    """(ids of left to keep, new ids, first id of right to keep).  The window reaches one
    anchor further than what is replaced, and must give the chunks' own ids there;
    else it widens.  None if it never does."""
    depth = 1
    while True:
        ls, rs = _last_anchors(left, depth + 1), _first_anchors(right, depth + 1)
        if len(ls) >= depth and len(rs) >= depth:
            s, e = ls[depth - 1], rs[depth - 1]
            s2, e2 = ls[min(depth, len(ls) - 1)], rs[min(depth, len(rs) - 1)]
            i, i2 = codec.offset_back(left_ids, len(left), s), codec.offset_back(left_ids, len(left), s2)
            j, j2 = codec.offset(right_ids, e), codec.offset(right_ids, e2)
            if None not in (i, i2, j, j2):
                got = codec.encode(left[s2:] + between + right[:e2])
                a, z = i - i2, j2 - j
                if len(got) >= a + z and got[:a] == left_ids[i2:i] and got[len(got) - z:] == right_ids[j:j2]:
                    return i, got[a:len(got) - z], j
        if len(ls) <= depth and len(rs) <= depth:
            return None
        depth *= 2


def assemble(codec: Codec, parts: list[tuple[bytes, list[int]]]) -> list[int]:
    """Ids of the whole text from its chunks and their own ids."""
    if len(parts) == 1:
        return parts[0][1]
    out: list[int] = []
    held: tuple[bytes, list[int]] | None = None  # last chunk with an anchor; its first ``skip`` ids are done
    skip, between = 0, b""
    for part, ids in parts:
        if ANCHOR.search(part) is None:
            between += part
            continue
        if held is None:
            e = _first_anchors(part, 1)[0]
            j = 0 if not between else codec.offset(ids, e)
            if j is None:
                return codec.encode(b"".join(p for p, _ in parts))
            if between:
                out += codec.encode(between + part[:e])
            skip = j
        else:
            joint = _joint(codec, *held, between, part, ids)
            if joint is None or joint[0] < skip:
                return codec.encode(b"".join(p for p, _ in parts))
            out += held[1][skip:joint[0]]
            out += joint[1]
            skip = joint[2]
        held, between = (part, ids), b""
    if held is None:
        return codec.encode(between)
    part, ids = held
    if not between:
        return out + ids[skip:]
    s = _last_anchors(part, 1)[0]
    i = codec.offset_back(ids, len(part), s)
    if i is None or i < skip:
        return codec.encode(b"".join(p for p, _ in parts))
    return out + ids[skip:i] + codec.encode(part[s:] + between)


def chunk_keys(docs: DataFrame) -> DataFrame:
    """(h): half a key of every chunk of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h = [short(key_of(c)) for t in b.column("text").to_pylist() for c in chunks(t.encode())]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64())], ["h"])

    return docs.select("text").mapInArrow(run, "h long")


def _codec(json_path: str, ranks_path: str) -> Codec:
    return per_worker(("codec", json_path, ranks_path), lambda: Codec(json_path, ranks_path))


def _binary(ids: list[int]) -> bytes:
    return np.array(ids, DTYPE).tobytes()


def binary_ids(documents: DataFrame, json_path: str, ranks_path: str) -> DataFrame:
    """(doc_id, ids), one row per document, ids as little-endian 16-bit numbers.

    One pass over the texts encodes documents without a shared chunk and cuts the
    others, which wait for the ids of shared chunks; both are stored."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("_fp", fingerprint("doc_id", "text"))
    shared = bitset(chunk_keys(docs).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "h", SHARED_BITS)
    names = ["doc_id", "_fp", "ids", "keys", "texts", "own"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.string()), pa.list_(pa.binary())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, given = _codec(json_path, ranks_path), set()  # keys whose text this task has sent already
        for b in slices(batches, 128):
            out = []
            if len(given) > 100_000:
                given.clear()
            for doc_id, fp, text in zip(*[b.column(c).to_pylist() for c in ("doc_id", "_fp", "text")]):
                data = text.encode()
                cs = [] if codec.is_special(data) else chunks(data)
                keys = [key_of(c) for c in cs]
                often = in_bitset(shared, np.array([short(k) for k in keys], np.int64)).tolist() if cs else []
                if any(often):
                    texts = [c.decode() if o and k not in given else None for c, k, o in zip(cs, keys, often)]
                    given.update(k for k, o in zip(keys, often) if o)
                    out.append((doc_id, fp, None, [k if o else None for k, o in zip(keys, often)], texts,
                                [None if o else _binary(codec.encode(c)) for c, o in zip(cs, often)]))
                else:
                    out.append((doc_id, fp, _binary(codec.encode(data)) if data else b"", None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, types)], names)

    table = stored(docs.mapInArrow(cut, "doc_id long, _fp long, ids binary, keys array<binary>, texts array<string>, own array<binary>"), "chunks", "zstd")
    wait = table.filter("ids IS NULL")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(json_path, ranks_path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([_binary(codec.encode(t.encode())) for t in b.column("text").to_pylist()], pa.binary())], ["key", "ids"])

    each = wait.select(F.explode(F.arrays_zip("keys", "texts")).alias("x")).filter("x.keys IS NOT NULL")
    known = each.groupBy(F.col("x.keys").alias("key")).agg(F.first("x.texts", ignorenulls=True).alias("text")).mapInArrow(once, "key binary, ids binary")
    row = F.coalesce("doc_id", F.lit(0).cast("long")).alias("_row")  # never null, so grouping and join share one exchange; _fp tells a null id from 0
    refs = wait.select(row, "_fp", F.posexplode("keys").alias("at", "key")).filter("key IS NOT NULL").distinct()
    found = refs.join(known, "key").groupBy("_row", "_fp").agg(F.collect_list(F.struct("at", "ids")).alias("got"))
    both = wait.select("doc_id", row, "_fp", "own").join(found, ["_row", "_fp"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(json_path, ranks_path)
        for b in slices(batches, 128):
            out = []
            for mine, got in zip(*[b.column(c).to_pylist() for c in ("own", "got")]):
                for g in got:
                    mine[g["at"]] = g["ids"]
                ids = [np.frombuffer(m, DTYPE).tolist() for m in mine]
                out.append(_binary(assemble(codec, [(codec.decode(i), i) for i in ids])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "ids"])

    return table.filter("ids IS NOT NULL").select("doc_id", "ids").unionByName(both.select("doc_id", "own", "got").mapInArrow(rest, "doc_id long, ids binary"))


def _lists(ids: list[bytes]) -> pa.ListArray:
    at = np.cumsum([0, *(len(i) // 2 for i in ids)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(ids), DTYPE).astype(np.int32)))


def token_ids(documents: DataFrame, json_path: str, ranks_path: str) -> DataFrame:
    """IDS, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(b.column("ids").to_pylist())], ["doc_id", "ids"])

    return binary_ids(documents, json_path, ranks_path).mapInArrow(run, IDS)


def decode(ids: DataFrame, json_path: str, ranks_path: str) -> DataFrame:
    """doc_id, ids and their text, of a table of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(json_path, ranks_path)
        for b in slices(batches, 128):
            text = [codec.decode(i or []).decode("utf-8", "replace") for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(text, pa.string())], ["doc_id", "ids", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, IDS + ", text string")


def encode(documents: DataFrame, json_path: str, ranks_path: str) -> DataFrame:
    """doc_id, ids, n_tokens and digests of the ids and of the text decoded from them, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(json_path, ranks_path)
        for b in slices(batches, 128):
            data, out = b.column("ids").to_pylist(), []
            for ids in data:
                each = np.frombuffer(ids, DTYPE).tolist()
                text = codec.decode(each).decode("utf-8", "replace")
                out.append((len(each), hashlib.sha256(",".join(map(str, each)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(data), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()))]], ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    return binary_ids(documents, json_path, ranks_path).mapInArrow(run, IDS + ", n_tokens long, ids_sha256 string, decoded_sha256 string")
