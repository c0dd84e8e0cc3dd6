"""Token-id files: tokenise, count, range-partition by document, code with rANS, read back.

Tokens are written once to the shared folder, as 16-bit numbers where the
vocabulary allows; one aggregation over all of them gives the shared table
(bounded by the vocabulary); a range shuffle puts documents in id order; tasks
code blocks, and Spark's own writer writes them.

White space ends a word for this tokenizer (it is only removed), so a word's
ids do not depend on its neighbours: it is encoded once per task run and its ids
are reused.  Words of Latin-1 letters are cut into pre-tokens with a mark after
each, and tiktoken merges them with the same vocabulary, in which the mark stands
for the end of a pre-token; other words go to the library.  Texts for which that
does not hold (file separators that Python counts as white space, special tokens
written out) are encoded whole.

Defined cases: null and empty texts have the end id only; null doc_ids come
first; rows equal in doc_id are each written, in no fixed order between them;
an empty table gives no blocks and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from . import rans
from .common import per_worker, slices, stored, text_of

#: Tokens of a block and blocks of a file; a longer document is a block of its own.
BLOCK_TOKENS = 1 << 18
BLOCKS_PER_FILE = 32
MEMO = 600_000
BREAKS = re.compile("[\x1c-\x1f]")
#: A pre-token of the tokenizer, for words of Latin-1 letters only.
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zªµºÀ-ÖØ-öø-ÿ]+|[0-9²³¹¼½¾]|[^0-9²³¹¼½¾A-Za-zªµºÀ-ÖØ-öø-ÿ]+")
#: Ends a pre-token, and stands between words.  A word that holds one of them, or a longer one, is left to the library.
MARK, BETWEEN, LONGEST = "\0", "\1", 400
IN_LIST = re.compile(PRETOKEN.pattern.replace("[^0-9", f"[^{BETWEEN}0-9") + f"|{BETWEEN}")


def merger(tokenizer: Tokenizer) -> tiktoken.Encoding | None:
    """The tokenizer's merges over bytes, ``MARK`` for the end of a word; none if ids do not follow the
    order of merges, or two tokens are the same bytes."""
    model = json.loads(tokenizer.to_str())["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level names show as they are
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    end, mark = model["end_of_word_suffix"], MARK.encode()
    merged = [model["vocab"]["".join(pair)] for pair in model["merges"]]
    ranks = {bytes(byte[c] for c in t.removesuffix(end)) + (mark if t.endswith(end) else b""): i for t, i in model["vocab"].items()}
    if merged != list(range(512, len(ranks))) or len(ranks) != len(model["vocab"]):
        return None
    return tiktoken.Encoding("words", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={})


def _latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class WordEncoder:
    """Ids of texts as bytes, word by word, by a tokenizer that drops white space.

    Words and pre-tokens seen are kept in two generations of bounded size; what is
    still in use moves from the old one to the new."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.dtype = "<u4" if self.tokenizer.get_vocab_size() > 1 << 16 else "<u2"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.fast = merger(self.tokenizer)
        self.between = self.fast.encode_single_token(BETWEEN + MARK) if self.fast else -1

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _pieces(self, new: list[str]) -> None:
        """Pre-tokens in one call; the library numbers them, so ids fall apart by number."""
        e = self.tokenizer.encode(" ".join(new), add_special_tokens=False)
        ids, word = np.array(e.ids, self.dtype), np.array(e.word_ids, dtype=np.int64)
        cut = np.searchsorted(word, np.arange(len(new) + 1))
        if word.size and word[-1] == len(new) - 1 and (np.diff(cut) > 0).all():
            data, at = ids.tobytes(), (cut * ids.itemsize).tolist()
            self.pieces.update((p, data[a:b]) for p, a, b in zip(new, at, at[1:]))
        else:
            self.pieces.update((p, self._whole(p)) for p in new)

    def _merged(self, new: list[str]) -> None:
        """Latin-1 words in one call; what stands between them is one token."""
        letters = [w for w in new if w.isalpha()]
        other = [w for w in new if not w.isalpha()]
        new = letters + other
        text = (MARK + BETWEEN + MARK).join([*letters, ""]).lower() + MARK.join([*IN_LIST.findall(BETWEEN.join([*other, ""]).lower()), ""])
        ids = np.array(self.fast.encode_ordinary(text), self.dtype)
        ends = np.flatnonzero(ids == self.between)
        data, size = ids.tobytes(), ids.itemsize
        self.words.update((w, data[a:b]) for w, a, b in zip(new, [0, *((ends + 1) * size).tolist()], (ends * size).tolist()))

    def learn(self, words: set[str]) -> None:
        if len(self.words) + len(words) > MEMO:
            self.old, self.words = self.words, {}
        if len(self.pieces) > MEMO:
            self.pieces = {}
        back = self.old
        self.words.update((w, back[w]) for w in words if w in back)
        new = [w for w in words if w not in back]
        if self.fast:
            fast = [w for w in new if len(w) <= LONGEST and MARK not in w and BETWEEN not in w and _latin(w)]
            if fast:
                self._merged(fast)
            new = [w for w in new if w not in self.words]
        plain = {w: PRETOKEN.findall(w.lower()) for w in new if _latin(w)}
        known = self.pieces
        fresh = list({p for ps in plain.values() for p in ps if p not in known})
        if fresh:
            self._pieces(fresh)
        self.words.update((w, known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps])) for w, ps in plain.items())
        other = [w for w in new if w not in plain]
        for w, e in zip(other, self.tokenizer.encode_batch(other, add_special_tokens=False) if other else ()):
            self.words[w] = self._bytes(e.ids)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        split = []
        for t in texts:
            if any(s in t for s in self.special) or BREAKS.search(t):
                split.append(None)
            else:
                split.append((t.lower() if _latin(t) else t).split())
        missing = set().union(*[ws for ws in split if ws]).difference(self.words)
        rest = self.words
        if missing:
            self.learn(missing)
            if rest is not self.words:
                rest = {**rest, **self.words}
        for t, ws in zip(texts, split):
            yield self._whole(t) if ws is None else b"".join(map(rest.__getitem__, ws))


def tokenise(documents: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids): ids little-endian, 2 or 4 bytes by vocabulary, end id appended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("words", path), lambda: WordEncoder(path))
        end = encoder._bytes([end_id])
        for b in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x + end for x in encoder.encode(b.column("text").to_pylist())], pa.binary())], ["doc_id", "ids"])

    return documents.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, ids binary")


def count_tokens(tokens: DataFrame, dtype: str, size: int) -> np.ndarray:
    """Uses of every id over all documents; the driver gets one row per id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in slices(batches, 2048):
            n += np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), dtype), minlength=size)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], ["t", "n"])

    got = tokens.select("ids").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("t").to_numpy()] = got.column("n").to_numpy()
    return out


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Blocks below ``path``/blocks in ascending doc_id order, the counts behind the shared table below ``path``/table."""
    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    tokens = stored(tokenise(documents, tokenizer, end_id), "tokens")
    dtype = "<u4" if Tokenizer.from_file(tokenizer).get_vocab_size() > 1 << 16 else "<u2"
    counts = count_tokens(tokens, dtype, size)
    spark = documents.sparkSession
    spark.createDataFrame(pa.table({"id": np.arange(size), "n": counts})).coalesce(1).write.parquet(f"{path}/table")
    table = rans.Table(counts)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        give = lambda: pa.RecordBatch.from_arrays([pa.array([rans.pack(table, held)], pa.binary())], ["value"])
        for b in slices(batches, 256):
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                t = np.frombuffer(ids, dtype)
                if held and n + t.size > BLOCK_TOKENS:
                    yield give()
                    held, n = [], 0
                held.append((doc_id, t))
                n += t.size
        if held:
            yield give()

    rows = tokens.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id")).mapInArrow(blocks, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", BLOCKS_PER_FILE).text(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    counts = spark.read.parquet(f"{path}/table").orderBy("id").toArrow().column("n").to_numpy()
    table = rans.Table(counts)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            before, out = 0, []
            for block in rans.unpack(table, b.column("content")[0].as_py()):
                for doc_id, t in block:
                    out.append((b.column("path")[0].as_py(), doc_id, before, t.size, zlib.crc32(t.astype("<u4").tobytes())))
                    before += t.size
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), *[pa.int64()] * 4])], ["path", "doc_id", "before", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/blocks").select("path", "content")
    docs = stored(files.mapInArrow(rows, "path string, doc_id long, before long, n_tokens long, ids_crc32 long"), "read-back")
    # one row per file: part number of the range partition, then the writer's file counter
    part = lambda p: F.regexp_extract("path", p, 1).cast("long")
    sizes = docs.groupBy("path").agg(F.sum("n_tokens").alias("n")).select("path", "n", part(r"part-(\d+)-[^/]*$").alias("p"), part(r"-c(\d+)\.[^/]*$").alias("c"))
    earlier = Window.orderBy("p", "c").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("path", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return docs.join(base, "path").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def rewrite(documents: DataFrame, path: str, tokenizer: str, end_id: int) -> DataFrame:
    write(documents, path, tokenizer, end_id)
    return read(documents.sparkSession, path)
