"""Similarity join on word n-grams: rare-first prefixes, length, positional and suffix filters.

1. Document frequencies of words, folded into a table of fixed size, give every
   n-gram an expected frequency; n-grams that many documents of a task have, found
   in another such table, come after all others by their own frequency.  That is one
   order for all documents, rare first: what a member of a large group of near copies
   has alone fills its prefix before what the group shares.
2. A document's prefix, the first |x| - ceil(t|x|) + 1 n-grams in that order,
   must share an n-gram with the prefix of anything it links to.
3. Texts with one n-gram set are one class.  Prefix n-grams that occur once are
   dropped by a filter of fixed size; those of one class only are dropped next.
4. Each n-gram's postings first meet only their most central class, that which
   shares its prefix n-grams most widely (a star).  Verified links are joined
   into components.  Then classes of different components that share a prefix
   n-gram meet: all pairs that could still connect something, and none inside a
   group that already is one.  A semi-join keeps the postings that have any partner
   left, so it gives no more rows than it takes.  N-grams of at most ``CROWD`` of
   those make them meet directly: these pairs grow as the postings.  Classes of
   n-grams that more have are taken by themselves: all n-grams of theirs are counted,
   and prefixes in the order of these exact counts replace the estimated ones.  A
   passage that many texts share then stands at the end of each, and texts with
   enough of their own meet nobody.  The filters are part of the join condition, and
   a pair is verified once.  So links are representatives' links, and membership
   (``components``) says the rest.
5. To verify, texts of candidates go to blocks of pairs.  There are as many blocks
   as the candidates' n-grams need for a block to hold ``BLOCK_BYTES`` of them.

The suffix filter deals a set into 1024 parts by hash and keeps each part's
parity: every parity that differs stands for an n-gram in one set only, which
bounds the symmetric difference from below.  In the join it runs on 256 parts
(four merged into one), on the pairs that are left on all of them, and on pairs of
sets of more than 1024 n-grams then on as many parts as the smaller one has n-grams
or more, since 1024 parts of two long unrelated texts differ too little.

Class ids and n-grams are 64-bit hashes.  Defined cases: null, empty and wordless
texts have no n-grams and link with nothing; fewer words than ``width`` are one
n-gram; repeated rows fall into one class; a null doc_id takes part in links but
never names a component (the component of null ids alone is null); an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bitset, fingerprint, in_bitset, release, slices, stored, text_of
from .components import connected

SLOT_BITS = 18
#: Slots of n-gram counts, and the least count in one task above what chance gives for an n-gram to be frequent.
GRAM_BITS, OFTEN = 22, 4
SEEN_BITS = 26
#: Classes of different components that meet at an n-gram of estimated order; where there are more, exact counts order the n-grams.
CROWD = 16
FETCH_BITS = 24
WORDS, MERGED = 16, 4
#: n-gram sets of either side of a block of pairs, in bytes; fewest parts of a side.
BLOCK_BYTES, SIDES = 8 << 20, 32
M = np.uint64(0x9FB21C651E98DF25)
BITS, FEW = [f"b{i}" for i in range(WORDS)], [f"f{i}" for i in range(MERGED)]
SETS = "doc_id long, _fp long, c long, size int, " + ", ".join(f"{b} long" for b in BITS) + ", prefix array<long>, fine array<long>"


@dataclass(frozen=True)
class Rule:
    """Two sets link when 100 * intersection >= percent * union."""

    width: int = 3
    percent: int = 90

    def prefix(self, size: int) -> int:
        return size + (-self.percent * size // 100) + 1 if size else 0

    def in_prefix(self, pos: str, size: str) -> Column:
        """Whether a position lies in the prefix of a set that is not empty."""
        return 100 * (F.col(size).cast("long") - F.col(pos)) >= self.percent * F.col(size).cast("long")


class WordHashes(dict):
    """Word to 64-bit hash; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: str, known: WordHashes) -> np.ndarray:
    """Hashes of the words in order.  bytes.lower and bytes.split are the rule's
    A-Z and its white space exactly."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.array([known[w] for w in words], dtype=np.uint64)


def grams(h: np.ndarray, width: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Distinct n-grams, sorted, and their summed word weights."""
    if not h.size:
        return h, None if weight is None else weight[:0]
    n = min(width, h.size)
    count = h.size - n + 1
    x = np.full(count, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            x = (x ^ h[k:k + count]) * M
            x ^= x >> np.uint64(29)
    if weight is None:
        return np.unique(x), None
    total = np.zeros(count, np.int64)
    for k in range(n):
        total += weight[k:k + count]
    x, first = np.unique(x, return_index=True)
    return x, total[first]


def frequencies(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents per word slot, and of n-gram slots those that are frequent in some task, over
    all documents: 2**SLOT_BITS and 2**GRAM_BITS counts, whatever the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, often, total = WordHashes(), np.zeros(1 << SLOT_BITS, np.int64), np.zeros(1 << GRAM_BITS, np.int32), 0
        for b in slices(batches):
            for text in b.column("text").to_pylist():
                h = word_hashes(text, known)
                count[np.unique(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] += 1
                x = grams(h, width)[0]
                often[(x >> np.uint64(64 - GRAM_BITS)).astype(np.int64)] += 1
                total += x.size
        used, mean = np.flatnonzero(count), total / often.size
        hot = np.flatnonzero(often > OFTEN + mean + 6 * mean ** 0.5)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([used, hot + count.size]).astype(np.int32)), pa.array(np.concatenate([count[used], often[hot]]))], ["s", "n"])

    got = docs.select("text").mapInArrow(run, "s int, n long").groupBy("s").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 << SLOT_BITS) + (1 << GRAM_BITS), np.int64)
    out[got.column("s").to_numpy()] = got.column("n").to_numpy()
    return out[:1 << SLOT_BITS], out[1 << SLOT_BITS:]


def set_table(docs: DataFrame, rule: Rule, counts: np.ndarray, often: np.ndarray) -> DataFrame:
    """SETS, one row per document: class, size, parities of 1024 hash parts, prefix rare first,
    parities of at least as many parts as n-grams if these are over 1024."""
    weights = np.round(1024 * np.log2(1 + counts)).astype(np.int64)
    levels = np.minimum(np.round(8 * np.log2(1 + often)), 255).astype(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in slices(batches):
            n = b.num_rows
            c, size, bits, ends, prefix = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros((n, WORDS), np.int64), np.zeros(n + 1, np.int32), []
            fine: list[np.ndarray | None] = [None] * n
            for r, text in enumerate(b.column("text").to_pylist()):
                h = word_hashes(text, known)
                x, w = grams(h, rule.width, weights[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)])
                size[r] = x.size
                ends[r + 1] = ends[r]
                if x.size:
                    c[r] = np.uint64(xxhash.xxh3_64_intdigest(x.tobytes())).view(np.int64)
                    odd = np.bincount((x >> np.uint64(54)).astype(np.int64), minlength=64 * WORDS) & 1
                    bits[r] = np.packbits(odd.astype(np.uint8)).view(np.int64)
                    if x.size > 64 * WORDS:
                        parts = 1 << (x.size - 1).bit_length()
                        odd = np.bincount((x & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1
                        fine[r] = np.packbits(odd.astype(np.uint8)).view(np.int64)
                    w += levels[(x >> np.uint64(64 - GRAM_BITS)).astype(np.int64)].astype(np.int64) << 40
                    prefix.append(x[np.lexsort((x, w))[: rule.prefix(x.size)]])
                    ends[r + 1] += prefix[-1].size
            flat = np.concatenate(prefix).view(np.int64) if prefix else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("_fp"), pa.array(c), pa.array(size), *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(WORDS)],
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(fine, pa.list_(pa.int64()))], ["doc_id", "_fp", "c", "size", *BITS, "prefix", "fine"])

    return docs.select("doc_id", "_fp", "text").mapInArrow(run, SETS)


def postings(sets: DataFrame) -> DataFrame:
    """(g, c, size, pos) of prefix n-grams that more than one document has."""
    often = sets.select(F.explode("prefix").alias("g")).groupBy("g").agg(F.count("*").alias("n")).filter("n > 1")
    seen = bitset(often, "g", SEEN_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            lists = b.column("prefix")
            n = np.asarray(lists.value_lengths())
            g = np.asarray(lists.flatten())
            row = np.repeat(np.arange(b.num_rows), n)
            pos = np.arange(g.size) - np.repeat(np.cumsum(n) - n, n)
            keep = in_bitset(seen, g)
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[keep]), pa.array(np.asarray(b.column("c"))[row[keep]]), pa.array(np.asarray(b.column("size"))[row[keep]]), pa.array(pos[keep].astype(np.int32))],
                ["g", "c", "size", "pos"])

    return sets.filter("size > 0").select("c", "size", "prefix").mapInArrow(run, "g long, c long, size int, pos int")


def shared_postings(p: DataFrame, classes: DataFrame) -> DataFrame:
    """(g, c, size, pos, bits, score) of n-grams that more than one class has; score sums up how many do."""
    p = p.groupBy("g", "c").agg(F.first("size").alias("size"), F.first("pos").alias("pos"))
    p = stored(p.join(_held(p), "g"), "postings")
    scores = p.groupBy("c").agg(F.sum("n").alias("score"))
    out = stored(_once(p).join(scores, "c").join(classes.select("c", *_merged()), "c"), "shared-postings")
    release(p)
    return out


def _held(p: DataFrame) -> DataFrame:
    """(g, n, held): n-grams that more than one class has, how many, and a hash of which ones."""
    return p.groupBy("g").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("c")).alias("held")).filter("n > 1")


def _once(p: DataFrame) -> DataFrame:
    """Postings (g, c, size, pos) of one n-gram, the first, for all that the same classes have (a shared
    passage gives very many): it is the first in each of these classes.  Two hashes that agree by
    chance add candidates and lose none, since the least position passes most."""
    return p.groupBy(F.col("held").alias("g"), "c").agg(F.first("size").alias("size"), F.min("pos").alias("pos"))


def _merged() -> list[Column]:
    """Parities of 256 parts: a merged part's is the exclusive or of its parts'."""
    return [reduce(Column.bitwiseXOR, [F.col(b) for b in BITS[i::MERGED]]).alias(f) for i, f in enumerate(FEW)]


def _apart(a: list[str], b: list[str]) -> Column:
    return reduce(Column.__add__, [F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b)])


def _may_link(rule: Rule, parts: list[str] = FEW) -> Column:
    """Length, positional and suffix filters over sides a and b that share an n-gram.
    Positional: what stands after it must suffice.  That may fail at a later shared
    n-gram; the pair then comes by its first."""
    sa, sb, at, bt = (F.col(x).cast("long") for x in ("a.size", "b.size", "a.pos", "b.pos"))
    t = rule.percent
    most = 1 + F.least(sa - at - 1, sb - bt - 1)
    apart = _apart([f"a.{f}" for f in parts], [f"b.{f}" for f in parts])
    return (100 * F.least(sa, sb) >= t * F.greatest(sa, sb)) & ((100 + t) * most >= t * (sa + sb)) & ((100 + t) * apart <= (100 - t) * (sa + sb))


def _partners(rule: Rule) -> Column:
    """Classes of different components that share an n-gram and may link."""
    return (F.col("a.g") == F.col("b.g")) & (F.col("a.root") != F.col("b.root")) & _may_link(rule, BITS)


def _meet(q: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of partners, once for each n-gram that makes them meet."""
    return _pairs(q.alias("a").join(q.alias("b"), _partners(rule) & (F.col("a.c") < F.col("b.c"))))


def _mixed(q: DataFrame) -> DataFrame:
    """(g, n): n-grams that classes of different components have, and the number of classes."""
    return q.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("g", "n")


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("a.c", "b.c").alias("a"), F.greatest("a.c", "b.c").alias("b"))


def _folded(words: Column, k: Column) -> Column:
    """Parities of k words' parts from those of more: parts equal in the low bits are merged."""
    merged = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.aggregate(F.sequence(i, F.size(words) - 1, k), F.lit(0).cast("long"), lambda s, j: s.bitwiseXOR(words[j])))
    return F.when(F.size(words) == k, words).otherwise(merged)


def _suffix(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs that the suffix filter passes on all parts, those of long sets on their fine parts too."""
    side = lambda x: classes.select(F.col("c").alias(x), F.col("size").alias(f"s{x}"), *[F.col(b).alias(f"{x}{b}") for b in BITS])
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    most = (100 - rule.percent) * (F.col("sa") + F.col("sb"))
    apart = _apart([f"a{b}" for b in BITS], [f"b{b}" for b in BITS])
    p = p.filter((100 + rule.percent) * apart <= most).select("a", "b", "sa", "sb")
    long = classes.filter("fine IS NOT NULL").select("c", "fine")
    p = p.join(long.select(F.col("c").alias("a"), F.col("fine").alias("fa")), "a", "left").join(long.select(F.col("c").alias("b"), F.col("fine").alias("fb")), "b", "left")
    k = F.least(F.size("fa"), F.size("fb"))
    differ = F.aggregate(F.zip_with(_folded(F.col("fa"), k), _folded(F.col("fb"), k), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    return p.filter(F.when(F.col("fa").isNull() | F.col("fb").isNull(), True).otherwise((100 + rule.percent) * differ <= most)).select("a", "b")


def _wanted(some: DataFrame, classes: DataFrame) -> DataFrame:
    """Size and document of the classes in ``some``, stored."""
    found = classes.join(some.distinct(), "c")
    return stored(found.select("c", "size", F.col("rep.doc_id").alias("_id"), F.col("rep._fp").alias("_f")), "wanted")


def _fetched(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(c, text) of wanted classes: a filter of fixed size thins the scan, an equi-join makes it exact."""
    near = bitset(wanted, "_f", FETCH_BITS)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_bitset(near, np.asarray(b.column("_fp")))))

    some = docs.select("doc_id", "_fp", "text").mapInArrow(thin, "doc_id long, _fp long, text string")
    same = some.join(wanted, (F.col("_fp") == F.col("_f")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return same.groupBy("_fp").agg(F.first("c").alias("c"), F.first("text").alias("text")).drop("_fp")  # repeated rows


def _recounted(crowded: DataFrame, docs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """(g, c, size, pos, root, bits), stored: prefixes of the classes (c, root) in the order of the exact
    number of these classes that have an n-gram.  Those that one class has come first and meet nothing, so
    they are only counted."""
    wanted = _wanted(crowded.select("c"), classes)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in slices(batches, 64):
            sets = [grams(word_hashes(text, known), rule.width)[0] for text in b.column("text").to_pylist()]
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            ends = np.cumsum([0, *[x.size for x in sets]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("c"), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["c", "size", "prefix"])

    sets = stored(_fetched(wanted, docs).mapInArrow(whole, "c long, size int, prefix array<long>"), "whole-sets")
    p = postings(sets).drop("pos")
    p = p.join(_held(p), "g")
    own = Window.partitionBy("c")
    p = p.withColumn("pos", F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "g")) - 1)
    p = p.withColumn("pos", F.col("pos").cast("int")).filter(rule.in_prefix("pos", "size"))
    p = stored(_once(p).join(crowded, "c"), "recounted")
    out = stored(p.join(_mixed(p).select("g"), "g").join(classes.select("c", *BITS), "c"), "recounted-postings")
    release(wanted, sets, p)
    return out


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs that link, stored.  Only texts of candidate classes are fetched."""
    wanted = _wanted(pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))), classes)
    sides = max(SIDES, 8 * (wanted.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0) // BLOCK_BYTES)
    texts = stored(_fetched(wanted, docs), "texts")
    # A block holds the pairs of one part of the left classes with one of the right ones.
    side = lambda x: F.pmod(F.xxhash64(x, F.lit(1)), F.lit(sides))
    placed = stored(pairs.withColumn("k", side("a") * sides + side("b")), "placed-pairs")
    needs = placed.select("k", F.col("a").alias("c")).unionByName(placed.select("k", F.col("b").alias("c"))).distinct()
    copies = needs.join(texts, "c").select("k", F.lit(0).alias("kind"), F.col("c").alias("a"), F.lit(0).cast("long").alias("b"), "text")
    rows = copies.unionByName(placed.select("k", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("string").alias("text")))
    rows = rows.repartition("k").sortWithinPartitions("k", "kind", "a", "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, here, block = WordHashes(), {}, None
        for batch in slices(batches, 4096):
            out_a, out_b, pending = [], [], {}

            def settle() -> None:
                for x, others in pending.items():
                    mine, sets = here[x], [here[y] for y in others]
                    n = np.array([z.size for z in sets])
                    flat = np.concatenate(sets)
                    at = np.minimum(np.searchsorted(mine, flat), mine.size - 1)
                    both = np.add.reduceat((mine[at] == flat).astype(np.int64), np.cumsum(n) - n)
                    for y in np.array(others)[100 * both >= rule.percent * (mine.size + n - both)].tolist():
                        out_a.append(x)
                        out_b.append(y)
                pending.clear()

            for k, kind, x, y, text in zip(*[batch.column(c).to_pylist() for c in ("k", "kind", "a", "b", "text")]):
                if k != block:
                    settle()
                    block, here = k, {}
                if kind == 0:
                    here[x] = grams(word_hashes(text, known), rule.width)[0]
                else:
                    pending.setdefault(x, []).append(y)
            settle()
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    out = stored(rows.mapInArrow(check, "a long, b long"), "verified")
    release(wanted, texts, placed)
    return out


def _prepared(documents: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents with _fp, classes, members, shared postings)."""
    docs = documents.select("doc_id", text_of().alias("text")).withColumn("_fp", fingerprint("doc_id", "text"))
    sets = stored(set_table(docs, rule, *frequencies(docs, rule.width)), "ngram-sets")
    ident = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id"), F.col("_fp"))
    classes = stored(sets.filter("size > 0").groupBy("c").agg(F.min(ident).alias("rep"), F.first("size").alias("size"), *[F.first(b).alias(b) for b in (*BITS, "fine")]), "classes")
    table = shared_postings(postings(sets), classes)
    members = stored(sets.select("doc_id", "_fp", "size", "c"), "members")
    release(sets)
    return docs, classes, members, table


def connecting_links(docs: DataFrame, classes: DataFrame, table: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) that connect the components; others inside one component are not looked for."""
    linked, _, more = _connect(docs, classes, table, rule)
    return linked if more is None else linked.unionByName(more)


def _connect(docs: DataFrame, classes: DataFrame, table: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Links by stars, their components (node, root), and links between these components, if any pairs were left to verify."""
    p = table.alias("a")
    hubs = p.groupBy("g").agg(F.max(F.struct("score", "c", "size", "pos", *FEW)).alias("h")).select("g", "h.*")
    stars = p.join(hubs.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.c") != F.col("b.c")) & _may_link(rule))
    tried = stored(_suffix(_pairs(stars).distinct(), classes, rule), "star-pairs")
    linked = _verify(tried, docs, classes, rule)

    roots = connected(linked)
    q = p.drop("score", *FEW).join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    q = stored(q.join(_mixed(q).select("g"), "g").join(classes.select("c", *BITS), "c"), "rooted-postings")
    release(table)
    met = stored(q.alias("a").join(q.alias("b"), _partners(rule), "left_semi"), "met-postings")
    release(q)
    q = met.join(_mixed(met), "g")
    crowded = stored(q.filter(F.col("n") > CROWD).select("c", "root").distinct(), "crowded")
    rest = _meet(q.filter(F.col("n") <= CROWD).drop("n"), rule)
    made = [met, tried, crowded]
    if not crowded.isEmpty():
        made.append(_recounted(crowded, docs, classes, rule))
        rest = rest.unionByName(_meet(made[-1], rule))
    # One grouping: an anti-join would be moved below a distinct and shuffle a pair once for every n-gram it shares.
    fresh = rest.withColumn("tried", F.lit(False)).unionByName(tried.withColumn("tried", F.lit(True))).groupBy("a", "b").agg(F.bool_or("tried").alias("tried"))
    rest = stored(_suffix(fresh.filter("NOT tried").select("a", "b"), classes, rule), "other-pairs")
    release(*made)
    more = None if rest.isEmpty() else _verify(rest, docs, classes, rule)
    release(rest)
    return linked, roots, more


def _roots(roots: DataFrame, more: DataFrame | None) -> DataFrame:
    """(node, root) with links between components; only their roots are connected again."""
    if more is None:
        return roots
    at = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    known = more.join(at("a"), "a", "left").join(at("b"), "b", "left")
    joined = stored(connected(known.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))).withColumnRenamed("root", "top"), "joined-roots")
    moved = roots.join(joined.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(joined.select("node", F.col("top").alias("root"))).distinct()


def components(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, _fp (of id and text), n_shingles, component_id, first: the component's least (doc_id, _fp)."""
    docs, classes, members, table = _prepared(documents, rule)
    _, roots, more = _connect(docs, classes, table, rule)
    roots = _roots(roots, more)
    known = classes.select("c", "rep").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    firsts = known.groupBy("root").agg(F.min("rep").alias("first"))
    by_class = known.join(firsts, "root").select("c", "first")
    out = members.select("doc_id", "_fp", "size", F.when(F.col("size") > 0, F.col("c")).alias("c")).join(by_class, "c", "left")
    return out.select("doc_id", "_fp", F.col("size").cast("long").alias("n_shingles"),
                      F.when(F.col("size") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("first"))


def one_per_component(documents: DataFrame, rule: Rule) -> DataFrame:
    """Documents, all columns, one row of each component: its least (doc_id, _fp)."""
    found = components(documents, rule)
    me = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id"), F.col("_fp"))
    keep = stored(found.filter((F.col("n_shingles") == 0) | (me == F.col("first"))).groupBy("doc_id", "_fp", "n_shingles").agg(F.count("*").alias("n")), "kept-ids")
    ids = keep.select(F.col("doc_id").alias("_llm_id"), F.col("_fp").alias("_llm_fp"))
    out = documents.join(ids, documents["doc_id"].eqNullSafe(F.col("_llm_id")) & (F.xxhash64(documents["doc_id"], F.coalesce(documents["text"], F.lit(""))) == F.col("_llm_fp")), "left_semi")
    return out if keep.filter("n > 1 AND n_shingles > 0").isEmpty() else _one_of_equal(out)


def _one_of_equal(documents: DataFrame) -> DataFrame:
    """Rows equal in id and text, the text having words: one of them stays."""
    words = F.coalesce(documents["text"], F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return documents.filter(~words).unionByName(documents.filter(words).dropDuplicates(["doc_id", "text"]))
