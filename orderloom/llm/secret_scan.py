"""Secret spans: fixed patterns, and two character Markov models (DataFrame functions only).

The patterns find assignments to secret-like names, access keys and hex runs.
The models find what has no pattern: a run of characters that random strings are
made of is far likelier under a model of random strings than under one of
ordinary identifiers.  Both are first-order, trained on labelled samples; their
difference is one table of whole-number weights (1000 times the logarithm of the
likelihood ratio of a character after another), whose size is that of the
alphabet squared.  A run's score is the sum of its weights: positive where it is
likelier random.

Labelled samples (``labelled``): label 1 are values that the patterns find, and
digests of ids in base 64 and in hex of either case, which are random by
construction; label 0 are the other runs of the same texts.  They come from at
most ``SAMPLE_ROWS`` documents, chosen by a digest of the id.

Defined cases: null and empty texts have no spans and the digest of the empty
string; repeated rows each get the same result; without any document the weights
are those of two equal models and nothing is random; an empty table gives an
empty table; only doc_id and text are read, whatever other columns are called.
Positions are code points, ends exclusive; spans of different kinds may overlap.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import floor, log

from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of
from .pii import _spans

#: Bound of what is learned: documents whose runs are the samples.
SAMPLE_ROWS = 1_000
#: Characters of random strings, in the order of the weight table.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CLASS = r"[A-Za-z0-9+/_=-]"
K = len(ALPHABET)
#: Shortest run that is scored, shortest that is learned from, and the score needed: e^12 times likelier.
LEAST_CHARS, LEARN_CHARS, LEAST_SCORE = 20, 4, 12_000


def _either_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


#: Fixed patterns, in the order of their listing.
ASSIGN = "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RANDOM = rf"{CLASS}{{{LEAST_CHARS},}}"
LEAST_VALUE = 12
NAMES = ("assign", "access", "hex", "random")
PATTERNS = (ASSIGN, ACCESS, HEX, RANDOM)
BASE = 3


@dataclass(frozen=True)
class Model:
    """``weights[K * a + b]``: of character b after character a."""

    weights: tuple[int, ...]

    def score(self, run: Column) -> Column:
        """Sum of the weights of a run's pairs of characters."""
        weights = F.split(F.lit(",".join(map(str, self.weights))), ",").cast("array<int>")
        place = [-1] * 128
        for i, c in enumerate(ALPHABET):
            place[ord(c)] = i
        places = F.split(F.lit(",".join(map(str, place))), ",").cast("array<int>")
        codes = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.get(places, F.ascii(c)))
        start = F.struct(F.lit(-1).alias("at"), F.lit(0).cast("long").alias("sum"))
        step = lambda a, b: F.struct(
            b.alias("at"), (a["sum"] + F.when(a["at"] >= 0, F.get(weights, a["at"] * K + b)).otherwise(0)).alias("sum"))
        return F.aggregate(codes, start, step, lambda a: a["sum"])


def labelled(documents: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(value, label), distinct: the samples the two models learn from."""
    ids = documents.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(rows)
    some = documents.select("doc_id", text_of().alias("text")).join(ids, "doc_id")
    key = F.col("doc_id").cast("string").cast("binary")
    made = ids.select(F.explode(F.array(
        F.base64(F.unhex(F.sha2(key, 256))), F.upper(F.sha2(F.concat(key, F.lit("u").cast("binary")), 256)),
        F.sha2(F.concat(key, F.lit("l").cast("binary")), 256))).alias("value"))
    values = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    found = some.select(F.explode(values).alias("value")).filter(F.length("value") >= LEAST_VALUE)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    plain = some.select(F.explode(F.regexp_extract_all(bare, F.lit(rf"{CLASS}{{{LEARN_CHARS},}}"), F.lit(0))).alias("value"))
    return made.unionByName(found).select("value", F.lit(1).alias("label")).unionByName(plain.select("value", F.lit(0).alias("label"))).distinct()


def train(samples: DataFrame) -> Model:
    """Weights from (value, label): add-one smoothing over the alphabet.  The driver gets one row per pair of characters."""
    chars = F.filter(F.split("value", ""), lambda c: c != "")
    pairs = F.zip_with(chars, F.slice(chars, F.lit(2), F.size(chars)), lambda a, b: F.concat(a, b))  # the last has no partner: null
    used = samples.filter(F.length("value") > 1).select("label", F.explode(pairs).alias("p")).groupBy("p").agg(
        *[F.sum((F.col("label") == x).cast("long")).alias(f"n{x}") for x in (0, 1)])
    place = {a + b: K * i + j for i, a in enumerate(ALPHABET) for j, b in enumerate(ALPHABET)}
    n = [[0] * (K * K) for _ in range(2)]
    for r in used.filter(F.col("p").rlike(f"^{CLASS}{{2}}$")).collect():
        for x in (0, 1):
            n[x][place[r.p]] = r[f"n{x}"]
    total = [[sum(c[K * i:K * i + K]) for i in range(K)] for c in n]
    return Model(tuple(floor(1000 * log((n[1][p] + 1) * (total[0][p // K] + K) / ((n[0][p] + 1) * (total[1][p // K] + K))) + 0.5) for p in range(K * K)))


def _proposals(kind: int, text: Column, model: Model) -> Column:
    """array<struct<gap, len, keep, score>> of a kind's matches, in order; pieces between
    matches and matches alternate, so their lengths give every position."""
    pattern = PATTERNS[kind]
    run = rf"(?<!{CLASS}){pattern}+" if kind == 3 else pattern  # possessive, and only from where a run begins: linear

    def judged(piece: Column, m: Column) -> Column:
        score = model.score(m) if kind == 3 else F.lit(0).cast("long")
        keep = score >= LEAST_SCORE if kind == 3 else F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE if kind == 0 else F.lit(True)
        return F.struct(F.length(piece).alias("gap"), F.length(m).alias("len"), F.coalesce(keep, F.lit(False)).alias("keep"), score.cast("double").alias("score"))

    both = F.zip_with(F.split(text, run, -1), F.regexp_extract_all(text, F.lit(run), F.lit(0)), judged)
    empty = F.array().cast("array<struct<gap:int,len:int,keep:boolean,score:double>>")
    return F.when(text.rlike(run), F.filter(both, lambda x: x["len"].isNotNull())).otherwise(empty)


def find(documents: DataFrame, model: Model, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """Every column of ``documents`` and ``out``: array of start, ord (place in NAMES), end, score, by start and kind."""
    whole = text_of(text)
    return documents.withColumn(out, F.array_sort(F.concat(*[_spans(i, _proposals(i, whole, model)) for i in range(len(PATTERNS))])))


def _listing(spans: Column) -> Column:
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))))


def report(documents: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: counts by kind, the digest of the base spans, all spans and the scores of random ones."""
    model = train(labelled(documents, rows))
    d = find(documents.select("doc_id", "text"), model).drop("text")
    spans = F.col("secret_spans")
    count = lambda i: F.size(F.filter(spans, lambda s: s["ord"] == i)).cast("long")
    scores = F.transform(F.filter(spans, lambda s: s["ord"] == BASE), lambda s: s["score"].cast("long").cast("string"))
    return d.select("doc_id", *[count(i).alias(f"n_{n}") for i, n in enumerate(NAMES)], F.sha2(_listing(F.filter(spans, lambda s: s["ord"] < BASE)), 256).alias("base_sha256"),
                    _listing(spans).alias("spans"), F.concat_ws(",", scores).alias("scores"))
