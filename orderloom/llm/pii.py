"""Personal data spans: patterns propose, checksums confirm, context scores (DataFrame functions only).

A pattern is run twice by the JVM, once to split the text and once to extract;
pieces and matches alternate, so their lengths give every position without a
row-at-a-time function.  Patterns use possessive runs, and look-behinds that
keep a failed run from being tried again at each of its characters: the time is
linear in the text, also for one endless word.

Defined cases: null and empty texts have no spans and the digest of the empty
string; repeated rows each get the same result; an empty table gives an empty
table; only doc_id and text are read, whatever other columns are called.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of, unused

BLOCK = 256
CHUNK = 4096
CONTEXT = 40


@dataclass(frozen=True)
class Kind:
    """``gate``: cheap test of a text that may have a match.  ``check``: keeps a match.
    ``words``: context words that raise the score by ``lift``.  ``least``: score needed.
    ``whole``: what Spark runs, where ``pattern`` (that of the SQL) stops at a length."""

    name: str
    pattern: str
    gate: str
    base: float
    words: str
    least: float = 0.0
    lift: float = 0.2
    whole: str = ""


#: Fixed patterns: the first four are the base kinds, in the order of their listing.
EMAIL = Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, "mail|contact|write|correo|courriel|adresse")
IP = Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.5, r"\bip\b|address|host|server|login|adresse")
CARD = Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", 0.7, "card|visa|master|credit|payment|karte|carte|tarjeta")
PHONE = Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|call|tel|mobile|fax|telefon")
IBAN = Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", "[A-Z]{2}[0-9]{2}", 0.8, "iban|account|bank|konto|compte|cuenta", 0.7)
SECRET = Kind("secret", r"\bAKIA[0-9A-Z]{16}\b|(?i:password|passwd|token|secret|api[_-]?key)\x20{0,2}[=:]\x20{0,2}\"?[A-Za-z0-9/+_.-]{8,}",
              "AKIA|[=:]", 0.6, "key|access|login|user|auth", 0.6,
              whole=r"\bAKIA[0-9A-Z]{16}\b|(?i:password|passwd|token|secret|api[_-]?key)\x20{0,2}[=:]\x20{0,2}\"?[A-Za-z0-9/+_.-]{8,}+")
BASE = (EMAIL, IP, CARD, PHONE)
KINDS = (*BASE, IBAN, SECRET)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    s = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c >= "A", (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def confirmed(kind: Kind, m: Column) -> Column:
    """The checksum or range rule of a kind."""
    if kind is IP:
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind is CARD:
        return F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m))
    if kind is PHONE:
        return F.length(_digits(m)).between(10, 15)
    if kind is IBAN:
        return F.length(F.regexp_replace(m, " ", "")).between(15, 34) & (_mod97(m) == 1)
    if kind is SECRET:
        return m.startswith("AKIA") | (m.rlike("[0-9]") & m.rlike("[A-Za-z]"))
    return F.lit(True)


def _proposals(kind: Kind, text: Column) -> Column:
    """array<struct<gap, len, keep, score>> of a text's matches, in order."""
    empty = F.array().cast("array<struct<gap:int,len:int,keep:boolean,score:double>>")

    def judged(piece: Column, m: Column) -> Column:
        near = F.right(piece, F.lit(CONTEXT)).rlike(f"(?i){kind.words}") if kind is not SECRET else F.concat(F.right(piece, F.lit(CONTEXT)), m).rlike(f"(?i){kind.words}")
        score = F.least(F.lit(1.0), F.lit(kind.base) + F.when(near, kind.lift).otherwise(0.0))
        keep = confirmed(kind, m)
        if kind.least > kind.base:
            keep = keep & (score >= kind.least)
        return F.struct(F.length(piece).alias("gap"), F.length(m).alias("len"), F.coalesce(keep, F.lit(False)).alias("keep"), score.alias("score"))

    gate = F.contains(text, F.lit(kind.gate)) if len(kind.gate) == 1 else text.rlike(kind.gate)
    pattern = kind.whole or kind.pattern
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), judged)
    return F.when(gate, F.filter(both, lambda x: x["len"].isNotNull())).otherwise(empty)


def _spans(order: int, proposals: Column) -> Column:
    """Kept proposals as array<struct<start, ord, end, score>>.  Two levels of
    folding: a long list is never copied once per element."""
    span = "array<struct<start:int,ord:int,end:int,score:double>>"
    start = lambda a, x: a["at"] + x["gap"]

    def one(a: Column, x: Column) -> Column:
        s = F.struct(start(a, x).alias("start"), F.lit(order).alias("ord"), (start(a, x) + x["len"]).alias("end"), x["score"].alias("score"))
        return F.struct((start(a, x) + x["len"]).alias("at"), F.when(x["keep"], F.concat(a["out"], F.array(s))).otherwise(a["out"]).alias("out"))

    def block(a: Column, b: Column) -> Column:
        done = F.aggregate(b, F.struct(a["at"].alias("at"), F.array().cast(span).alias("out")), one)
        return F.aggregate(F.array(done), a, lambda acc, d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(proposals) - 1) / BLOCK).cast("int")), lambda i: F.slice(proposals, i * BLOCK + 1, F.lit(BLOCK)))
    all_of = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out")), block, lambda a: F.flatten(a["out"]))
    return F.when(F.size(proposals) > 0, all_of).otherwise(F.array().cast(span))


def _listing(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))))


def find(documents: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """Every column of ``documents`` and ``out``: array of start, ord (place in KINDS),
    end, score, by start and kind."""
    whole, found = unused(documents, "_pii_text"), [unused(documents, f"_pii_{k.name}") for k in KINDS]
    d = documents.withColumn(whole, text_of(text))
    d = d.withColumns({n: _proposals(k, F.col(whole)) for n, k in zip(found, KINDS)})
    d = d.withColumn(out, F.array_sort(F.concat(*[_spans(i, F.col(n)) for i, n in enumerate(found)])))
    return d.drop(whole, *found)


def report(documents: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, all spans."""
    d = find(documents.select("doc_id", "text")).drop("text")
    base = F.filter("pii_spans", lambda s: s["ord"] < len(BASE))
    count = lambda i: F.size(F.filter("pii_spans", lambda s: s["ord"] == i)).cast("long")
    return d.select(
        "doc_id", *[count(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS)], F.sha2(_listing(base), 256).alias("base_sha256"),
        _listing(F.col("pii_spans")).alias("spans"), F.concat_ws(",", F.transform("pii_spans", lambda s: F.format_number(s["score"], 2))).alias("scores"))


def redact(documents: DataFrame, text: str = "text") -> DataFrame:
    """The same columns; spans of ``text`` become [EMAIL], [IP] and so on.

    Overlapping spans become one mark.  A text with spans is cut into chunks and
    rebuilt chunk by chunk, so no substring walks the whole text.  A null text
    stays null."""
    spans, cut = unused(documents, "_pii_spans"), unused(documents, "_pii_cut")
    merged = F.aggregate(
        spans, F.array().cast("array<struct<start:int,ord:int,end:int>>"),
        lambda a, s: F.when((F.size(a) > 0) & (s["start"] < F.get(a, F.size(a) - 1)["end"]),
                            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(
                                F.get(a, F.size(a) - 1)["start"].alias("start"), F.get(a, F.size(a) - 1)["ord"].alias("ord"),
                                F.greatest(F.get(a, F.size(a) - 1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"))))))
    names = F.array(*[F.lit(f"[{k.name.upper()}]") for k in KINDS])

    def rebuilt(chunk: Column, i: Column) -> Column:
        lo = i * CHUNK
        inside = F.filter(cut, lambda s: (s["start"] < lo + CHUNK) & (s["end"] > lo))
        done = F.aggregate(
            inside, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda a, s: F.struct(
                F.least(F.lit(CHUNK), s["end"] - lo).alias("at"),
                F.concat(a["out"], F.substr(chunk, a["at"] + 1, F.greatest(F.lit(0), s["start"] - lo - a["at"])),
                         F.when(s["start"] >= lo, F.get(names, s["ord"])).otherwise("")).alias("out")))
        return F.concat(done["out"], F.substr(chunk, done["at"] + 1, F.lit(CHUNK)))

    d = find(documents, text, spans).withColumn(cut, merged)
    whole = F.concat_ws("", F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), rebuilt))
    d = d.withColumn(text, F.when(F.size(cut) > 0, whole).otherwise(F.col(text)))
    return d.select(*documents.columns)
