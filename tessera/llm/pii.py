"""Personal data: patterns propose, checksums confirm, context adjusts.

Everything is a Column expression: patterns run in the JVM, Luhn and mod-97
are folds over the digits of a candidate, and the words just before a span
raise its score.

Defined results: a null text has no spans; an empty one likewise. Rows are
independent, so repeated rows and ties give repeated results, an empty table
gives an empty one, and other columns are carried unchanged (columns that the
operator adds replace columns of the same name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.spans import find, joined, let

# Each pattern finds what the plain one finds but starts only where a match can
# start, with possessive repeats, so that long runs cost linear time:
# email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
# ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
# card   [0-9]([\x20-]?[0-9])+ of 12 to 19 digits
# phone  \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![0-9])(?![ -][0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
}
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban"]
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9}
CONTEXT = {
    "email": r"(?i)mail|contact|write to",
    "ip": r"(?i)\bip\b|address|host|server",
    "card": r"(?i)card|visa|credit|carte|karte|tarjeta",
    "phone": r"(?i)phone|call|tel|mobile",
    "iban": r"(?i)iban|account|bank|konto|compte|cuenta",
}
REACH = 40  # characters before a span in which context words count
BOOST = 0.1
BLOCK = 1024  # characters of a block of text
SCORED = "array<struct<kind:string,start:int,end:int,hit:string,score:double>>"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number passes ISO 7064 mod 97-10."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban) - 4), F.substring(iban, F.lit(1), F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(add(a, c))) == 1


def confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return luhn(F.regexp_replace(hit, "[ -]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return mod97(hit)
    return F.lit(True)


def before(blocks: Column, start: Column) -> Column:
    """Up to REACH characters before a place, from the text's blocks: a place far into a long text costs no more than a near one."""
    at = F.floor(start / BLOCK).cast("int")
    near = F.concat(F.when(at > 0, F.get(blocks, at - 1)).otherwise(""), F.coalesce(F.get(blocks, at), F.lit("")))
    place = start - F.greatest(at - 1, F.lit(0)) * BLOCK
    return F.substring(near, F.greatest(F.lit(1), place + 1 - REACH), F.least(F.lit(REACH), place))


def kind_spans(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind, each scored with the words before it."""

    def scored(s: Column, blocks: Column) -> Column:
        boost = F.when(before(blocks, s["start"]).rlike(CONTEXT[kind]), BOOST).otherwise(0.0)
        return F.struct(s["kind"], s["start"], s["end"], s["hit"], (F.lit(SCORES[kind]) + boost).alias("score"))

    def told(found: Column) -> Column:
        blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
        return F.when(F.size(found) > 0, let(blocks, lambda b: F.transform(found, lambda s: scored(s, b)))).otherwise(F.array().cast(SCORED))

    return let(F.filter(find(text, kind, PATTERNS[kind]), lambda s: confirmed(kind, s["hit"])), told)


def spans(text: Column) -> Column:
    """Confirmed spans of all kinds: array of (kind, start, end, hit, score)."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*[kind_spans(text, kind) for kind in PATTERNS])


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with an array column of the confirmed spans and their scores."""
    return docs.withColumn(into, spans(F.col(text)))


def count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, places and scores (in hundredths, in the order of ``spans``) by document, from :func:`find_pii`'s spans."""
    found = find_pii(docs.select(id_col, text), text, "pii")
    base = F.filter("pii", lambda s: s["kind"].isin(BASE))
    return found.select(
        id_col,
        *[count(F.col("pii"), kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(joined(base, KINDS), 256).alias("base_sha256"),
        joined(F.col("pii"), KINDS).alias("spans"),
        joined(F.col("pii"), KINDS, lambda s: F.round(s["score"] * 100).cast("int").cast("string")).alias("scores"),
    )
