"""Names, titles and keys as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The corporate suffixes that names lose, and the sector needles in their order.
SUFFIXES = ["inc", "llc", "ltd", "sa", "srl", "gmbh"]
SECTOR_NEEDLES = [
    ("fintech", "fintech"),
    ("devtool", "devtools"),
    ("developer tool", "devtools"),
    ("health", "healthtech"),
    ("biotech", "biotech"),
    ("climate", "climate"),
    ("security", "security"),
    ("machine learning", "ai"),
    ("artificial intelligence", "ai"),
    (" ai ", "ai"),
    ("blockchain", "crypto"),
    ("crypto", "crypto"),
    ("marketplace", "marketplace"),
    ("e-commerce", "ecommerce"),
    ("ecommerce", "ecommerce"),
    ("saas", "saas"),
]
ONE_LINER = 140

_SUFFIX_TAIL = r"(?iU)(?:[\s,]+(?:" + "|".join(r"\.?".join(s) for s in SUFFIXES) + r")\.?\s*)+\z"


def _folds() -> tuple[str, str]:
    """Letters that are one base letter with marks, and those base letters."""
    marked, base = [], []
    for code in range(0xC0, 0x1F00):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if len(plain) == 1 and plain != chr(code):
            marked.append(chr(code))
            base.append(plain)
    return "".join(marked), "".join(base)


_MARKED, _BASE = _folds()


def strip_accents(text: Column) -> Column:
    """Letters without their combining marks, in the JVM."""
    return F.translate(F.regexp_replace(text, "[̀-ͯ]", ""), _MARKED, _BASE)


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def plain(text: Column) -> Column:
    """Everything but letters, digits and white space as a space, squeezed."""
    return squeeze(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}\s]", " "))


def normalize_name(name: Column) -> Column:
    """A company name without case, accents, corporate suffix and punctuation; never empty through the suffix alone."""
    low = F.regexp_replace(strip_accents(F.lower(name)), r"(?U)^\s+|\s+$", "")
    short = plain(F.regexp_replace(low, _SUFFIX_TAIL, ""))
    return F.when(short != "", short).otherwise(plain(low))


def show_title(title: Column) -> Column:
    """(name, description) of a launch post's title: its prefix dropped, split at the first spaced dash."""
    body = F.trim(F.regexp_replace(title, r"(?i)^Show HN:\s*", ""))
    split = r"(?s)^(.*?)\s+[–-]\s+(.+)$"
    found = body.rlike(split)
    name = F.when(found, F.trim(F.regexp_extract(body, split, 1))).otherwise(body)
    return F.struct(name.alias("name"), F.when(found, F.trim(F.regexp_extract(body, split, 2))).alias("description"))


def sector(text: Column) -> Column:
    """The sector of the first needle in the lower-cased text; null if there is none."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return F.coalesce(*[F.when(padded.contains(needle), F.lit(name)) for needle, name in SECTOR_NEEDLES])


def one_liner(text: Column) -> Column:
    """The trimmed text, cut to ONE_LINER characters with an ellipsis."""
    whole = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    cut = F.regexp_replace(F.substring(whole, 1, ONE_LINER - 1), r"(?U)\s+$", "")
    return F.when(F.length(whole) <= ONE_LINER, whole).otherwise(F.concat(cut, F.lit("…")))


def person(name: Column) -> Column:
    return F.lower(F.trim(name))


def blocking_keys(name: Column, domain: Column) -> Column:
    """domain:, name4: and trigram: keys of a normalised (or, for the naive kind, lower-cased) name and domain."""
    n = F.length(name)
    none = F.array().cast("array<string>")
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.concat(F.lit("trigram:"), F.substring(name, i, F.lit(3))))).otherwise(none)
    head = F.when(n >= 4, F.array(F.concat(F.lit("name4:"), F.substring(name, 1, 4)))).otherwise(none)
    own = F.when(domain.isNotNull() & (domain != ""), F.array(F.concat(F.lit("domain:"), domain))).otherwise(none)
    return F.array_distinct(F.concat(own, F.coalesce(head, none), F.coalesce(grams, none)))


def contains_all(text: Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases the lower-cased text contains."""
    low = F.lower(text)
    return sum((F.coalesce(low.contains(p.lower()), F.lit(False)).cast("int") for p in phrases), F.lit(0))
