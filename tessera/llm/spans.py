"""Places of pattern matches inside a text, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,hit:string>>"
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(lengths: Column) -> Column:
    """Sum of the entries before each entry, by blocks so that long arrays stay cheap."""
    zero = F.lit(0)
    add = lambda a, x: a + x
    blocks = F.transform(
        F.sequence(zero, F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)), zero, add),
    )
    before = F.aggregate(blocks, F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return let(
        before,
        lambda b: F.transform(
            lengths,
            lambda _, i: F.get(b, F.floor(i / BLOCK).cast("int"))
            + F.aggregate(F.slice(lengths, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK), zero, add),
        ),
    )


def find(text: Column, kind: str, pattern: str) -> Column:
    """All leftmost non-overlapping matches of a Java pattern in ``text``, with code point places.

    The pattern must not match the empty string. The pieces between the
    matches and the matches themselves add up to the places.
    """
    none = F.array().cast(SPAN)

    def placed(hits: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        lengths = F.transform(
            F.arrays_zip(F.slice(pieces, F.lit(1), F.size(hits)).alias("a"), hits.alias("b")),
            lambda z: F.length(z["a"]) + F.length(z["b"]),
        )
        return let(
            lengths,
            lambda ls: let(
                prefix_sums(ls),
                lambda before: F.transform(
                    hits,
                    lambda h, i: F.struct(
                        F.lit(kind).alias("kind"),
                        (F.get(before, i) + F.get(ls, i) - F.length(h)).alias("start"),
                        (F.get(before, i) + F.get(ls, i)).alias("end"),
                        h.alias("hit"),
                    ),
                ),
            ),
        )

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(none),
    )


def named(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))


def joined(spans: Column, kinds: list[str], part: Callable[[Column], Column] = named) -> Column:
    """``kind:start:end`` (or what ``part`` makes) of all spans, by start and then by the order of ``kinds``, comma-joined."""
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"]).alias("rank"),
            s["end"].alias("end"),
            part(s).alias("text"),
        ),
    )
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["text"]), ",")
