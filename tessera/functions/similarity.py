"""Name and vector similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

PREFIX, SCALE = 4, 0.1


def jaro(a: str, b: str) -> float:
    """Jaro similarity: greedy matches inside half the longer length, half the transpositions rounded down."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    left = []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == c), None)
        if j is not None:
            free[j] = False
            left.append(c)
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, unused in zip(b, free) if not unused]
    t = sum(x != y for x, y in zip(left, right)) // 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def winkler(a: str, b: str) -> float:
    """Jaro with a bonus for up to PREFIX common first letters, whatever the Jaro value."""
    base = jaro(a, b)
    same = 0
    for x, y in zip(a[:PREFIX], b[:PREFIX]):
        if x != y:
            break
        same += 1
    return base + same * SCALE * (1 - base)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Arrow batches; Spark has no such function of its own. Equal pairs of a batch are computed once."""
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b):
        if pair[0] is None or pair[1] is None:
            out.append(None)
            continue
        if pair not in known:
            known[pair] = winkler(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def winkler_at_most(a: Column, b: Column) -> Column:
    """A bound that :func:`jaro_winkler` never exceeds, by lengths and common first letters, in the JVM."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    base = F.when(long == 0, 1.0).otherwise((short / F.greatest(long, F.lit(1)) + 2) / 3)
    same = sum((F.when(F.substring(a, 1, i) == F.substring(b, 1, i), 1).otherwise(0) for i in range(1, PREFIX + 1)), F.lit(0))
    return base + same * SCALE * (1 - base)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for empty vectors, different lengths or a zero vector."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    add = lambda s, v: s + v
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda p: p * p), F.lit(0.0), add))
    size = norm(x) * norm(y)
    return F.when((F.size(x) == F.size(y)) & (F.size(x) > 0) & (size > 0), dot / size).otherwise(0.0)


def unit_interval(value: Column) -> Column:
    """[-1, 1] onto [0, 1]."""
    return (value + 1) / 2


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
