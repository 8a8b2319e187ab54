"""Deterministic text embeddings for runs without a model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType

DIMENSIONS = 384
M32 = 0xFFFFFFFF


def fnv1a(text: str) -> int:
    """FNV-1a, 32 bits, over UTF-16 units."""
    h = 0x811C9DC5
    for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist():
        h = ((h ^ unit) * 0x01000193) & M32
    return h


def unit_vectors(seeds: np.ndarray, n: int = DIMENSIONS) -> np.ndarray:
    """Unit vectors of the mulberry32 generator, a row for each 32-bit seed; all seeds advance together."""
    state = seeds.astype(np.uint32)[:, None] + np.arange(1, n + 1, dtype=np.uint32) * np.uint32(0x6D2B79F5)
    t = (state ^ (state >> np.uint32(15))) * (state | np.uint32(1))
    t ^= t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))
    x = (t ^ (t >> np.uint32(14))).astype(np.float64) / 4294967296 * 2 - 1
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=x, where=norm > 0)


@F.pandas_udf(ArrayType(FloatType()))
def deterministic(texts: pd.Series) -> pd.Series:
    seeds = np.array([fnv1a(t or "") for t in texts], np.uint32)
    return pd.Series(list(unit_vectors(seeds).astype(np.float32)))


@F.pandas_udf(LongType())
def fnv(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fnv1a(t)).astype("Int64")


@dataclass(frozen=True)
class Provider:
    """A source of embeddings: of a column of texts, and of one text on the driver."""

    id: str
    dimensions: int
    column: Callable[[Column], Column]
    one: Callable[[str], list[float]]

    def __post_init__(self):
        if self.dimensions != DIMENSIONS:
            raise ValueError(f"provider {self.id} has {self.dimensions} dimensions, {DIMENSIONS} are needed")


DETERMINISTIC = Provider("deterministic", DIMENSIONS, deterministic, lambda text: unit_vectors(np.array([fnv1a(text)], np.uint32))[0].astype(np.float32).tolist())


def company_text(name: Column, description: Column, kinds: Column) -> Column:
    """Name, description and distinct signal kinds, joined by '. '."""
    nothing = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(". ", name, nothing(description), nothing(F.array_join(F.array_distinct(kinds), " ")))
