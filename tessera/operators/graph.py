"""Connected components of a distributed edge list.

Alternating large-star and small-star steps: each edge moves to the smallest
neighbour until every component is a star around its smallest node. Minima are
aggregated before they are joined back, so a node with very many edges is
pre-aggregated on the map side and its join can be split. Nothing is collected;
the number of rounds grows with the logarithm of a component's width. A step's
table is deleted as soon as the next one is written.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.store import spent, table

MOST_ROUNDS = 100


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (the least place reached, for each place) after linking places a and b; in one task's memory."""
    while True:  # hook the larger root to the smaller, then flatten
        ra, rb = label[a], label[b]
        apart = ra != rb
        if not apart.any():
            return label
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while (label[label] != label).any():
            label = label[label]


def _pairs(edges: DataFrame, small: bool) -> DataFrame:
    """The edges that a step looks at, from their greater end only (small) or from both."""
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")) if small else edges.union(edges.select("v", "u"))
    return pairs.where("u <> v").distinct()


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """One step over rows (u, v), which are read twice."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    both = pairs.join(least, "u")
    if small:
        return both.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _settled(stars: DataFrame) -> bool:
    """Whether every node is either a centre or hangs on a single one."""
    ends = stars.select(F.col("u").alias("x"), F.lit(1).alias("n"), F.lit(0).alias("centre")).union(stars.select(F.col("v").alias("x"), F.lit(0).alias("n"), F.lit(1).alias("centre")))
    return ends.groupBy("x").agg(F.sum("n").alias("n"), F.max("centre").alias("centre")).where("n > 1 or n + centre > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the edges (u, v): the smallest node that it reaches."""
    now, old = edges.select("u", "v"), None
    for _ in range(MOST_ROUNDS):
        large = table(_pairs(now, small=False), "large-star")
        if old is not None:
            spent(old)
        small = table(_pairs(_star(large, small=False), small=True), "small-star")
        now = old = table(_star(small, small=True).where("u <> v").distinct(), "stars")
        spent(large, small)
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    raise RuntimeError("components did not settle")
