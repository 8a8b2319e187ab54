"""Embedding near-duplicates by a forest of random-projection trees.

Equal vectors are merged first, by hashes of 128 bits. Each tree splits at the
median of a random projection; vectors near the median go to both sides (spill).
The upper levels, as many as the number of vectors asks for, are fitted on a bounded
sample (``sample`` vectors, taken in the order of a hash of their ids): a node takes
its median from its own sampled vectors while these are ENOUGH, and below that from
those of its nearest ancestor that has as many. They deal all vectors to groups; the
lower levels split each group at its own medians until leaves are small. A node
whose vectors all point nearly the same way is a leaf, since further splits would
only tear near copies apart; leaves are compared in tiles. A group of more than BIG
vectors (such a direction that very many share) is dealt in pairs of parts and
compared whole, so no task holds an unbounded group. Found
pairs are verified by cosine in double precision; each group gives only a
spanning forest of its links, and these are joined to components. Inside each
component the links of every vector are then counted exactly, so no list of
pairs is ever made, and a dense group costs counts, not rows.

Every vector is indexed; the tests hold recall against brute force.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and vectors with a null id, link with nothing; vectors of different
lengths never link; repeated rows are rows of their own that link as equal
vectors do (different vectors that repeat an id share that id's class). Ids are
numbers, or texts of numbers. An empty table gives an empty result; other columns
are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.store import table

THRESHOLD = 0.95
TREES = 8
LEAF = 256
GROUP = 4096  # vectors that a group of the upper levels should have
TOP_LEVELS = 30
ENOUGH = 32  # sampled vectors of a node that has a median of its own
BIG = 4 * GROUP  # vectors of a group compared in one task
SPILL = 0.04  # share of a node, on either side of its median, that goes to both sides
SAMPLE = 20_000
TILE = 512
PART = 4096  # vectors of a component counted together
PER_TASK = 50_000  # vectors of all components in a task
NARROW = 0.9  # median cosine to the mean direction at which a node is not split


def unit(column: pa.Array) -> np.ndarray:
    """Rows of one length as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # else squares of very large or small components are lost
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def narrow(x: np.ndarray) -> bool:
    mean = x.mean(0)
    return float(np.median(x @ mean)) >= NARROW * max(float(np.linalg.norm(mean)), 1e-9) and float(np.linalg.norm(mean)) >= NARROW


class Top:
    """The upper levels of all trees: a direction for each tree and level, bounds for each level and cell.

    A node's cell is the node itself in the first ``fitted`` levels, below them its ancestor there.
    """

    def __init__(self, x: np.ndarray, dim: int, levels: int, trees: int = TREES, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.levels, self.trees = levels, trees
        self.fitted = min(levels, max(0, int(np.log2(max(1, len(x)) / ENOUGH))))
        self.directions = rng.normal(size=(trees, levels, dim))
        self.low = np.zeros((trees, levels, 1 << self.fitted))  # right gets what is above low
        self.high = np.zeros((trees, levels, 1 << self.fitted))  # left gets what is at most high
        for t in range(trees):
            cell = np.zeros(len(x), np.int64)
            for level in range(levels):
                p = x @ self.directions[t, level]
                order = np.argsort(cell, kind="stable")
                edges = np.searchsorted(cell[order], np.arange((1 << min(level, self.fitted)) + 1))
                middle = np.zeros(len(edges) - 1)
                for c in range(len(middle)):
                    own = p[order[edges[c] : edges[c + 1]]]
                    own = own if len(own) > 1 else p
                    self.low[t, level, c], middle[c], self.high[t, level, c] = np.quantile(own, [0.5 - SPILL, 0.5, 0.5 + SPILL])
                if level < self.fitted:
                    cell = cell * 2 + (p > middle[cell])

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the groups that they go to, over all trees."""
        rows, groups = [], []
        for t in range(self.trees):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level in range(self.levels):
                p = (x @ self.directions[t, level])[row]
                cell = node >> max(0, level - self.fitted)
                left, right = p <= self.high[t, level, cell], p > self.low[t, level, cell]
                row, node = np.r_[row[left], row[right]], np.r_[2 * node[left], 2 * node[right] + 1]
            rows.append(row)
            groups.append((np.int64(t) << TOP_LEVELS + 2) + node)
        return np.concatenate(rows), np.concatenate(groups)


def leaves(x: np.ndarray, rng: np.random.Generator):
    """Row sets of the leaves below a group."""
    todo = [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= LEAF or narrow(x[own]):
            yield own
            continue
        p = x[own] @ rng.normal(size=x.shape[1])
        low, high = np.quantile(p, [0.5 - SPILL, 0.5 + SPILL])
        left, right = own[p <= high], own[p > low]
        if max(len(left), len(right)) > 0.9 * len(own):
            yield own
        else:
            todo += [left, right]


def close(x: np.ndarray, threshold: float):
    """Pairs of rows with at least the threshold's cosine, tile by tile."""
    for a in range(0, len(x), TILE):
        for b in range(a, len(x), TILE):
            i, j = np.nonzero(x[a : a + TILE] @ x[b : b + TILE].T >= threshold)
            own = i + a < j + b
            yield i[own] + a, j[own] + b


def valid(id_col: str, vector: str):
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda c: c != 0), F.lit(False))


def in_parts(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, id, columns, parts, own, p, q): rows (parts: how many its key has) for each pair of parts p <= q that theirs, own, is in."""
    own = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("p"), F.greatest(i, F.col("own")).alias("q")))
    return own.select(key, "id", *columns, "parts", "own", F.explode(pairs).alias("x")).select(key, "id", *columns, "parts", "own", "x.p", "x.q")


def near(distinct: DataFrame, threshold: float, sample: int, trees: int) -> DataFrame:
    """(u, v): edges that connect linked distinct vectors (id, v, dim), a spanning forest of each group's links."""
    out = None
    kind = dict(distinct.dtypes)["v"]
    for dim, n in [(r["dim"], r["count"]) for r in distinct.groupBy("dim").count().orderBy("dim").collect()]:
        own = distinct.where(F.col("dim") == dim)
        levels = min(TOP_LEVELS, max(0, int(np.ceil(np.log2(n / GROUP)))))
        some = own.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow() if levels else None
        top = own.sparkSession.sparkContext.broadcast(Top(unit(some.column("v")) if levels else np.zeros((0, dim)), dim, levels, trees))

        def deal(batches, top=top):
            for b in batches:
                if b.num_rows:
                    row, group = top.value.route(unit(b.column("v")))
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(group), b.column("id").take(at), b.column("v").take(at)], names=["g", "id", "v"])

        def compare(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("id")  # one order, so that a repeated task splits alike
            x, ids = unit(rows.column("v")), rows.column("id").to_numpy()
            label = np.arange(len(x))
            whole = [np.arange(len(x))] if rows.column("parts")[0].as_py() > 1 else None
            for own in whole or leaves(x, np.random.default_rng(int(rows.column("g")[0].as_py()))):
                for i, j in close(x[own], threshold):
                    label = graph.hook(label, own[i], own[j])
            linked = np.flatnonzero(label != np.arange(len(x)))
            return pa.table({"u": ids[linked], "v": ids[label[linked]]})

        dealt = own.select("id", "v").mapInArrow(deal, f"g bigint, id bigint, v {kind}")
        big = table(dealt.groupBy("g").count().where(F.col("count") > BIG), "big-groups")
        sized = dealt.join(big, "g", "left").withColumn("parts", F.coalesce(F.ceil(F.col("count") / (BIG / 2)), F.lit(1)).cast("int"))
        found = in_parts(sized, "g", "v").groupBy("g", "p", "q").applyInArrow(compare, "u bigint, v bigint")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return distinct.sparkSession.createDataFrame([], "u bigint, v bigint")
    return out.distinct()


def partners(members: DataFrame, threshold: float) -> DataFrame:
    """(id, others): copies linked to each vector of a component (label, id, n, v), counted exactly.

    A large component is dealt into parts, and each pair of parts is counted
    by itself; nothing but a count for each vector and pair of parts goes on.
    """
    sizes = table(members.groupBy("label").agg(F.count("*").alias("size")), "component-sizes")
    dealt = in_parts(members.join(sizes, "label").withColumn("parts", F.ceil(F.col("size") / PART).cast("int")), "label", "n", "v").drop("parts")
    conf = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        rows = pa.Table.from_batches(rows).sort_by([("label", "ascending"), ("p", "ascending"), ("q", "ascending"), ("own", "ascending")])
        key = np.stack([rows.column(c).to_numpy() for c in ("label", "p", "q")])
        edge = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0), True])
        ids, n, part = (rows.column(c).to_numpy() for c in ("id", "n", "own"))
        for a, b in zip(edge[:-1], edge[1:]):
            x = unit(rows.column("v").slice(a, b - a))
            total = np.zeros(b - a, np.int64)
            mine = part[a:b]
            for i in range(0, b - a, TILE):
                for j in range(0, b - a, TILE):
                    linked = x[i : i + TILE] @ x[j : j + TILE].T >= threshold
                    if key[1, a] != key[2, a]:
                        linked &= mine[i : i + TILE, None] != mine[None, j : j + TILE]
                    elif i == j:
                        np.fill_diagonal(linked, False)
                    total[i : i + TILE] += linked @ n[a + j : min(a + j + TILE, b)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array(total)], names=["id", "k"])

    tasks = max(conf, int(np.ceil(sizes.agg(F.sum(F.col("size") * F.ceil(F.col("size") / PART))).first()[0] or 0) / PER_TASK))
    counted = dealt.repartition(tasks, "label", "p", "q").mapInArrow(run, "id bigint, k bigint")
    return counted.groupBy("id").agg(F.sum("k").alias("others"))


def classes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, sample: int = SAMPLE, trees: int = TREES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    v = F.col(vector)
    keys = [F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2")]
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v"), valid(vec_id, vector).alias("ok"), *keys)
    distinct = rows.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v"))
    distinct = table(distinct.withColumn("dim", F.size("v")), "distinct-vectors")
    labels = table(graph.components(near(distinct, threshold, sample, trees)).withColumnRenamed("node", "id"), "labels")
    counts = partners(distinct.select("id", "n", "v").join(labels, "id"), threshold)
    classed = distinct.select("h1", "h2", "id", "n").join(counts, "id", "left").join(labels, "id", "left")
    classed = table(classed.select("h1", "h2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("label", "id").alias("component_id")), "classed")
    narrowed = rows.select("id", *[F.when(F.col("ok"), F.col(h)).alias(h) for h in ("h1", "h2")])
    out = narrowed.join(classed, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def digest(vectors: DataFrame) -> DataFrame:
    return classes(vectors.select("vec_id", "embedding"))
