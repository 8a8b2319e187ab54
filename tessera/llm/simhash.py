"""SimHash near-duplicates found with BK-trees.

Fingerprints that differ in at most RADIUS bits agree on some of their blocks:
with ``blocks`` of them, on blocks - RADIUS at least. Each choice of that many
blocks gives a shard of fingerprints with equal values there, so every link
falls inside a shard. A shard's distinct fingerprints form a BK-tree (children
keyed by their Hamming distance to the parent), and a search follows only edges
within the radius. All trees of a task are built and searched together, level
by level. A shard of more than ``most`` fingerprints is dealt into parts, and
each pair of parts becomes a tree of its own, so no task gets an unbounded
group and no link is lost. Each shard gives only a spanning forest of its links. A tree
is built where its shard was dealt and searched there, instead of being broadcast: all
fingerprints that could link to it are in the shard, and what is broadcast to every
machine would grow with the table.

Equal fingerprints are merged before anything else. Shingles are of 3 words, as
the query's contract asks; ``width`` and ``radius`` are parameters.

:func:`dedup_similar` removes texts whose distinct shingles of ``width`` words
have a Jaccard similarity of ``like`` or more. Texts near to each other share one of
BANDS keys of ROWS least hashes: a pair at 0.8 shares none with a chance of 2 in
100,000, a closer one with less, whatever the table's size. A key's texts are a shard.
Fingerprints of the distinct shingles propose pairs, at a radius that a pair at 0.8
exceeds with a chance below 1 in 10,000 (it differs in 9.7 bits, with a deviation of
2.9); the shingles' hashes themselves decide each. First each shard's texts meet one of
them, another for each key, so that groups of similar texts become components by few
pairs. Then shards that still hold several components become BK-trees over their
fingerprints, dealt in pairs of parts; each search decides its pairs in its task, each
pair in the first shard that it shares, and gives only links that unite components. So
no list of pairs is made, however large and loose a group of near copies is.

Defined results: a null, empty or wordless text has fingerprint zero, linked
like any other; a text of fewer words than a shingle is one shingle; rows with
a null id take part, and component_id is the smallest id that is not null (null
if there is none); repeated rows share a component; an empty table gives an
empty result; other columns are carried by :func:`dedup` unchanged.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField

from tessera.llm import words
from tessera.llm.blocks import lists, map_blocks, whole_groups
from tessera.operators import graph
from tessera.store import spent, table

WIDTH, RADIUS, SEED = 3, 3, 42
MOST = 512  # fingerprints of one tree
PER_TASK = 100_000  # fingerprints of all trees in a task

# of dedup_similar
WIDE, LIKE = 5, 0.8
BANDS, ROWS = 36, 6
WIDE_RADIUS = 24  # bits
MOST_LONG = 1024  # texts of one tree
TREE_BYTES = 32 << 20  # of shingle hashes of all trees in a task


def shingles(raw: bytes, width: int) -> list[int]:
    """Hashes of a text's shingles, repeats included."""
    digest = xxhash.xxh64_intdigest
    own = raw.translate(_LOWER).split()  # bytes split on 0x20 and 0x09 to 0x0D
    line = b" ".join(own)
    if len(own) <= width:
        return [digest(line, SEED)] if own else []
    end = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    start = np.r_[0, end[:-1] + 1]
    return [digest(line[a:b], SEED) for a, b in zip(start[: len(own) - width + 1].tolist(), end[width - 1 :].tolist())]


def majority(hashed: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHash of each run of hashes; a bit is 1 if set in over half of them."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        bits = np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(ones * 2 > sizes[some][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint(texts: list[bytes], width: int = WIDTH) -> np.ndarray:
    """SimHash of each text, as unsigned 64-bit integers."""
    each = [shingles(raw, width) for raw in texts]
    return majority(np.array([h for own in each for h in own], np.uint64), np.array([len(x) for x in each], np.int64))


def sketch(texts: list[bytes], width: int = WIDE, bands: int = BANDS, rows: int = ROWS) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Sorted hashes of each text's distinct shingles, for each text a row of band keys, and their SimHash."""
    each = [np.unique(np.array(shingles(raw, width), np.uint64)) for raw in texts]
    sizes = np.array([len(x) for x in each], np.int64)
    keys = np.zeros((len(texts), bands), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        hashed, first = np.concatenate(each), (np.cumsum(sizes) - sizes)[some]
        odd = words.mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
        for band in range(bands):
            key = np.full(len(some), band, np.uint64)
            for by in odd[band * rows : (band + 1) * rows]:
                key = words.mix(key ^ np.minimum.reduceat(words.mix(hashed * by), first))
            keys[some, band] = key
    return [x.tobytes() for x in each], keys, majority(np.concatenate(each) if each else np.zeros(0, np.uint64), sizes)


_LOWER = bytes(words.LOWER)


def with_fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint", width: int = WIDTH, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with the fingerprint as a (signed) long."""

    def work(block: pa.RecordBatch) -> dict:
        column = block.column(text).cast(pa.large_binary())
        return {into: fingerprint([x or b"" for x in column.to_pylist()], width).view(np.int64)}

    return map_blocks(docs, text, work, [StructField(into, LongType())], drop)


def with_sketches(docs: DataFrame, text: str, width: int, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with the number of shingles (n), a hash of them all (fp), their SimHash (print) and the band keys (bands)."""

    def work(block: pa.RecordBatch) -> dict:
        column = block.column(text).cast(pa.large_binary())
        own, keys, prints = sketch([x or b"" for x in column.to_pylist()], width)
        places = np.arange(len(own) + 1) * keys.shape[1]
        return {
            "n": np.array([len(x) // 8 for x in own], np.int32),
            "fp": np.array([xxhash.xxh64_intdigest(x, SEED) for x in own], np.uint64).view(np.int64),
            "print": prints.view(np.int64),
            "bands": lists(pa.array(keys.view(np.int64).ravel()), places),
        }

    fields = [StructField("n", IntegerType()), StructField("fp", LongType()), StructField("print", LongType()), StructField("bands", ArrayType(LongType()))]
    return map_blocks(docs, text, work, fields, drop)


class Forest:
    """BK-trees of several groups of distinct fingerprints; x (or each of its rows, for long ones) sorted by group."""

    def __init__(self, x: np.ndarray, group: np.ndarray):
        self.lanes = np.atleast_2d(x)
        self.edges = 64 * len(self.lanes) + 1  # distances that an edge may have
        n = self.lanes.shape[1]
        first = np.r_[True, group[1:] != group[:-1]] if n else np.zeros(0, bool)
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        todo = np.flatnonzero(~first)
        at = self.root[todo]
        keys, children = [], []
        while len(todo):
            key = at * self.edges + self.distance(todo, at)
            found, place, back = np.unique(key, return_index=True, return_inverse=True)
            child = todo[place]
            keys.append(found)
            children.append(child)
            stays = np.ones(len(todo), bool)
            stays[place] = False
            todo, at = todo[stays], child[back][stays]
        self.key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.child = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(self.key)
        self.key, self.child = self.key[order], self.child[order]

    def distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in self.lanes)

    def search(self, query: np.ndarray, radius: int):
        """Pairs (query, node) within the radius, level by level."""
        q, node = query, self.root[query]
        while len(q):
            d = self.distance(q, node)
            near = (d <= radius) & (q != node)
            yield q[near], node[near]
            lo = np.searchsorted(self.key, node * self.edges + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.key, node * self.edges + np.minimum(d + radius, self.edges - 1), "right")
            count = hi - lo
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            q, node = np.repeat(q, count), self.child[at]


def forest_links(x: np.ndarray, group: np.ndarray, radius: int, step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, least place reached) of all linked fingerprints, inside the groups."""
    trees = Forest(x, group)
    n = len(group)
    label = np.arange(n)
    for at in range(0, n, step):
        for a, b in trees.search(np.arange(at, min(at + step, n)), radius):
            label = graph.hook(label, a, b)
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def shards(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(shard, fp): a row for each choice of blocks - radius blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    cells = [F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) for i in range(blocks)]
    keys = [F.xxhash64(F.lit(n), *[cells[i] for i in choice]) for n, choice in enumerate(combinations(range(blocks), blocks - radius))]
    return prints.select("fp", F.explode(F.array(*keys)).alias("shard"))


def dealt(rows: DataFrame, most: int) -> DataFrame:
    """(tree, fp, ...): large shards as pairs of parts, each part meeting every other and itself."""
    own_columns = [c for c in rows.columns if c != "shard"]
    sizes = table(rows.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1"), "shard-sizes")
    parts = F.ceil(F.col("n") / (most / 2)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("a"), F.greatest(i, F.col("own")).alias("b")))
    split = rows.join(sizes, "shard").withColumn("parts", F.when(F.col("n") <= most, 1).otherwise(parts)).withColumn("own", own)
    return split.select("shard", *own_columns, F.explode(pairs).alias("p")).select(F.xxhash64("shard", "p.a", "p.b").alias("tree"), *own_columns)


def links(prints: DataFrame, radius: int = RADIUS, most: int | None = None, blocks: int | None = None) -> DataFrame:
    """(u, v) edges that connect all fingerprints (fp, distinct) within the radius."""
    most = most or MOST
    n = prints.count()
    if blocks is None:
        blocks = radius + 1
        while blocks < 8 and n / 2 ** (64 * (blocks - radius) / blocks) > most / 4:
            blocks += 1
    trees = dealt(shards(prints, radius, blocks), most)
    conf = prints.sparkSession.conf.get("spark.sql.shuffle.partitions")
    tasks = max(int(conf), ceil(n * len(list(combinations(range(blocks), blocks - radius))) / PER_TASK))

    def run(batches):
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        rows = pa.Table.from_batches(own)
        tree, fp = rows.column("tree").to_numpy(), rows.column("fp").to_numpy().view(np.uint64)
        order = np.lexsort((fp, tree))
        i, j = forest_links(fp[order], tree[order], radius)
        signed = fp[order].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed[i]), pa.array(signed[j])], names=["u", "v"])

    return trees.repartition(tasks, "tree").mapInArrow(run, "u bigint, v bigint")


def with_sets(docs: DataFrame, text: str, width: int) -> DataFrame:
    """``docs`` with the sorted hashes of its text's distinct shingles (own) in the text's stead."""

    def work(block: pa.RecordBatch) -> dict:
        column = block.column(text).cast(pa.large_binary())
        return {"own": pa.array([np.unique(np.array(shingles(x or b"", width), np.uint64)).tobytes() for x in column.to_pylist()], pa.binary())}

    return map_blocks(docs, text, work, [StructField("own", BinaryType())], (text,))


def alike(pairs: DataFrame, sets: DataFrame, like: float) -> DataFrame:
    """The pairs (u, v) whose sets (fp, own) have a Jaccard similarity of ``like`` or more, counted exactly."""

    def run(batches):
        for b in batches:
            x, y = (b.column(c).to_pylist() for c in ("a", "b"))
            keep = np.zeros(b.num_rows, bool)
            for i, (s, t) in enumerate(zip(x, y)):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep[i] = both >= like * (len(s) + len(t) - both) - 1e-9
            yield b.select(["u", "v"]).filter(pa.array(keep))

    left, right = (sets.select(F.col("fp").alias(k), F.col("own").alias(c)) for k, c in (("u", "a"), ("v", "b")))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def tree_links(found: pa.Table, like: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of texts of one tree whose similarity is ``like`` or more; only as many as unite different labels.

    found: band (the same in all rows), fp, size, label, print, bands and own (sorted shingle hashes).
    """
    size, bands = found.column("size").to_numpy().astype(np.int64), np.stack([np.asarray(x) for x in found.column("bands").to_numpy()])
    band = found.column("band")[0].as_py()
    flat = np.frombuffer(b"".join(x.as_py() for x in found.column("own")), np.uint64)
    first = np.cumsum(size) - size
    known, flat = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(known), bool)
    label = np.unique(found.column("label").to_numpy(), return_inverse=True)[1]
    prints, at = np.unique(found.column("print").to_numpy().view(np.uint64), return_inverse=True)
    rows_of = np.argsort(at, kind="stable")
    held = np.bincount(at)
    begin = np.cumsum(held) - held
    tree = Forest(prints, np.zeros(len(prints), np.int64))
    left, right = [], []
    for q in range(len(prints)):
        near = np.concatenate([[q], *(b for _, b in tree.search(np.array([q]), radius))])
        others = np.concatenate([rows_of[begin[x] : begin[x] + held[x]] for x in near.tolist()])
        for i in rows_of[begin[q] : begin[q] + held[q]].tolist():
            j = others[(others > i) & (label[others] != label[i])]
            j = j[np.minimum(size[j], size[i]) >= like * np.maximum(size[j], size[i]) - 1e-6]
            if len(j):
                j = j[(bands[j] == bands[i]).argmax(1) == band]  # a pair of several shards is decided in the first of them
            if not len(j):
                continue
            mark[flat[first[i] : first[i] + size[i]]] = True
            last = np.cumsum(size[j])
            places = np.arange(last[-1]) - np.repeat(last - size[j] - first[j], size[j])
            both = np.add.reduceat(mark[flat[places]], last - size[j], dtype=np.int64)
            mark[flat[first[i] : first[i] + size[i]]] = False
            j = j[both >= like * (size[i] + size[j] - both) - 1e-9]
            if len(j):
                united, one = np.unique(label[j], return_index=True)
                left += [i] * len(one)
                right += j[one].tolist()
                label[np.isin(label, united)] = label[i]
    return np.array(left, np.int64), np.array(right, np.int64)


def apart(rows: DataFrame, sets: DataFrame, like: float, most: int) -> DataFrame:
    """(u, v): similar texts (fp) of one shard and of different labels, as many as unite them.

    rows: shard, band, fp, n, label, print, bands; sets: fp, own.
    """
    trees = table(dealt(rows.withColumnRenamed("n", "size"), most), "long-trees")
    size = trees.agg(F.sum("size")).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(size * 8 / TREE_BYTES))

    def run(batches):
        for found in whole_groups(batches, "tree"):
            i, j = tree_links(found, like, WIDE_RADIUS)
            fp = found.column("fp").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], names=["u", "v"])

    whole = trees.join(sets, "fp").repartition(tasks, "tree").sortWithinPartitions("tree", "fp")
    return whole.mapInArrow(run, "u bigint, v bigint")


def similar_links(prints: DataFrame, texts: DataFrame, width: int = WIDE, like: float = LIKE, most: int | None = None) -> DataFrame:
    """(u, v) edges that connect all sets (fp, n, print, bands, t; distinct) that are similar to ``like`` or more.

    texts: (t, text), from which the shingles of candidates are taken again, so that only those are kept and moved.
    """
    each = prints.where("n > 0").select("fp", "n", "print", F.posexplode("bands").alias("band", "shard"))
    by = F.xxhash64("shard", "fp")
    first = each.groupBy("shard").agg(F.min_by(F.struct("fp", "n", "print"), by).alias("first"), F.count("*").alias("c")).where("c > 1")
    rows = table(each.join(first, "shard").select("shard", "band", "fp", "n", "print", "first", "c"), "sharing")
    fits = F.least("n", "first.n") >= like * F.greatest("n", "first.n") - 1e-6
    close = F.bit_count(F.col("print").bitwiseXOR(F.col("first.print"))) <= WIDE_RADIUS
    stars = rows.where((F.col("fp") != F.col("first.fp")) & fits & close).select(F.least("fp", "first.fp").alias("u"), F.greatest("fp", "first.fp").alias("v"))
    met = table(stars.distinct(), "met")
    named_once = met.select(F.explode(F.array("u", "v")).alias("fp")).union(rows.where("c > 2").select("fp")).distinct()
    some = prints.select("fp", "t").join(named_once, "fp", "left_semi")
    bodies = texts.join(some, "t").groupBy("t", "fp").agg(F.first("text").alias("text"))
    some = table(with_sets(bodies, "text", width).select("fp", "own"), "sets")
    near = table(alike(met, some, like), "near")
    labels = graph.components(near).withColumnRenamed("node", "fp")
    rows2 = table(rows.where("c > 2").join(labels, "fp", "left").select("shard", "band", "fp", "n", "print", F.coalesce("label", "fp").alias("label")), "labelled")
    mixed = rows2.groupBy("shard").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("shard")
    left = rows2.join(mixed, "shard", "left_semi").join(prints.select("fp", "bands"), "fp")
    more = table(apart(left, some, like, most or MOST_LONG), "apart")
    spent(rows, met, some, rows2)
    return near.union(more)


def named(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints (fp, least): the least id of those that the edges connect."""
    labels = graph.components(edges)
    labelled = prints.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    labelled = table(labelled.select("fp", "least", "label"), "labelled-prints")
    least = table(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "least-ids")
    return table(labelled.select("fp", "label").join(least, "label").select("fp", "component_id"), "components")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) for each row."""
    each = table(with_fingerprints(docs.select(doc_id, text), text, "fp", width, (text,)), "prints")
    prints = table(each.groupBy("fp").agg(F.min(doc_id).alias("least")), "distinct-prints")
    return each.join(named(prints, links(prints.select("fp"), radius)), "fp")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each component: that of its smallest id."""
    found = classes(docs, doc_id, text, width, radius)
    keep = found.where(F.col(doc_id).eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("fp").alias("_fp"))
    keep = keep.select(F.col("component_id").alias("_id"), "_fp")
    rows = with_fingerprints(docs, text, "_fp2", width)
    one = rows.join(keep, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_fp2") == F.col("_fp")), "left_semi")
    return one.dropDuplicates([doc_id, "_fp2"]).select(*docs.columns)


def dedup_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDE, like: float = LIKE) -> DataFrame:
    """One row of ``docs`` for each group of similar texts: that of its smallest id."""
    body = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    some = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), body.alias("t"))
    each = table(with_sketches(some, "text", width, ("text",)), "sketches")
    prints = table(each.groupBy("fp").agg(F.min("id").alias("least"), F.min("t").alias("t"), *[F.first(c).alias(c) for c in ("n", "print", "bands")]), "distinct-sets")
    found = each.select("id", "t", "fp").join(named(prints, table(similar_links(prints, some.select("t", "text"), width, like), "similar")), "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    # several texts may have the group's id, and a row may be there twice
    rows = found.groupBy("component_id", "t").agg(F.count("*").alias("_n"))
    keep = table(rows.groupBy("component_id").agg(F.min_by(F.struct("t", "_n"), "t").alias("x")).select(F.col("component_id").alias("_id"), F.col("x.t").alias("_t"), F.col("x._n").alias("_n")), "kept")
    one = docs.join(keep, F.col(doc_id).eqNullSafe(keep["_id"]) & (body == keep["_t"]), "left_semi")
    return one if keep.where("_n > 1").isEmpty() else one.dropDuplicates([doc_id, text])


def digest(docs: DataFrame) -> DataFrame:
    hexed: Column = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return classes(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")
