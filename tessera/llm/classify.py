"""Quality and toxicity scores of whole documents by small convolutional networks.

Both train on labelled rows whose crc32(id as text) mod 5 is not 0. One eighth of them is
kept from the fit and calibrates the scores, and for toxicity also a threshold for each
language; then the network is fitted a little further, at a lower rate, on all of them.
Labels, language, source and id are never inputs of a score.

Quality trains on the driver on a bounded sample: at most ``sample`` ids, taken in the
order of a hash of their ids, one text for each id (the least hash of those of a repeated
id), and only texts of at most ``sample_bytes`` bytes (this bounds training alone; scoring
covers whole texts of any length). So the driver gets at most sample x sample_bytes
bytes: 256 MB.

Toxicity trains on every labelled row and on whole texts, in the executors. The rows
(equal texts of an id once) are dealt by a hash into parts of about ``part_rows`` rows or
``part_bytes`` bytes, of which a task holds one. The fullest part starts the network; then
each part visits each of its rows from the common weights and the changes are
averaged: of a word's bucket over the parts that changed it, of all else by rows. The
driver gets the sums of sqrt(parts) groups of parts, 2.4 MB each, and the calibration
rows as counts by language, label and logit to three places. One part alone is trained
as a whole.

Defined results: null and empty texts get the score of an empty text; repeated
rows get equal scores; without any labelled row the network stays as it was
initialised; an empty table gives an empty result; other columns are kept, and
columns of the added names are replaced. A row with a null id counts as held out.
A table without a language column, and a language without a threshold, use that of
no language, else TOXIC_AT.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from tessera.llm import nets, words
from tessera.llm.blocks import map_blocks, small_batches
from tessera.store import cut, spent

FOLDS = 5
KEEP_AT = 0.3
TOXIC_AT = 0.5
SEATS = 1 << 25  # bits of the map of labelled ids: 4 MB


def fold(doc_id: str) -> Column:
    """crc32 of the id as text, modulo FOLDS; 0 is held out."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % FOLDS


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int, sample_bytes: int, doc_id: str, text: str, lang: str | None) -> pa.Table:
    """The bounded training sample, in a fixed order."""
    one = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (fold(doc_id) != 0)).groupBy(doc_id).agg(F.max(label).alias("_y"))
    picked = one.orderBy(F.xxhash64(doc_id), doc_id).limit(sample)
    extra = [F.col(lang).cast("string").alias("lang")] if lang and lang in docs.columns else [F.lit(None).cast("string").alias("lang")]
    own = docs.where(F.col(text).isNotNull() & (F.octet_length(text) <= sample_bytes)).select(doc_id, F.col(text).alias("t"), *extra)
    joined = own.join(F.broadcast(picked), doc_id).select(F.col(doc_id).cast("string").alias("k"), "t", "lang", F.col("_y").cast("float").alias("y"))
    one = joined.groupBy("k").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t", "lang", "y")).alias("x")).select("k", "x.t", "x.lang", "x.y")
    rows = one.toArrow()
    return rows.sort_by([("k", "ascending"), ("t", "ascending")])


class Model:
    """A network with its calibration."""

    def __init__(self, net, a: float = 1.0, b: float = 0.0):
        self.net, self.a, self.b = net, a, b

    def score(self, column: pa.Array) -> np.ndarray:
        # single precision sums differ in the last digits with the block around a text
        return np.round(nets.sigmoid(self.a * self.net.logits(self.net.prepare(*words.utf8(column))) + self.b).astype(np.float64), 6)


def on_driver(net, rows: pa.Table, visits: int, batch: int, rate: float) -> Model:
    """``net`` trained on these rows."""
    y = rows.column("y").to_numpy().astype(np.float32)
    docs = [net.prepare(*words.utf8(pa.array([t]))) for t in rows.column("t").to_pylist()]
    held = np.array([zlib.crc32(b"calibrate" + k.encode()) % 8 == 0 for k in rows.column("k").to_pylist()], bool)
    fit = np.flatnonzero(~held)
    nets.fit(net, [docs[i] for i in fit], y[fit], visits, batch, rate)
    logits = np.array([net.logits(d)[0] for d in docs]) if docs else np.zeros(0)
    a, b = nets.platt(logits[held], y[held])
    nets.fit(net, docs, y, visits // 4, batch, rate / 4)
    return Model(net, a, b)


def scored(docs: DataFrame, model: Model, text: str, into: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_blocks(docs, text, lambda block: {into: shared.value.score(block.column(text))}, [StructField(into, DoubleType())], most=1 << 18)


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = 4000, sample_bytes: int = 1 << 16, visits: int = 20000, doc_id: str = "doc_id", text: str = "text") -> Model:
    return on_driver(nets.ByteNet(), labelled(docs, labels, "quality", sample, sample_bytes, doc_id, text, None), visits, 32, 0.01)


def quality(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 by the byte network."""
    return scored(docs, model, text, into)


def _seat(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SEATS))


def seated(docs: DataFrame, ids: DataFrame, doc_id: str) -> DataFrame:
    """``docs`` but for most rows whose id is not among ``ids``, by a map of SEATS bits, so that no join moves their texts."""
    seat = _seat(doc_id)
    maps = ids.groupBy(F.shiftright(seat, 15).alias("_map")).agg(F.bitmap_construct_agg(seat.bitwiseAND(F.lit(32767))).alias("_bits"))
    place = seat.bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    taken = F.getbit(byte, place.bitwiseAND(F.lit(7))) == 1
    return docs.join(F.broadcast(maps), (F.shiftright(seat, 15) == F.col("_map")) & taken, "left_semi")


def dealt(docs: DataFrame, labels: DataFrame, label: str, part_rows: int, part_bytes: int, doc_id: str, text: str, lang: str) -> tuple[DataFrame, int]:
    """Every labelled row outside the held-out fold, whole, in partitions that fit a task and in a fixed order in each; and how many."""
    known = labels.select(F.col(doc_id).try_cast(docs.schema[doc_id].dataType).alias("_id"), F.col(label).cast("float").alias("y"))
    one = known.where(F.col("y").isNotNull() & F.col("_id").isNotNull() & (fold("_id") != 0)).groupBy("_id").agg(F.max("y").alias("y"))
    spoken = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), F.coalesce(spoken, F.lit("")).alias("lang"))
    own = seated(own.where(F.col("_id").isNotNull() & (fold("_id") != 0)), one.select("_id"), "_id")
    rows, size = own.agg(F.count("t"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    parts = max(1, -(-rows // part_rows), -(-size // part_bytes))
    # one deal for texts and labels: a join would move the texts again, or into another number of parts
    mixed = own.withColumn("y", F.lit(None).cast("float")).unionByName(one, allowMissingColumns=True).repartition(parts, "_id")
    full = mixed.withColumn("y", F.max("y").over(Window.partitionBy("_id"))).where(F.col("t").isNotNull() & F.col("y").isNotNull())
    once = full.groupBy("_id", "t").agg(F.min("lang").alias("lang"), F.max("y").alias("y"))
    key = F.col("_id").cast("string")
    held = F.crc32(F.encode(F.concat(F.lit("calibrate"), key), "UTF-8")) % 8 == 0
    return cut(once.select("t", "lang", "y", held.alias("held"), key.alias("k")).sortWithinPartitions("k", "t")), parts


def _packed(p: dict[str, np.ndarray], kind: type) -> bytes:
    return np.concatenate([p[k].ravel().astype(kind) for k in sorted(p)]).tobytes()


def _unpacked(data: bytes, like: dict[str, np.ndarray], kind: type) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(data, kind), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def trained(net: nets.WordNet, rows: DataFrame, groups: int, visits: int, batch: int, rate: float) -> None:
    """One round: each partition fits a copy of ``net`` to its rows, each row at least once, and ``net`` takes the mean change."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def fit(batches):
        docs, y = [], []
        own = nets.WordNet()
        for block in batches:
            docs += [own.prepare(*words.utf8(pa.array([t]))) for t in block.column("t").to_pylist()]
            y += block.column("y").to_pylist()
        if not y:
            return
        part, start = TaskContext.get().partitionId(), shared.value.p
        own.p = {k: v.copy() for k, v in start.items()}
        nets.fit(own, docs, np.array(y, np.float32), max(visits, len(y)), batch, rate)
        change = {k: own.p[k] - start[k] for k in start}
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "grp": pa.array([part % groups], pa.int32()), "n": pa.array([len(y)], pa.int64()), "change": pa.array([_packed(change, np.float32)], pa.binary())})

    def add(batches):
        total, touched, n, first = None, None, 0, None
        for block in batches:
            for part, own, data in zip(*(block.column(c).to_pylist() for c in ("part", "n", "change"))):
                change = _unpacked(data, shared.value.p, np.float32)
                if total is None:
                    total, touched, first = {k: np.zeros(v.shape) for k, v in change.items()}, np.zeros(len(change["e"]), np.int32), part
                for k, v in change.items():
                    total[k] += v if k == "e" else own * v.astype(np.float64)
                touched += (change["e"] != 0).any(1)
                n += own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([first], pa.int32()), "n": pa.array([n], pa.int64()), "touched": pa.array([touched.tobytes()], pa.binary()), "change": pa.array([_packed(total, np.float64)], pa.binary())})

    changes = rows.select("t", "y").mapInArrow(fit, "part int, grp int, n long, change binary")
    sums = changes.repartition(groups, "grp").sortWithinPartitions("part").mapInArrow(add, "part int, n long, touched binary, change binary").collect()
    sums.sort(key=lambda r: r.part)
    if sums:
        n, touched = sum(r.n for r in sums), sum(np.frombuffer(r.touched, np.int32) for r in sums)
        whole = [_unpacked(r.change, net.p, np.float64) for r in sums]
        for k, v in net.p.items():
            change = sum(w[k] for w in whole)
            v += (change / np.maximum(touched, 1)[:, None] if k == "e" else change / n).astype(v.dtype)
    shared.destroy()


def answers(net: nets.WordNet, rows: DataFrame) -> pa.Table:
    """Counts of rows by language, label and logit to three places."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def judge(batches):
        for block in words.blocks(batches, "t", 1 << 18):
            z = shared.value.logits(shared.value.prepare(*words.utf8(block.column("t"))))
            yield pa.RecordBatch.from_arrays([block.column("lang"), block.column("y"), pa.array(np.round(np.clip(z, -40, 40) * 1000).astype(np.int32))], names=["lang", "y", "z"])

    found = rows.select("t", "lang", "y").mapInArrow(judge, "lang string, y float, z int")
    out = found.groupBy("lang", "y", "z").agg(F.count(F.lit(1)).alias("n")).toArrow()
    shared.destroy()
    return out.sort_by([(c, "ascending") for c in ("lang", "y", "z")])


def train_toxicity(docs: DataFrame, labels: DataFrame, part_rows: int = 8192, part_bytes: int = 1 << 26, visits: int = 16000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[Model, dict[str, float]]:
    """The word network and a threshold for each language among the labelled rows."""
    small_batches(docs.sparkSession)
    net, batch, rate = nets.WordNet(), 32, 0.003
    rows, parts = dealt(docs, labels, "toxic", part_rows, part_bytes, doc_id, text, lang)
    fit, groups = rows.where(~F.col("held")), math.isqrt(parts)
    if parts == 1:
        trained(net, fit, groups, visits, batch, rate)
    else:
        part = F.spark_partition_id()
        fullest = fit.groupBy(part.alias("part")).count().orderBy(F.desc("count"), "part").first()
        if fullest:
            trained(net, fit.where(part == fullest.part), 1, visits, batch, rate)
        trained(net, fit, groups, visits // parts, batch, rate)
    held = answers(net, rows.where("held"))
    y, z, n = (held.column(c).to_numpy() for c in ("y", "z", "n"))
    a, b = nets.platt(z / 1000, y, n)
    score, langs = nets.sigmoid(a * (z / 1000) + b), np.array(held.column("lang").to_pylist(), object)
    trained(net, rows, groups, visits // 4 // parts, batch, rate / 4)
    spoken = sorted(r.lang for r in rows.select("lang").distinct().collect())
    spent(rows)
    return Model(net, a, b), {x: threshold(*(v[langs == x] for v in (score, y, n))) for x in spoken}


def threshold(score: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The threshold with the best F1 among tenths, the one nearest to TOXIC_AT among equals; rows are there ``n`` times."""
    best = (-1.0, 0.0, TOXIC_AT)
    for t in np.arange(1, 10) / 10:
        said = score >= t
        f1 = 2 * n[said & (y > 0)].sum() / max(1, n[said].sum() + n[y > 0].sum())
        best = max(best, (f1, -abs(t - TOXIC_AT), float(t)))
    return best[2]


def toxicity(docs: DataFrame, model: Model, thresholds: dict[str, float], text: str = "text", lang: str = "lang", into: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1, the language's threshold, and whether the score reaches it."""
    known = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair]) if thresholds else F.create_map().cast("map<string,double>")
    own = F.try_element_at(known, F.coalesce(F.col(lang).cast("string"), F.lit(""))) if lang in docs.columns else F.try_element_at(known, F.lit(""))
    own = F.coalesce(own, F.lit(TOXIC_AT))
    return scored(docs, model, text, into).withColumn("threshold", own).withColumn("flagged", F.col(into) >= F.col("threshold"))


def digest(found: DataFrame, at: float, *more: str) -> DataFrame:
    return found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"), *more)
