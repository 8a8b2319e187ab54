"""Sharding by a k-d tree over document metadata, with DataFrame functions only.

Equal texts form one group, which stays in one shard unless the group alone is
larger than ``split_share`` of a shard; such a group is dealt in pieces by the
hash of its ids, so that no copied text can unbalance the shards. The tree
splits the node's groups at the weighted median along the metadata dimension in
which the node is widest, until the leaves reach the target bytes (a shard's
share of the total).

A dimension's value and a hash of the group make one ordered 62-bit key; the
median is found by counting bytes in 2**FAN_BITS ranges of the key and descending
into the range that holds it until that has one group, LEVELS times at most. A count
has a row for each node and range, however large the table is; the driver gets one
row for each node, and no ids or groups.

Law ``bytes``: sizes of the shards are near equal.

Defined results: a null text has no bytes (size 1, checksum 0) and an empty one
likewise; both form one group. A null id is dealt like any other value. Repeated
rows are rows of their own. Ids are numbers, or texts of numbers. An empty table
gives an empty result; other columns are not carried. Slots follow ids within hash
ranges of the written rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.store import spent, table

SHARDS = 8
SPLIT_SHARE = 1 / 32
FAN_BITS = 12
SLOT_ROWS = 20_000  # mean rows of a hash range over all shards
LEVELS = 5  # descents of FAN_BITS bits cover the key
KEY_BITS = FAN_BITS * LEVELS
VALUE_BITS = 24
DIMS = ["length", "source", "lang", "position"]


def sized(docs: DataFrame, doc_id: str, text: str, meta: list[str]) -> DataFrame:
    """Narrow rows: id, size, checksum, a hash of the text, and the metadata values."""
    none = F.lit(None).cast("string")
    columns = [F.col(c).cast("string") if c in docs.columns else none for c in meta]
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("g"),
        *[c.alias(m) for c, m in zip(columns, meta)],
    )


def pieces(rows: DataFrame, shards: int) -> DataFrame:
    """Groups too large for one piece and their numbers of pieces: at most shards / SPLIT_SHARE rows."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    most = max(1.0, total / shards * SPLIT_SHARE)
    groups = rows.groupBy("g").agg(F.sum("size").alias("weight"))
    return groups.where(F.col("weight") > most).select("g", F.ceil(F.col("weight") / most).cast("int").alias("n"))


def unit(value: Column) -> Column:
    """A hash as a number in [0, 1)."""
    return F.pmod(F.xxhash64(value), F.lit(1 << VALUE_BITS)) / F.lit(float(1 << VALUE_BITS))


def metadata(groups: DataFrame) -> DataFrame:
    """Each dimension scaled to [0, 1)."""
    top = groups.agg(F.max("size").alias("size"), F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    span = float((top["hi"] or 0) - (top["lo"] or 0)) + 1.0
    scale = F.log2(F.lit(float((top["size"] or 0) + 2)))
    return groups.select(
        "g",
        "piece",
        "weight",
        (F.log2(F.col("size") + 1) / scale).alias("length"),
        unit(F.coalesce("source", F.lit(""))).alias("source"),
        unit(F.coalesce("lang", F.lit(""))).alias("lang"),
        F.coalesce((F.col("at") - F.lit(top["lo"] or 0)) / span, F.lit(0.0)).alias("position"),
        F.shiftrightunsigned(F.xxhash64("g", "piece"), 64 - (KEY_BITS - VALUE_BITS)).alias("tie"),
    )


def split(groups: DataFrame) -> DataFrame:
    """``groups`` with their node doubled by one split at the weighted median of the widest dimension."""
    w = F.col("weight").cast("double")
    wide = groups.groupBy("node").agg(*[(F.sum(w * F.col(d) * F.col(d)) / F.sum(w) - F.pow(F.sum(w * F.col(d)) / F.sum(w), F.lit(2.0))).alias(d) for d in DIMS])
    order = F.array_sort(F.array(*[F.struct((-F.col(d)).alias("v"), F.lit(i).alias("i")) for i, d in enumerate(DIMS)]))
    axis = wide.select("node", order[0]["i"].alias("axis"))
    value = F.get(F.array(*[F.col(d) for d in DIMS]), F.col("axis"))
    fixed = F.least(F.floor(value * (1 << VALUE_BITS)), F.lit((1 << VALUE_BITS) - 1)).cast("long")
    keyed = groups.join(F.broadcast(axis), "node").withColumn("key", F.shiftleft(fixed, KEY_BITS - VALUE_BITS) + F.col("tie"))
    # nodes number at most the shards, so what is broadcast below has a row for each shard
    found = keyed.groupBy("node").agg(F.sum("weight").alias("all")).select("node", F.lit(0).cast("long").alias("from"), F.lit(0).cast("long").alias("before"), "all", F.lit(0).cast("long").alias("upto"))
    for step in range(LEVELS):
        bits = KEY_BITS - FAN_BITS * (step + 1)
        inside = keyed.join(F.broadcast(found.drop("upto")), "node").where(F.shiftright("key", bits + FAN_BITS) == F.shiftright("from", bits + FAN_BITS))
        counts = inside.groupBy("node", "before", "all", F.shiftright("key", bits).alias("range")).agg(F.sum("weight").alias("w"), F.count("*").alias("k"))
        run = counts.withColumn("upto", F.col("before") + F.sum("w").over(Window.partitionBy("node").orderBy("range")))
        found = (
            run.where(F.col("upto") * 2 >= F.col("all"))
            .groupBy("node", "all")
            .agg(F.min_by(F.struct("range", (F.col("upto") - F.col("w")).alias("b"), "upto", "k"), "range").alias("x"))
            .select("node", F.shiftleft(F.col("x.range"), bits).alias("from"), F.shiftleft(F.col("x.range") + 1, bits).alias("to"), F.col("x.b").alias("before"), "all", F.col("x.upto").alias("upto"), F.col("x.k").alias("k"))
        )
        nodes = found.collect()
        found = found.sparkSession.createDataFrame(nodes, found.schema)
        if all(r["k"] == 1 for r in nodes):
            break
        found = found.drop("to", "k") if step + 1 < LEVELS else found
    # the group at the median goes to the side that it leaves nearer to half
    left = (F.col("before") > 0) & (F.col("upto") * 2 - F.col("all") > F.col("all") - F.col("before") * 2)
    right = F.when(left, F.col("key") >= F.col("from")).otherwise(F.col("key") >= F.col("to"))
    return keyed.join(F.broadcast(found), "node").withColumn("node", F.col("node") * 2 + right.cast("int")).drop("axis", "key", "from", "to", "before", "all", "upto", "k")


def assign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards of near equal bytes. ``shards`` is a power of two."""
    depth = shards.bit_length() - 1
    if 1 << depth != shards:
        raise ValueError("shards must be a power of two")
    rows = table(sized(docs, doc_id, text, ["source", "lang"]), "sized")
    dealt = rows.join(F.broadcast(pieces(rows, shards)), "g", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("n")), F.lit(0)).cast("int")).drop("n")
    grouped = dealt.groupBy("g", "piece").agg(
        F.sum("size").alias("weight"), F.max("size").alias("size"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.min(F.col("doc_id").cast("double")).alias("at")
    )
    groups = table(metadata(grouped).withColumn("node", F.lit(0)), "groups")
    for level in range(depth):
        before, groups = groups, table(split(groups), f"level{level}")
        spent(before)
    placed = dealt.join(groups.select("g", "piece", F.col("node").alias("shard")), ["g", "piece"])
    placed = table(placed.select("doc_id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("_u")), "placed")
    spent(rows, groups)
    return slots(placed)


def slots(placed: DataFrame) -> DataFrame:
    """``placed`` with a gapless slot in each shard: places of hash ranges, then places inside them.

    Ranges are of a number (_u) that each written row has for itself, so repeated rows do not crowd one of them.
    """
    n = max(64, math.ceil(placed.count() / SLOT_ROWS))
    ranged = placed.withColumn("_b", F.pmod(F.xxhash64("_u"), F.lit(n)).cast("int"))
    counts = ranged.groupBy("shard", "_b").count()
    before = counts.select("shard", "_b", (F.sum("count").over(Window.partitionBy("shard").orderBy("_b")) - F.col("count")).alias("_from"))
    inside = F.row_number().over(Window.partitionBy("shard", "_b").orderBy("doc_id", "text_crc32", "_u")) - 1
    return ranged.withColumn("_i", inside).join(before, ["shard", "_b"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_from") + F.col("_i")).cast("long").alias("slot")
    )


def digest(docs: DataFrame) -> DataFrame:
    """Shard and slot by document, with the law that holds."""
    return assign(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
