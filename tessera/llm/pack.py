"""Packing token sequences with minimum bin slack.

A document's ids are cut into whole windows and a rest. The rests' lengths form
a histogram of fewer than ``window`` entries, whatever the table's size, and
that alone reaches the driver. There, minimum bin slack plans sequences: the
longest rest left is an anchor, a bitset subset-sum over the multiset of
remaining lengths finds what fills the window closest to capacity, backtracking
gives the count of each length, and the pattern is used as often as the counts
allow. Where the best fill leaves slack, the anchor's length goes to a stream
instead, which is laid end to end and cut at window boundaries; the stream's
end is cut into powers of two. So nothing is padded.

Rows learn their place from their rank within their length: counts of hash
buckets (a length with many rows has many) give where a bucket starts, and a
row number its place inside, so a length that a third of all rows share is no
single task.

Ids are those of the given tokenizers file without special tokens, then id 1. A
file of plain byte-level BPE (no normalizer, the usual pattern, merges in the order
of their ids) is encoded by tiktoken from the same vocabulary, and by tokenizers
itself for texts that hold a special token's string; any other file by tokenizers.

Defined results: a null or empty text is the single closing id; repeated rows
are packed each; a null id is carried; an empty table gives an empty result;
columns other than the id and the text are not carried.
"""

from __future__ import annotations

import json
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tessera.llm import words
from tessera.llm.blocks import small_batches
from tessera.store import spent, table

WINDOW = 2048
END_ID = 1
BUCKET_ROWS = 512
FEW = 100_000  # cut rows whose keys may be broadcast


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def plain_byte_bpe(model: dict) -> bool:
    """Whether a tokenizers file does no more than byte-level BPE with the usual pattern."""
    pre, bpe = model.get("pre_tokenizer") or {}, model["model"]
    if model.get("normalizer") or model.get("truncation") or model.get("post_processor") or bpe.get("type") != "BPE":
        return False
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return False
    if any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    order = [bpe["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in bpe["merges"]]
    return all(a < b for a, b in zip(order, order[1:])) and order[:1] != [-1]


@cache
def encoder(path: str):
    """A function from text to its ids under the tokenizers file at ``path``, which each machine has."""
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    if not plain_byte_bpe(model):
        return lambda text: own.encode(text, add_special_tokens=False).ids
    # byte-level files write printable bytes as themselves and the others as U+0100 onwards
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = [t["content"] for t in model["added_tokens"]]
    ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        if any(s in text for s in special):
            return own.encode(text, add_special_tokens=False).ids
        try:
            return fast.encode_ordinary(text)
        except Exception as e:  # its pattern engine gives up on some very long runs
            if isinstance(e, MemoryError):
                raise
            return own.encode(text, add_special_tokens=False).ids

    return ids


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, with_ids: bool = False, window: int = WINDOW) -> DataFrame:
    """A row for each whole window and rest of each document; ids only on request.

    (doc_id, t, start, length, ids_crc32, doc_tokens[, ids]); t is a hash of the text.
    """
    small_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    fields = [rows.schema["doc_id"], StructField("t", LongType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType()), StructField("doc_tokens", LongType())]
    if with_ids:
        fields.append(StructField("ids", ArrayType(IntegerType())))
    schema = StructType(fields)

    def run(batches):
        encode = encoder(path)
        for block in words.blocks(batches, "text"):
            owner, start, length, crc, total, every = [], [], [], [], [], []
            for i, text in enumerate(block.column("text").to_pylist()):
                ids = np.array([*encode(text), END_ID], np.uint32)
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    owner.append(i)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(checksum(piece))
                    total.append(len(ids))
                    if with_ids:
                        every.append(piece.astype(np.int32))
            arrays = [block.column("doc_id").take(pa.array(owner, pa.int64())), block.column("t").take(pa.array(owner, pa.int64()))]
            arrays += [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            if with_ids:
                arrays.append(pa.array(every, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)


# --- the plan --------------------------------------------------------------------


def fill(counts: np.ndarray, room: int) -> tuple[int, dict[int, int]]:
    """The sum nearest below ``room`` of lengths with these counts, and how many of each give it."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, part = min(int(counts[length]), room // length), 1
        while left:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (take * length)) & mask
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    best = at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= take * length
    return best, chosen


class Plan:
    """Where the n-th row of each length goes.

    slots: (length, first rank, rows of this length in a sequence, first
    sequence, first offset); in the stream, rows in a sequence is 0 and the
    first offset is the place in the stream.
    """

    def __init__(self, histogram: dict[int, int], window: int = WINDOW):
        self.window = window
        counts = np.zeros(window + 1, np.int64)
        for length, n in histogram.items():
            counts[length] = n
        used, slots, sequence, stream = np.zeros(window + 1, np.int64), [], 0, 0
        for anchor in range(window, 0, -1):
            while counts[anchor]:
                counts[anchor] -= 1
                best, chosen = fill(counts, window - anchor)
                counts[anchor] += 1
                if best < window - anchor:
                    slots.append((anchor, used[anchor], 0, 0, stream))
                    stream += anchor * int(counts[anchor])
                    used[anchor] += counts[anchor]
                    counts[anchor] = 0
                    continue
                chosen[anchor] = chosen.get(anchor, 0) + 1
                times = min(int(counts[x]) // k for x, k in chosen.items())
                offset = 0
                for x, k in sorted(chosen.items(), reverse=True):
                    slots.append((x, used[x], k, sequence, offset))
                    offset += x * k
                    used[x] += k * times
                    counts[x] -= k * times
                sequence += times
        slots.sort()
        self.slots = np.array(slots, np.int64).reshape(-1, 5)
        self.stream_from, whole = sequence, stream // window
        ends, at = [], whole * window
        for bit in range(window.bit_length() - 1, -1, -1):
            if (stream - at) >> bit & 1:
                at += 1 << bit
                ends.append(at)
        self.whole, self.ends = whole, np.array(ends, np.int64)

    def place(self, length: np.ndarray, rank: np.ndarray):
        """Row number, part's start in the row, part's length, sequence and offset of all parts of the rows."""
        key = (self.slots[:, 0] << 44) + self.slots[:, 1]
        slot = self.slots[np.searchsorted(key, (length << 44) + rank, "right") - 1]
        nth, per = rank - slot[:, 1], slot[:, 2]
        whole = np.flatnonzero(per > 0)
        k = nth[whole] // per[whole]
        out = [(whole, np.zeros(len(whole), np.int64), length[whole], slot[whole, 3] + k, slot[whole, 4] + (nth[whole] - k * per[whole]) * length[whole])]
        row = np.flatnonzero(per == 0)
        at = slot[row, 4] + nth[row] * length[row]
        to = at + length[row]
        done = np.zeros(len(row), np.int64)
        while len(row):
            n = at // self.window
            late = np.searchsorted(self.ends, at, "right")
            inside = n < self.whole
            begin = np.where(inside, n * self.window, np.r_[self.whole * self.window, self.ends][late])
            end = np.where(inside, (n + 1) * self.window, np.r_[self.ends, 0][np.minimum(late, len(self.ends))])
            size = np.minimum(end, to) - at
            out.append((row, done, size, self.stream_from + np.where(inside, n, self.whole + late), at - begin))
            more = at + size < to
            row, done, at, to = row[more], (done + size)[more], (at + size)[more], to[more]
        return [np.concatenate(x) for x in zip(*out)]


# --- rows ------------------------------------------------------------------------


def ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """``pieces`` with their rank, from 0, within their length.

    Buckets are of a number that each written row has for itself, so repeated rows do not crowd one of them; what
    is ordered in one task are the counts of a length's buckets, a row for BUCKET_ROWS or more pieces.
    """
    spark = pieces.sparkSession
    many = spark.createDataFrame([(k, -(-n // BUCKET_ROWS)) for k, n in histogram.items()], "length bigint, buckets bigint")
    dealt = pieces.join(F.broadcast(many), "length").withColumn("b", F.pmod(F.xxhash64("_u"), "buckets"))
    counts = dealt.groupBy("length", "b").count()
    before = counts.select("length", "b", (F.sum("count").over(Window.partitionBy("length").orderBy("b")) - F.col("count")).alias("base"))
    nth = F.row_number().over(Window.partitionBy("length", "b").orderBy("doc_id", "start", "t", "_u")) - 1
    return dealt.withColumn("nth", nth).join(table(before, "bucket-starts"), ["length", "b"]).withColumn("rank", F.col("base") + F.col("nth")).drop("b", "buckets", "base", "nth", "_u")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces and their places: doc_id, t, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = table(tokens(docs, doc_id, text, tokenizer, window=window).withColumn("_u", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most window rows
    if not histogram:
        return pieces.drop("_u").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    shared = docs.sparkSession.sparkContext.broadcast(Plan(histogram, window))
    schema = StructType([*pieces.drop("_u").schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(batches):
        for b in batches:
            full, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            row, skip, size, sequence, offset = shared.value.place(full, rank)
            at = pa.array(row)
            crc = b.column("ids_crc32").take(at).to_numpy()
            columns = {
                "start": b.column("start").take(at).to_numpy() + skip,
                "length": size,
                "ids_crc32": pa.array(crc, mask=size < full[row]),  # a part of a rest: its checksum comes later
                "sequence_id": sequence,
                "offset": offset,
            }
            yield pa.RecordBatch.from_arrays([pa.array(columns[n]) if n in columns else b.column(n).take(at) for n in schema.names], names=schema.names)

    placed = table(ranked(pieces, histogram).mapInArrow(run, schema), "placed")
    spent(pieces)
    cut = placed.where(F.col("ids_crc32").isNull())
    n = cut.count()
    if not n:
        return placed
    return placed.where(F.col("ids_crc32").isNotNull()).unionByName(checked(docs, cut, n, doc_id, text, tokenizer, window))


def checked(docs: DataFrame, cut: DataFrame, n: int, doc_id: str, text: str, tokenizer: str | None, window: int) -> DataFrame:
    """Cut rows with the checksums of their ids, whose documents are encoded again."""
    keys = cut.select(F.col("doc_id").alias("_k"), F.col("t").alias("_t")).distinct()
    own = docs.join(F.broadcast(keys) if n <= FEW else keys, F.col(doc_id).eqNullSafe(F.col("_k")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("_t")), "left_semi")
    ids = tokens(own, doc_id, text, tokenizer, with_ids=True, window=window).dropDuplicates(["doc_id", "t", "start"])
    ids = ids.select(F.col("doc_id").alias("_k"), F.col("t").alias("_t"), F.col("start").alias("_s"), "ids")
    both = cut.drop("ids_crc32").join(ids, F.col("doc_id").eqNullSafe(F.col("_k")) & (F.col("t") == F.col("_t")) & (F.col("start") >= F.col("_s")) & (F.col("start") < F.col("_s") + F.lit(window)))
    schema = StructType([f for f in cut.schema.fields])

    def run(batches):
        for b in batches:
            crc = []
            for start, length, s, ids in zip(*(b.column(c).to_pylist() for c in ("start", "length", "_s", "ids"))):
                crc.append(checksum(np.array(ids[start - s : start - s + length], np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(crc, pa.int64()) if n == "ids_crc32" else b.column(n) for n in schema.names], names=schema.names)

    return both.mapInArrow(run, schema)


def sequences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """The packed sequences themselves: sequence_id, and ids of at most ``window`` tokens."""
    placed = pack(docs, doc_id, text, tokenizer, window)
    ids = tokens(docs, doc_id, text, tokenizer, with_ids=True, window=window).dropDuplicates(["doc_id", "t", "start"])
    ids = ids.select(F.col("doc_id").alias("_k"), F.col("t").alias("_t"), F.col("start").alias("_s"), "ids")
    both = placed.withColumn("_w", F.col("start") - F.col("start") % window).join(ids, F.col("doc_id").eqNullSafe(F.col("_k")) & (F.col("t") == F.col("_t")) & (F.col("_w") == F.col("_s")))
    part = F.struct("offset", F.slice("ids", (F.col("start") - F.col("_s") + 1).cast("int"), F.col("length").cast("int")).alias("ids"))
    return both.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["ids"])).alias("ids"))


def digest(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
