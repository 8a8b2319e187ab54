"""Removal of repeated passages: windows of words that also start earlier.

Every window has an anchor, the least hash among the runs of GRAM words inside
it. Windows of equal words have equal anchors, so each set of equal windows
meets in one place when fragments (maximal runs of windows with one anchor) are
dealt by anchor. Equal windows have their anchor at two places at least, so
anchors that stand at one place in the corpus are left out before any text moves.

The remaining fragments (of at most LONG windows each) are merged by content,
with their earliest place, and dealt to shards by anchor. An anchor with more than
HOT fragments (the edge of a passage that very many documents share) is dealt
window by window instead, by the content of the window. In a shard, windows whose
hash stands once are the first of their kind; the others become one FM-index over
word numbers (checked on the words' bytes). Only its wavelet matrix is kept: backward
search counts where each of these windows occurs, so the matching statistics of the
streamed fragments are known as far as the threshold, one window's length. A count
that agrees with the windows of one hash proves them equal; if it does not, each is
searched by itself. The least place among equal windows is the first of its kind,
and all other live windows are removed. So only anchors, fragments that may repeat,
and (compressed) texts are shuffled.

Ids are integers. Defined results: a null, empty or wordless text has no words
and the hash of the empty text; texts shorter than a window lose nothing; rows
that repeat both id and text are one document and share its result; rows with a
null id come last in the order; an empty table gives an empty result; columns
other than the id are not carried by the digest.
"""

from __future__ import annotations

import hashlib
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tessera.llm import words
from tessera.llm.blocks import map_blocks, small_batches
from tessera.llm.fmindex import FMIndex
from tessera.store import spent, table

WINDOW = 20
GRAM = 8
HOT = 2000  # fragments of one anchor
LONG = 512  # windows of one fragment
SHARD_WORDS = 150_000  # of one FM-index
LAST = (1 << 63) - 1  # order of a null id


class Scan:
    """Words, anchors and windows of the documents of a block."""

    def __init__(self, data: np.ndarray, off: np.ndarray, window: int = WINDOW, gram: int = GRAM):
        self.data, self.off, self.window = data, off, window
        self.start, self.end, self.doc = words.bounds(data, off, words.SOLID)
        self.h = words.hashes(data, self.start, self.end)
        self.first = np.searchsorted(self.doc, np.arange(len(off)))  # of each document's words
        n, width = len(self.h), window - gram + 1
        grams = words.gram_hashes(self.h, gram)
        least, size = grams, 1
        while size * 2 <= width:
            least, size = np.minimum(least[:-size], least[size:]), size * 2
        at = max(0, n - window + 1)
        self.windows = np.flatnonzero(self.doc[:at] == self.doc[n - at :])  # places where one starts
        self.least = np.minimum(least[:at], least[width - size : width - size + at])[self.windows] if at else np.zeros(0, np.uint64)
        self.grams, self.width = grams, width

    def live(self, known: list[np.ndarray]) -> np.ndarray:
        """Which windows may repeat: those whose anchor occurs more than once.

        known: for each document, its sorted anchors of that kind.
        """
        ok = np.zeros(len(self.windows), bool)
        edge = np.searchsorted(self.doc[self.windows], np.arange(len(self.off)))
        for i, own in enumerate(known):
            a, b = edge[i], edge[i + 1]
            if a < b and len(own):
                ok[a:b] = own[np.minimum(np.searchsorted(own, self.least[a:b]), len(own) - 1)] == self.least[a:b]
        return ok

    def repeats(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """At how many places inside each fragment its anchor stands."""
        if not len(a):
            return np.zeros(0, np.int64)
        size = self.windows[b - 1] + self.width - self.windows[a]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.windows[a], size)
        return np.add.reduceat((self.grams[at] == np.repeat(self.least[a], size)).astype(np.int64), np.cumsum(size) - size)

    def fragments(self, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs [a, b) of at most LONG live consecutive windows with one anchor, as places among the windows."""
        if not len(ok):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = ok[1:] & ok[:-1] & (self.windows[1:] == self.windows[:-1] + 1) & (self.least[1:] == self.least[:-1])
        a = np.flatnonzero(ok & np.r_[True, ~joined])
        b = np.flatnonzero(ok & np.r_[~joined, True]) + 1
        n = -(-(b - a) // LONG)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a = np.repeat(a, n) + nth * LONG
        return a, np.minimum(a + LONG, np.repeat(b, n))

    def lines(self, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """The words [a, b) of each run, joined by a space."""
        raw = self.data.tobytes()
        return [b" ".join(raw[x:y].split()) for x, y in zip(self.start[a].tolist(), self.end[b - 1].tolist())]


def content(lines: list[bytes]) -> list[pa.Array]:
    """A hash of 128 bits for each line, as two columns."""
    pairs = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), np.int64).reshape(-1, 2)
    return [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(body).alias("t"), body.alias("text"))


def anchors(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(d, t, a, n): the anchors of each document and at how many places they stand."""

    def run(batches):
        for block in words.blocks(batches, "text"):
            scan = Scan(*words.utf8(block.column("text")), window, gram)
            a, b = scan.fragments(np.ones(len(scan.windows), bool))
            doc, own, places = scan.doc[scan.windows[a]], scan.least[a], scan.repeats(a, b)
            order = np.lexsort((own, doc))
            doc, own, places = doc[order], own[order], places[order]
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])]) if len(doc) else np.zeros(0, np.int64)
            n = np.add.reduceat(places, new) if len(new) else new
            at = pa.array(doc[new])
            yield pa.RecordBatch.from_arrays([block.column("d").take(at), block.column("t").take(at), pa.array(own[new].view(np.int64)), pa.array(n)], names=["d", "t", "a", "n"])

    return rows.mapInArrow(run, "d bigint, t bigint, a bigint, n bigint")


def packed(rows: DataFrame) -> DataFrame:
    """(d, t, z) with the text compressed, for shuffles."""

    def work(block: pa.RecordBatch) -> dict:
        press = zstandard.ZstdCompressor(level=3).compress
        return {"z": pa.array([press(x) for x in block.column("text").cast(pa.large_binary()).to_pylist()], pa.binary())}

    return map_blocks(rows, "text", work, [StructField("z", BinaryType())], drop=("text",))


def opened(batches, most: int = words.BLOCK_BYTES):
    """Blocks of rows with their texts opened: (batch, bytes, offsets)."""
    opener = zstandard.ZstdDecompressor()
    for batch in batches:
        at, texts, size = 0, [], 0
        column = batch.column("z")
        for i in range(batch.num_rows):
            texts.append(opener.decompress(column[i].as_py()))
            size += len(texts[-1])
            if size >= most or i + 1 == batch.num_rows:
                off = np.cumsum([0, *map(len, texts)])
                yield batch.slice(at, i + 1 - at), np.frombuffer(b"".join(texts), np.uint8), off
                at, texts, size = i + 1, [], 0


def known(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.sort(np.array(x or [], np.int64).view(np.uint64)) for x in batch.column("anchors").to_pylist()]


FRAGMENT = "f1 bigint, f2 bigint, a bigint, d bigint, t bigint, start bigint, words binary"


def fragments(found: DataFrame, window: int, gram: int) -> DataFrame:
    """Live fragments of documents that came with their repeated anchors."""

    def run(batches):
        for batch, data, off in opened(batches):
            scan = Scan(data, off, window, gram)
            a, b = scan.fragments(scan.live(known(batch)))
            if not len(a):
                continue
            w0, w1 = scan.windows[a], scan.windows[b - 1] + window
            doc = scan.doc[w0]
            at = pa.array(doc)
            lines = scan.lines(w0, w1)
            yield pa.RecordBatch.from_arrays(
                [*content(lines), pa.array(scan.least[a].view(np.int64)), batch.column("d").take(at), batch.column("t").take(at), pa.array(w0 - scan.first[doc]), pa.array(lines, pa.binary())],
                names=["f1", "f2", "a", "d", "t", "start", "words"],
            )

    return found.mapInArrow(run, FRAGMENT)


def merged(rows: DataFrame) -> DataFrame:
    """One row for each content, at its earliest place."""
    return rows.groupBy("f1", "f2").agg(F.min(F.struct("d", "t", "start", "a", "words")).alias("x")).select("f1", "f2", "x.*")


def single_windows(rows: DataFrame, window: int) -> DataFrame:
    """The windows of fragments as fragments of their own, dealt by their content."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            data, off = words.utf8(b.column("words").cast(pa.large_binary()).view(pa.large_string()))
            scan = Scan(data, off, window, window)
            doc = scan.doc[scan.windows]
            at = pa.array(doc)
            start = b.column("start").to_numpy()[doc] + scan.windows - scan.first[doc]
            lines = scan.lines(scan.windows, scan.windows + window)
            f1, f2 = content(lines)
            yield pa.RecordBatch.from_arrays([f1, f2, f1, b.column("d").take(at), b.column("t").take(at), pa.array(start), pa.array(lines, pa.binary())], names=["f1", "f2", "a", "d", "t", "start", "words"])

    return rows.select("f1", "f2", "a", "d", "t", "start", "words").mapInArrow(run, FRAGMENT)


def first_windows(rows: pa.Table, window: int) -> pa.Table:
    """(d, t, start, n): runs of windows of these fragments that are the first of their kind, by one FM-index."""
    data, off = words.utf8(rows.column("words").combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
    start, end, doc = words.bounds(data, off, words.SOLID)
    d, t, s = (rows.column(c).to_numpy() for c in ("d", "t", "start"))
    symbol, h, _ = words.numbers(data, start, end)
    n = len(symbol)
    within = np.arange(n) - np.searchsorted(doc, doc)
    count = np.bincount(doc, minlength=len(rows))
    windows = np.flatnonzero(within + window <= count[doc])
    rank = np.empty(n, np.int64)
    rank[np.lexsort((s[doc] + within, t[doc], d[doc]))] = np.arange(n)
    _, kind, size = np.unique(words.gram_hashes(h, window)[windows], return_inverse=True, return_counts=True)
    again = size[kind] > 1
    kept = np.zeros(len(windows), bool)
    kept[~again] = True
    if again.any():
        kept[again] = first_of_kind(symbol, doc, windows[again], kind[again], rank, window)
    kept = windows[kept]
    if not len(kept):
        return pa.table({"d": pa.array([], pa.int64()), "t": pa.array([], pa.int64()), "start": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    new = np.flatnonzero(np.r_[True, (kept[1:] != kept[:-1] + 1) | (doc[kept[1:]] != doc[kept[:-1]])])
    own = doc[kept[new]]
    return pa.table({"d": d[own], "t": t[own], "start": s[own] + within[kept[new]], "n": np.diff(np.r_[new, len(kept)])})


def first_of_kind(symbol: np.ndarray, doc: np.ndarray, windows: np.ndarray, kind: np.ndarray, rank: np.ndarray, window: int) -> np.ndarray:
    """Which of these windows (their first words' places) have the least rank among equal ones; equal windows have one kind."""
    cover = np.zeros(len(symbol) + 1, np.int64)
    np.add.at(cover, windows, 1)
    np.add.at(cover, windows + window, -1)
    held = np.flatnonzero(np.cumsum(cover[:-1]) > 0)  # words of the index: those of windows that may be equal
    _, own = np.unique(symbol[held], return_inverse=True)
    # a separator (1) stands between runs of words; the text is closed by 0
    place = np.arange(len(held)) + np.cumsum(np.r_[0, (held[1:] != held[:-1] + 1) | (doc[held[1:]] != doc[held[:-1]])])
    text = np.ones(place[-1] + 2, np.int64)
    text[place], text[-1] = own + 2, 0
    index = FMIndex(text, int(own.max()) + 3, sample=None, depth=window)
    at = np.searchsorted(held, windows)

    def interval(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return index.search(own[at[which][:, None] + np.arange(window)] + 2)

    _, first, kind, size = np.unique(kind, return_index=True, return_inverse=True, return_counts=True)
    lo, hi = interval(first)
    row = lo[kind]
    mixed = np.flatnonzero((hi - lo != size)[kind])  # different windows of one hash
    if len(mixed):
        row[mixed] = interval(mixed)[0]
    _, group = np.unique(row, return_inverse=True)
    least = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, rank[windows])
    return rank[windows] == least[group]


def first_places(shards: DataFrame, window: int, tasks: int) -> DataFrame:
    """Runs of first windows of all fragments; fragments of one shard key meet in one index."""

    def run(batches):
        held, size = [], 0

        def flush(rows: pa.Table):
            return first_windows(rows, window).to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.column("words").nbytes
            if size > SHARD_WORDS * 6:
                rows = pa.Table.from_batches(held)
                a = rows.column("a").to_numpy()
                cut = int(np.searchsorted(a, a[-1]))  # the last key may go on in the next batch
                if cut:
                    yield from flush(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
                size = sum(x.column("words").nbytes for x in held)
        if held:
            yield from flush(pa.Table.from_batches(held))

    return shards.select("a", "d", "t", "start", "words").repartition(tasks, "a").sortWithinPartitions("a").mapInArrow(run, "d bigint, t bigint, start bigint, n bigint")


def removals(rows: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Per document: its repeated anchors, and runs of windows that are the first of their kind."""
    spark = rows.sparkSession
    small_batches(spark)
    each = anchors(rows, window, gram)
    twice = table(each.groupBy("a").agg(F.sum("n").alias("n")).where("n > 1").select("a"), "anchors")
    own = table(each.join(twice, "a").groupBy("d", "t").agg(F.collect_set("a").alias("anchors")), "own-anchors")
    spent(twice)
    some = table(merged(fragments(packed(rows).join(own, ["d", "t"]), window, gram)), "fragments")
    sizes = some.groupBy("a").agg(F.count("*").alias("k"), F.sum(F.length("words")).alias("bytes"))
    hot = table(sizes.where(F.col("k") > HOT).select("a"), "hot-anchors")
    cold = some.join(hot, "a", "left_anti")
    single = merged(single_windows(some.join(hot, "a", "left_semi"), window))
    total = some.agg(F.sum(F.length("words"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(total / (16 << 20)))
    firsts = first_places(cold.select("a", "d", "t", "start", "words").unionByName(single.select("a", "d", "t", "start", "words")), window, tasks)
    runs = firsts.groupBy("d", "t").agg(F.collect_list(F.struct("start", "n")).alias("firsts"))
    runs = table(runs, "first-windows")
    spent(some, hot)
    return own, runs


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document's words without repeated passages, joined by a space."""
    return _finished(docs, doc_id, text, window, gram, digest_only=False)


def digest(docs: DataFrame) -> DataFrame:
    return _finished(docs, "doc_id", "text", WINDOW, GRAM, digest_only=True)


def _finished(docs: DataFrame, doc_id: str, text: str, window: int, gram: int, digest_only: bool) -> DataFrame:
    rows = keyed(docs, doc_id, text)
    own, firsts = removals(rows, window, gram)
    both = packed(rows).join(own, ["d", "t"], "left").join(firsts, ["d", "t"], "left")
    last = "kept_sha256" if digest_only else "kept"
    schema = StructType([StructField("d", LongType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField(last, StringType())])

    def run(batches):
        for batch, data, off in opened(batches):
            scan = Scan(data, off, window, gram)
            gone = scan.live(known(batch))
            n = len(off) - 1
            edge = np.searchsorted(scan.doc[scan.windows], np.arange(n + 1))
            for i, runs in enumerate(batch.column("firsts").to_pylist()):
                for x in runs or []:
                    gone[edge[i] + x["start"] : edge[i] + x["start"] + x["n"]] = False
            cover = np.zeros(len(scan.h) + 1, np.int64)
            np.add.at(cover, scan.windows[gone], 1)
            np.add.at(cover, scan.windows[gone] + window, -1)
            cut = np.cumsum(cover[:-1]) > 0
            out, raw = [], data.tobytes()
            for i in range(n):
                a, b = scan.first[i], scan.first[i + 1]
                keep = np.flatnonzero(~cut[a:b]) + a
                line = b" ".join([raw[x:y] for x, y in zip(scan.start[keep].tolist(), scan.end[keep].tolist())])
                out.append(hashlib.sha256(line).hexdigest() if digest_only else line.decode())
            count = np.bincount(scan.doc, minlength=n)
            removed = np.bincount(scan.doc, cut, minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(count), pa.array(removed), pa.array(out, pa.string())], names=schema.names)

    done = both.mapInArrow(run, schema)
    return done.select(F.when(F.col("d") != LAST, F.col("d")).alias(doc_id), "n_words", "n_removed", last)
