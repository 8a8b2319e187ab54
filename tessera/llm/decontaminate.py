"""Benchmark decontamination with an FM-index for each block of training text.

A benchmark item gives windows of ``width`` consecutive words (an item of
fewer words is one window). Each block of documents (its shard) becomes one
sequence over the benchmark's vocabulary: every other word is a separator, and
runs of known words shorter than the shortest window are left out, since no
window fits there. Backward search through the wavelet matrix finds all windows
at once; sampled suffixes give the places, which are merged into removal spans.

The benchmark is taken in parts of about ``part_bytes`` of item text (the size is
measured first), one after the other: the driver and each worker hold the windows
of one part only. Every row carries the word runs that earlier parts have hit, so
results do not depend on the number of parts and nothing is joined; between parts
the rows are written to the shared folder. The usual benchmark is one part and one
pass, which writes nothing. A word's hash is checked against its bytes.

Defined results: null or wordless texts have no words and no hits; null or
wordless items have no windows; an item id is listed once, however many rows it
has; a null id is listed as the empty string; an empty benchmark hits nothing; rows
of a null or repeated id are each judged by their own text.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tessera.llm import words
from tessera.llm.blocks import letters_before, lists, map_blocks
from tessera.llm.fmindex import FMIndex
from tessera.store import spent, table

WIDTH = 10
PART_BYTES = 4 << 20
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
FIELDS = [StructField("n_words", LongType()), StructField("spans", SPANS), StructField("hit_lengths", ArrayType(IntegerType())), StructField("items", ArrayType(StringType()))]
RUNS, ITEMS = "__tessera_hit_runs", "__tessera_hit_items"  # what a row carries from part to part
CARRIED = [StructField(RUNS, SPANS), StructField(ITEMS, ArrayType(StringType()))]


def lowered(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Bytes, offsets, and bounds of the words of lower-cased texts."""
    data, off = words.utf8(column)
    low = words.LOWER[data]
    return data, off, low, *words.bounds(low, off, words.ALNUM)


class Windows:
    """The distinct windows of some items as rows over their own vocabulary."""

    def __init__(self, items: list[tuple[object, str | None]], width: int):
        _, _, low, start, end, doc = lowered(pa.array([t for _, t in items], pa.string()))
        ids, h, count = words.numbers(low, start, end)
        # words in the order of their hashes; the few that share one follow each other
        first = np.full(count, len(ids), np.int64)
        np.minimum.at(first, ids, np.arange(len(ids)))
        order = np.argsort(h[first], kind="stable")
        self.vocabulary, self.low = h[first][order], low
        self.start, self.end = start[first][order], end[first][order]
        back = np.empty(count, np.int64)
        back[order] = np.arange(count)
        ids = back[ids] + 2  # 0 closes the text, 1 separates
        owners: dict[bytes, set[int]] = defaultdict(set)
        first = np.searchsorted(doc, np.arange(len(items) + 1))
        for i in range(len(items)):
            own = ids[first[i] : first[i + 1]]
            for j in range(max(1, len(own) - width + 1) if len(own) else 0):
                owners[own[j : j + width].tobytes()].add(i)
        self.rows = np.full((len(owners), width), -1, np.int64)
        self.owners = [np.array(sorted(x)) for x in owners.values()]
        for row, key in zip(self.rows, owners):
            own = np.frombuffer(key, np.int64)
            row[width - len(own) :] = own
        self.lengths = (self.rows >= 0).sum(1)
        self.shortest = int(self.lengths.min()) if len(owners) else 0
        names = ["" if k is None else str(k) for k, _ in items]
        self.names = sorted(set(names))
        rank = {x: i for i, x in enumerate(self.names)}
        self.place = np.array([rank[x] for x in names], np.int64)

    def ids(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Symbol of each word, 0 for words of no item."""
        out, h = np.zeros(len(start), np.int64), words.hashes(low, start, end)
        at = np.searchsorted(self.vocabulary, h)
        todo = np.arange(len(h))
        while len(todo):  # once, unless words of the items share a hash
            todo = todo[at[todo] < len(self.vocabulary)]
            todo = todo[self.vocabulary[at[todo]] == h[todo]]
            own = at[todo]
            same = end[todo] - start[todo] == self.end[own] - self.start[own]
            same[same] = words.slices_equal(low, start[todo[same]], self.low, self.start[own[same]], (end - start)[todo[same]])
            out[todo[same]] = own[same] + 2
            todo = todo[~same]
            at[todo] += 1
        return out


def occurrences(known: np.ndarray, doc: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Word places and window numbers of all occurrences in a block, by its FM-index."""
    none = np.zeros(0, np.int64)
    n = len(known)
    if not n or not windows.shortest:
        return none, none
    begins = known > 0
    begins[1:] &= (known[:-1] == 0) | (doc[1:] != doc[:-1])
    run = np.cumsum(begins) - 1
    size = np.bincount(run[known > 0], minlength=run[-1] + 1) if run[-1] >= 0 else none
    kept = np.flatnonzero((known > 0) & (size[run] >= windows.shortest)) if len(size) else none
    if not len(kept):
        return none, none
    new = np.r_[True, run[kept][1:] != run[kept][:-1]]
    at = np.arange(len(kept)) + np.cumsum(new)
    text = np.ones(at[-1] + 2, np.int64)
    text[at], text[-1] = known[kept], 0
    index = FMIndex(text, len(windows.vocabulary) + 2)
    lo, hi = index.search(windows.rows)
    count = hi - lo
    which = np.repeat(np.arange(len(count)), count)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + lo[which]
    back = np.zeros(len(text), np.int64)
    back[at] = kept
    return back[index.locate(rows)], which


def scan_part(docs: DataFrame, windows: Windows, text: str, drop: tuple[str, ...] = (), mode: str = "found") -> DataFrame:
    """One pass with one part of the windows.

    mode: "carry" adds what the next part needs, "found" the results, "clean" changes the text and adds nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    carried = RUNS in docs.columns

    def work(block: pa.RecordBatch) -> dict:
        win = shared.value
        data, off, low, start, end, doc = lowered(block.column(text))
        n, k = len(off) - 1, max(1, len(win.names))
        first_word = np.searchsorted(doc, np.arange(n + 1))
        edge = np.zeros(len(start) + 1, np.int64)
        if carried:
            runs = block.column(RUNS)
            flat, row = runs.flatten(), np.repeat(np.arange(n), pc.list_value_length(runs).to_numpy())
            for name, step in (("start", 1), ("end", -1)):
                np.add.at(edge, first_word[row] + flat.field(name).to_numpy(), step)
        place, which = occurrences(win.ids(low, start, end), doc, win)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + win.lengths[which], -1)
        hit = np.cumsum(edge[:-1]) > 0
        first = hit.copy()
        first[1:] &= ~hit[:-1] | (doc[1:] != doc[:-1])
        last = hit.copy()
        last[:-1] &= ~hit[1:] | (doc[1:] != doc[:-1])
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        if mode == "clean":
            own = block.column(text)
            return {text: pc.if_else(own.is_null(), pa.scalar(None, pa.large_string()), cut_out(data, off, start[a], end[b]))}
        owned = [win.owners[w] for w in which]
        pair = np.unique(np.repeat(doc[place], [len(x) for x in owned]) * k + win.place[np.concatenate(owned)]) if len(which) else np.zeros(0, np.int64)
        names = lists(pa.array([win.names[i] for i in pair % k], pa.string()), np.searchsorted(pair // k, np.arange(n + 1)))
        if carried:
            names = pa.array([sorted({*x, *y}) for x, y in zip(block.column(ITEMS).to_pylist(), names.to_pylist())], pa.list_(pa.string()))
        at = np.searchsorted(doc[a], np.arange(n + 1))

        def spans(x: np.ndarray, y: np.ndarray) -> pa.Array:
            return lists(pa.StructArray.from_arrays([pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32))], ["start", "end"]), at)

        if mode == "carry":
            return {RUNS: spans(a - first_word[doc[a]], b + 1 - first_word[doc[a]]), ITEMS: names}
        before = letters_before(data)
        base = before[off[doc[a]]]
        return {
            "n_words": np.bincount(doc, minlength=n),
            "spans": spans(before[start[a]] - base, before[end[b]] - base),
            "hit_lengths": lists(pa.array((b - a + 1).astype(np.int32)), at),
            "items": names,
        }

    fields = {"carry": CARRIED, "found": FIELDS, "clean": [StructField(text, StringType())]}[mode]
    return map_blocks(docs, text, work, fields, (*drop, RUNS, ITEMS) if mode != "carry" else ())


def scan_parts(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, width: int, part_bytes: int, drop: tuple[str, ...] = (), mode: str = "found") -> DataFrame:
    """All parts of the benchmark, one pass each."""
    items = benchmark.select(F.col(item_id).alias("k"), F.col(item_text).alias("t"))
    n = max(1, math.ceil((items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / part_bytes))
    rows = docs
    for i in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == i)
        windows = Windows([(r.k, r.t) for r in own.toLocalIterator()], width)
        if i + 1 == n:
            return scan_part(rows, windows, text, drop, mode)
        before, rows = rows, table(scan_part(rows, windows, text, mode="carry"), "hit-so-far")
        if before is not docs:
            spent(before)


def cut_out(data: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The block's texts without the byte spans [start, end)."""
    gone = np.zeros(len(data) + 1, np.int64)
    np.add.at(gone, start, 1)
    np.add.at(gone, end, -1)
    keep = np.cumsum(gone[:-1]) == 0
    left = np.r_[0, np.cumsum(keep)][off]
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[keep])))


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    part_bytes: int = PART_BYTES,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """``docs`` with n_words, merged hit spans (code points), their lengths in words, and sorted item ids."""
    return scan_parts(docs, benchmark, text, item_id, item_text, width, part_bytes, drop)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` whose texts have lost all hit spans; other columns as they were."""
    settings = {"item_id": "item_id", "item_text": "text", "width": WIDTH, "part_bytes": PART_BYTES} | options
    return scan_parts(docs, benchmark, text, **settings, mode="clean").select(*docs.columns)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Hits by document, from :func:`scan`'s spans and items."""
    found = scan(docs.select("doc_id", "text"), benchmark, drop=("text",))
    n_hit = F.coalesce(F.aggregate("hit_lengths", F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
