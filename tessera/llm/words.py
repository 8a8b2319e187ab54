"""Vectorised words over Arrow batches of UTF-8 texts.

The bytes of a whole block of documents are handled at once: a 256-entry
class table tells which bytes belong to words, and a 64-bit hash of each word
comes from one cumulative sum, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 1 << 20  # of text handled at once by one Python worker

#: bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
#: bytes of words `[^\x20\x09-\x0D]+`
SOLID = np.ones(256, bool)
SOLID[0x20] = False
SOLID[0x09:0x0E] = False
#: lower-cases A-Z and nothing else
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; one-to-one."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


NEAR = 64  # places of a slice whose bytes' values come from a table


def _value(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A random-looking value for each byte at its place in a slice."""
    return mix((place.astype(U64) << U64(8) | byte.astype(U64)) * _BASE + U64(1))


_TABLE = _value(*np.mgrid[:NEAR, :256])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets between them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(batches: Iterable[pa.RecordBatch], column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices with at most ``most`` bytes of text, or one row."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(sizes):
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def bounds(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of each word, in order."""
    n = len(data)
    inside = table[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    left = inside.copy()
    left[1:] &= ~inside[:-1] | edge[1:n]
    right = inside
    right = right.copy()
    right[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(left)
    ends = np.flatnonzero(right) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of ``data``; equal slices have equal hashes.

    Each byte adds a value that depends on it and on its place in the slice, so
    there is no base whose powers make regular texts collide.
    """
    size = ends - starts
    total = np.zeros(len(size), U64)
    short = np.flatnonzero(size <= NEAR)
    order = short[np.argsort(size[short].astype(np.int8), kind="stable")[::-1]]  # longest first, so that place p concerns the first reach[p]
    reach = len(order) - np.cumsum(np.bincount(size[short], minlength=NEAR + 1))
    at, own = starts[order], np.zeros(len(order), U64)
    for p in range(NEAR):
        k = reach[p]
        if not k:
            break
        own[:k] += _TABLE[p][data[at[:k] + p]]
    total[order] = own
    for i in np.flatnonzero(size > NEAR).tolist():
        total[i] = _value(np.arange(size[i]), data[starts[i] : ends[i]]).sum()
    return mix(total + size.astype(U64) * _BASE)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive word hashes; len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(h) - n + 1, U64)
    for i, odd in enumerate(mix(np.arange(1, n + 1, dtype=U64) * _BASE) | U64(1)):
        out += h[i : len(h) - n + 1 + i] * odd
    return mix(out)


def slices_equal(one: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes one[a : a + size] are those at other[b : b + size], for each place."""
    last = np.cumsum(size)
    place = np.arange(last[-1] if len(last) else 0) - np.repeat(last - size, size)
    wrong = np.zeros(len(place) + 1, np.int64)
    np.cumsum(one[place + np.repeat(a, size)] != other[place + np.repeat(b, size)], out=wrong[1:])
    return wrong[last] == wrong[last - size]


def numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(numbers, hashes, count): equal slices, and only those, have one number from 0; hashes are checked on the bytes."""
    h = hashes(data, starts, ends)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    size, count = ends - starts, len(first)
    same = size == size[first][number]
    same[same] = slices_equal(data, starts[same], data, starts[first][number][same], size[same])
    odd: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():  # slices whose hash another one has
        number[i] = odd.setdefault(data[starts[i] : ends[i]].tobytes(), count + len(odd))
    return number, h, count + len(odd)
