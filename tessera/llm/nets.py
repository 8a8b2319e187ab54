"""Two small convolutional text classifiers in numpy.

Both score whole documents: every byte or word of a text passes through the
filters. Blocks of many documents are scored together, so memory is bounded by
the block.
"""

from __future__ import annotations

import numpy as np

from tessera.llm import words


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def fit(net, docs: list[tuple[np.ndarray, ...]], y: np.ndarray, visits: int, batch: int, rate: float, seed: int = 7) -> None:
    """Adam over ``visits`` document visits in shuffled batches, at a rate that falls to a tenth."""
    rng, opt, seen, order = np.random.default_rng(seed), Adam(net.p, rate), 0, np.zeros(0, np.int64)
    if len(y) == 0:
        return
    while seen < visits:
        if len(order) == 0:
            order = rng.permutation(len(y))
        pick, order = order[:batch], order[batch:]
        opt.rate = rate * (1 - 0.9 * seen / visits)
        opt.step(net.gradients(net.join([docs[i] for i in pick]), y[pick]))
        seen += len(pick)


# --- bytes -----------------------------------------------------------------------


class ByteNet:
    """Filters of WIDTH bytes over overlapping chunks that cover the whole text.

    A place's input is the learned embeddings of its bytes, and nothing else. Each
    filter is max-pooled in each chunk; the chunks of a document are combined into
    one probability by the largest and the mean of their answers.
    """

    WIDTH, STRIDE, DIM, FILTERS, HALF = 16, 4, 8, 32, 32  # a chunk is two halves of HALF filter places
    SLICE = 512  # halves whose answers are held at once when texts are scored

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        n = self.WIDTH * self.DIM
        self.p = {
            "e": rng.normal(0, 0.5, (256, self.DIM)).astype(np.float32),
            "k": rng.normal(0, (2 / n) ** 0.5, (n, self.FILTERS)).astype(np.float32),
            "b": np.zeros(self.FILTERS, np.float32),
            "v": rng.normal(0, 0.1, 2 * self.FILTERS).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }

    @classmethod
    def prepare(cls, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """Bytes padded to whole filter places, and places of each document."""
        size = np.diff(off)
        places = np.maximum(1, -(-(size - cls.WIDTH) // cls.STRIDE) + 1)
        # every document gets room for its places and for the tail of the last one
        room = (places + (cls.WIDTH // cls.STRIDE - 1)) * cls.STRIDE
        begin = np.cumsum(room) - room
        at = np.arange(len(data)) + np.repeat(begin - off[:-1], size)
        out = np.zeros(int(room.sum()), np.uint8)
        out[at] = data
        return out, places

    @staticmethod
    def join(docs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate([d[i] for d in docs]) for i in range(2))

    def firsts(self, places: np.ndarray) -> np.ndarray:
        """The first cell (of STRIDE bytes) of each filter place."""
        spare = self.WIDTH // self.STRIDE - 1
        room = np.cumsum(places + spare) - places - spare
        return np.repeat(room - (np.cumsum(places) - places), places) + np.arange(places.sum())

    def windows(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Filter inputs, one row for each place; ``first`` ascends."""
        k = self.WIDTH // self.STRIDE
        x = self.p["e"][data[first[0] * self.STRIDE : (first[-1] + k) * self.STRIDE]]
        cells = x.reshape(len(x) // self.STRIDE, -1)
        return np.concatenate([cells[first - first[0] + i] for i in range(k)], axis=1)

    def layout(self, places: np.ndarray) -> tuple[np.ndarray, ...]:
        """First place of each half, and the halves and first chunks of chunks and documents."""
        halves = -(-places // self.HALF)
        begin = np.cumsum(places) - places
        h0 = np.cumsum(halves) - halves
        inner = np.arange(halves.sum()) - np.repeat(h0, halves)
        at = np.repeat(begin, halves) + inner * self.HALF
        # chunk i is half i with half i + 1; the last half of a document stands alone only if it is the first
        chunks = np.maximum(1, halves - 1)
        c0 = np.cumsum(chunks) - chunks
        left = np.repeat(h0 - c0, chunks) + np.arange(chunks.sum())
        right = np.minimum(left + 1, np.repeat(h0 + halves - 1, chunks))
        return at, left, right, c0, chunks

    def features(self, half: np.ndarray, left: np.ndarray, right: np.ndarray, c0: np.ndarray, chunks: np.ndarray):
        """Largest and mean answer of each document's chunks, with the chunks' answers."""
        chunk = np.maximum(half[left], half[right])
        top = np.maximum.reduceat(chunk, c0, axis=0)
        mean = np.add.reduceat(chunk, c0, axis=0) / chunks[:, None]
        return np.concatenate([top, mean], 1), chunk, top

    def logits(self, prepared: tuple[np.ndarray, ...]) -> np.ndarray:
        """Documents' scores before the sigmoid; filters run over SLICE halves at a time, however long a text is."""
        data, places = prepared
        at, *chunked = self.layout(places)
        first = self.firsts(places)
        half = np.empty((len(at), self.FILTERS), np.float32)
        ends = np.r_[at[1:], len(first)]
        for i in range(0, len(at), self.SLICE):
            a, b = at[i], ends[min(i + self.SLICE, len(at)) - 1]
            z = self.windows(data, first[a:b]) @ self.p["k"] + self.p["b"]
            half[i : i + self.SLICE] = np.maximum.reduceat(z, at[i : i + self.SLICE] - a, axis=0)
        np.maximum(half, 0, out=half)
        return self.features(half, *chunked)[0] @ self.p["v"] + self.p["c"][0]

    def gradients(self, prepared: tuple[np.ndarray, ...], y: np.ndarray) -> dict[str, np.ndarray]:
        data, places = prepared
        first = self.firsts(places)
        x = self.windows(data, first)
        z = np.maximum(x @ self.p["k"] + self.p["b"], 0)
        at, left, right, c0, chunks = self.layout(places)
        half = np.maximum.reduceat(z, at, axis=0)
        f, chunk, top = self.features(half, left, right, c0, chunks)
        d = ((sigmoid(f @ self.p["v"] + self.p["c"][0]) - y) / len(y)).astype(np.float32)
        g = {"v": f.T @ d + 1e-4 * self.p["v"], "c": d.sum(keepdims=True)}
        df = d[:, None] * self.p["v"]
        doc = np.repeat(np.arange(len(places)), chunks)
        best = chunk == top[doc]  # answers that tie share the gradient
        share = df[:, : self.FILTERS] / np.add.reduceat(best, c0, axis=0, dtype=np.float32)
        dchunk = (df[doc, self.FILTERS :] / chunks[doc][:, None]) + np.where(best, share[doc], 0)
        dhalf = np.zeros_like(half)
        takes = half[left] >= half[right]
        np.add.at(dhalf, left, np.where(takes, dchunk, 0))
        np.add.at(dhalf, right, np.where(takes, 0, dchunk))
        own = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(z)]))
        best = z == half[own]
        share = dhalf / np.add.reduceat(best, at, axis=0, dtype=np.float32)
        dz = np.where(best & (z > 0), share[own], 0)
        g["b"] = dz.sum(0)
        g["k"] = x.T @ dz + 1e-4 * self.p["k"]
        used = np.flatnonzero(dz.any(1))
        dx = dz[used] @ self.p["k"].T
        byte = data[(first[used][:, None] * self.STRIDE + np.arange(self.WIDTH)).ravel()]
        dx = dx.reshape(-1, self.DIM)
        g["e"] = np.stack([np.bincount(byte, dx[:, j], 256) for j in range(self.DIM)], 1).astype(np.float32)
        return g


# --- words -----------------------------------------------------------------------


class WordNet:
    """Hashed word embeddings, filters over one to three words, max-pooled over the text.

    A word's embedding is the row of its own bucket next to the rows of the
    buckets of its stems (its first STEMS bytes), so that inflected forms that
    training has not seen share what was learned of the stem. All weights start
    at random and are learned.
    """

    BUCKETS, DIM, WIDTHS, FILTERS, STEMS = 1 << 16, 4, (1, 2, 3), 8, (4, 5, 6)
    PARTS = 1 + len(STEMS)
    SLICE = 1 << 15  # words whose answers are held at once when texts are scored

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = self.PARTS * self.DIM
        self.p = {"e": rng.normal(0, 0.05, (self.BUCKETS + 1, self.DIM)).astype(np.float32)}
        for w in self.WIDTHS:
            self.p[f"k{w}"] = rng.normal(0, 0.2, (w * n, self.FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(self.FILTERS, np.float32)
        self.p["v"] = rng.normal(0, 0.1, len(self.WIDTHS) * self.FILTERS).astype(np.float32)
        self.p["c"] = np.full(1, -2.0, np.float32)
        self.p["e"][self.BUCKETS] = 0  # stands after a text

    @classmethod
    def prepare(cls, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """Buckets of each word and its stems, with room after each document; and its places."""
        low = words.LOWER[data]
        start, end, doc = words.bounds(low, off, words.ALNUM)
        found = [words.hashes(low, start, end)]
        found += [words.mix(words.hashes(low, start, np.minimum(start + n, end)) + np.uint64(n)) for n in cls.STEMS]
        bucket = (np.stack(found, 1) % np.uint64(cls.BUCKETS)).astype(np.int32)
        size = np.bincount(doc, minlength=len(off) - 1)
        room = size + max(cls.WIDTHS)
        out = np.full((int(room.sum()), cls.PARTS), cls.BUCKETS, np.int32)
        out[np.arange(len(bucket)) + np.repeat(np.cumsum(room) - room - (np.cumsum(size) - size), size)] = bucket
        return out, room

    @staticmethod
    def join(docs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate([d[i] for d in docs]) for i in range(2))

    @staticmethod
    def own_places(z: np.ndarray, ends: np.ndarray, w: int) -> None:
        """No answer (0, the least) where a filter of w words reaches beyond the room after its document."""
        for i in range(1, w):
            at = ends - i
            z[at[(at >= 0) & (at < len(z))]] = 0

    def tops(self, prepared: tuple[np.ndarray, ...], at: dict[int, np.ndarray] | None = None) -> np.ndarray:
        """Each filter's largest answer in each document; filters run over SLICE words at a time, however long a text is.

        ``at`` takes, by width, the first place of each answer above 0.
        """
        bucket, room = prepared
        top = np.zeros((len(room), len(self.WIDTHS) * self.FILTERS), np.result_type(self.p["e"], np.float32))
        ends, spare = np.cumsum(room), max(self.WIDTHS) - 1
        for a in range(0, len(bucket), self.SLICE):
            b = min(a + self.SLICE, len(bucket))
            docs = np.arange(np.searchsorted(ends, a, "right"), np.searchsorted(ends, b - 1, "right") + 1)
            begin = np.maximum((ends - room)[docs], a) - a
            x = self.p["e"][bucket[a : b + spare]].reshape(-1, self.PARTS * self.DIM)
            for i, w in enumerate(self.WIDTHS):
                n = min(b - a, len(x) - w + 1)  # the last places of all texts stand after the last word
                if n <= 0:
                    continue
                cells = np.concatenate([x[j : n + j] for j in range(w)], 1) if w > 1 else x[:n]
                z = np.maximum(cells @ self.p[f"k{w}"] + self.p[f"b{w}"], 0)
                self.own_places(z, ends[docs] - a, w)
                some = begin < n
                own = (docs[some], slice(i * self.FILTERS, (i + 1) * self.FILTERS))
                found = np.maximum.reduceat(z, begin[some], axis=0)
                if at is not None:
                    # what an earlier slice has reached stays with its place
                    new = np.where(found > top[own], found, np.inf)
                    place, f = np.nonzero(z == np.repeat(new, np.diff(np.r_[begin[some], n]), axis=0))
                    doc = np.searchsorted(ends, place + a, "right")
                    at[w][doc[::-1], f[::-1]] = place[::-1] + a  # of equal answers the first is written last
                top[own] = np.maximum(top[own], found)
        return top

    def logits(self, prepared: tuple[np.ndarray, ...]) -> np.ndarray:
        """Documents' scores before the sigmoid."""
        return self.tops(prepared) @ self.p["v"] + self.p["c"][0]

    def gradients(self, prepared: tuple[np.ndarray, ...], y: np.ndarray) -> dict[str, np.ndarray]:
        """Answers that tie belong, but for collisions, to equal words; the first stands for them."""
        bucket, room = prepared
        at = {w: np.zeros((len(room), self.FILTERS), np.int64) for w in self.WIDTHS}
        top = self.tops(prepared, at)
        d = ((sigmoid(top @ self.p["v"] + self.p["c"][0]) - y) / len(y)).astype(np.float32)
        g = {"v": top.T @ d + 1e-4 * self.p["v"], "c": d.sum(keepdims=True), "e": np.zeros_like(self.p["e"])}
        for i, w in enumerate(self.WIDTHS):
            own = slice(i * self.FILTERS, (i + 1) * self.FILTERS)
            doc, f = np.nonzero(top[:, own])
            words_at = bucket[at[w][doc, f][:, None] + np.arange(w)]
            dz = np.zeros((len(doc), self.FILTERS), np.float32)
            dz[np.arange(len(doc)), f] = d[doc] * self.p["v"][own][f]
            cells = self.p["e"][words_at].reshape(len(doc), -1)
            g[f"k{w}"], g[f"b{w}"] = cells.T @ dz + 1e-4 * self.p[f"k{w}"], dz.sum(0)
            dx = (dz @ self.p[f"k{w}"].T).reshape(*words_at.shape, self.DIM)
            np.add.at(g["e"], words_at, dx)
        g["e"][self.BUCKETS] = 0
        return g


def platt(logits: np.ndarray, y: np.ndarray, n: np.ndarray | int = 1) -> tuple[float, float]:
    """Slope and offset that make sigmoid(a * logit + b) a probability on these rows, each there ``n`` times."""
    a, b = 1.0, 0.0
    if not len(y):
        return a, b
    for _ in range(50):
        p = sigmoid(a * logits + b)
        w = n * (p * (1 - p) + 1e-6)
        h = np.array([[(w * logits * logits).sum() + 1, (w * logits).sum()], [(w * logits).sum(), w.sum() + 1]])
        step = np.linalg.solve(h, [(n * (y - p) * logits).sum() - (a - 1), (n * (y - p)).sum() - b])
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 0.05), b
