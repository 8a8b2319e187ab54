"""Operators on documents against plain versions, on whole texts and awkward rows."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import classify, decontaminate, nets, pack, pii, secrets, shard, simhash, substrings, words

DATA = "/root/testdata/sf0.001"
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SOLID = re.compile("[^\x20\x09-\x0d]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def same(df, want):
    """Rows as multisets."""
    got = Counter(map(tuple, df.collect()))
    want = Counter(want)
    assert got == want, (list((got - want))[:3], list((want - got))[:3])


# --- decontamination ---------------------------------------------------------------


def plain_hits(text, items, width=10):
    words = ALNUM.findall(low(text))
    windows = defaultdict(set)
    for k, t in items:
        own = ALNUM.findall(low(t))
        for i in range(max(1, len(own) - width + 1) if own else 0):
            windows[tuple(own[i : i + width])].add(k)
    hit, names = set(), set()
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            found = windows.get(tuple(words[i : i + size]))
            if found:
                hit |= set(range(i, i + size))
                names |= found
    return words, hit, names


ITEMS = [(1, "every window of ten or twenty words inside it is found to be there"), (2, "two words"), (10, "TWO words"), (3, ""), (4, None), (5, "the same passage of some thirty words stands in two of these texts")]


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_decontaminate(spark, docs, rows, part_bytes):
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    found = decontaminate.scan(docs.select("doc_id", "text").dropDuplicates(), bench, part_bytes=part_bytes)
    for r in found.collect():
        words, hit, names = plain_hits(r.text, ITEMS)
        assert (r.n_words, sum(r.hit_lengths), sorted(set(r["items"]))) == (len(words), len(hit), sorted(map(str, names)))
        for s in r.spans:
            assert set(ALNUM.findall(low(r.text[s.start : s.end]))) <= {words[i] for i in hit}


def test_decontaminate_digest_and_clean(spark, docs, rows, empty):
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    want = []
    for r in rows:
        words, hit, names = plain_hits(r.text, ITEMS)
        want.append((r.doc_id, len(words), len(hit), len(names), sha(",".join(sorted(map(str, names)))), bool(hit)))
    same(decontaminate.digest(docs, bench), want)
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    hits = [plain_hits(r.text, ITEMS) for r in rows]
    kept = Counter(" ".join(x for i, x in enumerate(w) if i not in h) for w, h, _ in hits)
    assert Counter(" ".join(ALNUM.findall(low(r.text))) for r in clean.collect()) == kept
    assert decontaminate.digest(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.digest(docs, bench.limit(0)).collect())


def test_decontaminate_in_parts(spark):
    """Null and repeated ids, repeated rows, repeated items: as with one part, and as the plain version."""
    bench = spark.createDataFrame([*ITEMS, ITEMS[1]], "item_id int, text string")
    line = "The same passage of some thirty words stands in two of these texts, every window of ten or twenty words inside it is found to be there again"
    table = [(None, line), (None, "clean"), (None, "a two words b"), (7, line), (7, f"Clean words stand before it. {line}"), (8, "two words"), (8, "two words"), (9, None)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    hits = [plain_hits(t, ITEMS) for _, t in table]
    for part_bytes in (1 << 20, 120):
        found = decontaminate.scan(docs, bench, part_bytes=part_bytes)
        same(found.selectExpr("doc_id", "text", "n_words", "aggregate(hit_lengths, 0, (a, x) -> a + x)", "array_join(items, ',')"), [(k, t, len(w), len(h), ",".join(sorted(map(str, n)))) for (k, t), (w, h, n) in zip(table, hits)])
        clean = decontaminate.decontaminate(docs, bench, part_bytes=part_bytes)
        same(clean.selectExpr("doc_id", "text is null"), [(k, t is None) for k, t in table])
        left = Counter((r.doc_id, " ".join(ALNUM.findall(low(r.text)))) for r in clean.collect())
        assert left == Counter((k, " ".join(x for i, x in enumerate(w) if i not in h)) for (k, _), (w, h, _) in zip(table, hits))


# --- repeated passages ---------------------------------------------------------------


def plain_removals(rows, window=20):
    """Rows of equal id and text are one document; null ids come last."""
    order = sorted({(r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows}, key=lambda k: (k[0], k[1], xxhash_order(k[2])))
    seen, gone = set(), {}
    for key in order:
        words = SOLID.findall(key[2])
        cut = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                cut |= set(range(i, i + window))
            seen.add(w)
        gone[key] = (words, cut)
    return gone


def xxhash_order(text):
    x = xxhash.xxh64_intdigest(text.encode(), 42)
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("hot", [2000, 1])
def test_substrings(docs, rows, empty, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    gone = plain_removals(rows)
    want = []
    for r in rows:
        words, cut = gone[(r.doc_id is None, r.doc_id or 0, r.text or "")]
        want.append((r.doc_id, len(words), len(cut), sha(" ".join(w for i, w in enumerate(words) if i not in cut))))
    same(substrings.digest(docs), want)
    if hot > 1:
        assert substrings.digest(empty).count() == 0


def mirrored(n):
    """Two different regular words of n letters; hashes by powers of one base modulo 2**64 cannot tell them apart."""
    bits = [i.bit_count() % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_regular_words_are_told_apart(spark, n):
    one, other = mirrored(n)
    line = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{line} {one}"), (2, f"{line} {other}")], "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substrings.digest(docs).collect()} == {1: (20, 0), 2: (20, 0)}
    bench = spark.createDataFrame([(1, f"a b c d e f g h i {other}")], "item_id int, text string")
    docs = spark.createDataFrame([(1, f"a b c d e f g h i {one}"), (2, f"a b c d e f g h i {other}")], "doc_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.digest(docs, bench).collect()} == {1: 0, 2: 10}


def test_numbers_of_words_with_equal_hashes(monkeypatch):
    monkeypatch.setattr(words, "hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    data = np.frombuffer(b"aa b aa cc b dd aa", np.uint8)
    starts, ends, _ = words.bounds(data, np.array([0, len(data)]), words.SOLID)
    number = words.numbers(data, starts, ends)[0]
    assert [number.tolist().index(x) for x in number] == [0, 1, 0, 3, 1, 5, 0]


def test_windows_with_equal_hashes(monkeypatch):
    """Windows that only their hashes take for equal are told apart by the index."""
    lines = [" ".join(f"{k}{i % 7}" for i in range(30)) for k in "abab"]
    rows = pa.table({"words": pa.array([x.encode() for x in lines]), "d": [1, 2, 3, 4], "t": [0] * 4, "start": [0] * 4})
    want = substrings.first_windows(rows, 20).to_pylist()
    monkeypatch.setattr(words, "gram_hashes", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    assert substrings.first_windows(rows, 20).to_pylist() == want
    assert {(r["d"], r["start"], r["n"]) for r in want} == {(1, 0, 7), (2, 0, 7)}


# --- spans ---------------------------------------------------------------------------

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def line(found, kinds):
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted((s, kinds.index(k), k, e) for k, s, e in found))


def test_pii(docs, rows, empty):
    want = []
    for r in rows:
        found = [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, r.text or "") if len(m[0]) < 4000 and good(k, m[0])]
        want.append((r.doc_id, *(sum(f[0] == k for f in found) for k in PII), sha(line(found, list(PII)))))
    got = pii.digest(docs)
    same(got.drop("spans", "scores"), want)
    spans = {r.doc_id: r.spans for r in got.collect()}
    assert "iban:" in spans[100_009]
    assert pii.digest(empty).count() == 0
    scored = pii.find_pii(docs.where("doc_id = 100009")).first().pii
    assert any(s.kind == "card" and s.score > pii.SCORES["card"] for s in scored)


def plain_secrets(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append(("assign", m.start(), m.end()))
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return found + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def test_secrets(docs, rows, empty):
    want = []
    for r in rows:
        found = plain_secrets(r.text or "")
        want.append((r.doc_id, *(sum(f[0] == k for f in found) for k in secrets.BASE), sha(line(found, secrets.BASE))))
    got = secrets.digest(docs)
    same(got.drop("spans"), want)
    assert "live:" in {r.doc_id: r.spans for r in got.collect()}[100_010]
    assert secrets.digest(empty).count() == 0
    masked = secrets.mask(docs)
    assert masked.columns == docs.columns and masked.count() == len(rows)
    assert all(not plain_secrets(r.text or "") for r in masked.collect())


def test_copied_secret_is_an_example(spark):
    rows = [(i, "token = abcdef0123456789abcdef0123456789", f"src{i}") for i in range(5)] + [(9, "token = fedcba9876543210fedcba9876543210", "src1")]
    got = {r.doc_id: r.spans for r in secrets.digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert "live" in got[9] and all("live" not in got[i] for i in range(5))


def test_secret_in_many_repositories_is_an_example(spark):
    """One owner: a value in as many documents as MOST_REPOS is live, in one more it is an example; masking keeps base spans either way."""
    value = {n: f"{n}abcdef0123456789abcdef0123456789" for n in (20, 21)}
    rows = [(n * 100 + i, f"see {value[n]} here", "src1") for n in value for i in range(n)] + [(1, None, None), (2, "", "src2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.spans for r in secrets.digest(docs).collect()}
    assert {k: ("live" in v) for k, v in got.items()} == {k: k // 100 == 20 for k, _, _ in rows}
    assert {r.text for r in secrets.mask(docs).collect()} == {f"see {secrets.MASK} here", None, ""}


def test_context_raises_scores(spark):
    rows = [(1, "my phone +49 30 123456789"), (2, "num +49 30 123456789"), (3, "card 4111111111111111 and 10.0.0.1"), (4, "😀" * 1010 + " my phone +49 30 123456789"), (5, "my phone " + "😀" * 3000 + " +49 30 123456789")]
    got = {r.doc_id: r.scores for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "70", 2: "60", 3: "80,60", 4: "70", 5: "60"}


# --- near copies -----------------------------------------------------------------------


def plain_print(text):
    w = low(text).encode().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_classes(prints, ids, radius=3):
    at = list(range(len(ids)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                at[find(i)] = find(j)
    least = defaultdict(list)
    for i, k in enumerate(ids):
        if k is not None:
            least[find(i)].append(k)
    return [min(least[find(i)], default=None) for i in range(len(ids))]


@pytest.mark.parametrize("most", [512, 4])
def test_simhash(docs, rows, empty, most, monkeypatch):
    monkeypatch.setattr(simhash, "MOST", most)
    prints = [plain_print(r.text) for r in rows]
    ids = [r.doc_id for r in rows]
    classes = plain_classes(prints, ids)
    same(simhash.digest(docs), [(k, f"{p:016x}", c) for k, p, c in zip(ids, prints, classes)])
    if most > 4:
        kept = simhash.dedup(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes))
        assert simhash.digest(empty).count() == 0


def test_loose_group_is_united_exactly(spark, monkeypatch):
    """Near copies at all similarities from 0.5 to 1: components as by comparing all pairs, in one tree and in parts."""
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    table = []
    for k in range(90):
        own = list(base)
        for at in rng.choice(120, int(rng.integers(1, 12)), replace=False):
            own[at] = f"v{rng.integers(0, 400)}"
        table.append((k, " ".join(own)))
    at = list(range(90))
    for i in range(90):
        for j in range(i):
            if similarity(table[i][1], table[j][1]) >= simhash.LIKE:
                at = [min(at[i], at[j]) if x in (at[i], at[j]) else x for x in at]
    assert 10 < len(set(at)) < 80
    docs = spark.createDataFrame(table, "doc_id long, text string")
    for most in (1024, 16):
        monkeypatch.setattr(simhash, "MOST_LONG", most)
        assert {r.doc_id for r in simhash.dedup_similar(docs).collect()} == set(at)


@cache
def five_words(text):
    w = low(text).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    """Jaccard similarity of the sets of 5-word shingles of two texts."""
    x, y = five_words(a), five_words(b)
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("most", [4096, 4])
def test_similar(spark, docs, rows, empty, most, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_LONG", most)
    kept = simhash.dedup_similar(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert max(ids.values()) == 1
    texts = {r.doc_id: r.text or "" for r in rows if r.doc_id is not None}
    for k, text in texts.items():
        others = {j: similarity(text, t) for j, t in texts.items() if j != k}
        if k in ids:
            assert all(s < simhash.LIKE for j, s in others.items() if j in ids)
        else:
            assert max(others.values()) >= simhash.LIKE
    assert simhash.dedup_similar(empty).count() == 0


def test_similar_planted(spark):
    rng = np.random.default_rng(4)
    table = []
    for k in range(0, 400, 4):
        own = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 400)))]
        near, far = list(own), [f"w{x}" for x in rng.integers(0, 5000, 80)]
        near[len(own) // 2] = "changed"
        table += [(k, " ".join(own)), (k + 1, " ".join(near)), (k + 2, " ".join(own[:20] + far)), (k + 3, " ".join(far[:2]))]
    kept = {r.doc_id for r in simhash.dedup_similar(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert kept == {k for k, _ in table if k % 4 != 1}


def edited(own, least, most):
    """``own`` with words changed, one by one, until its similarity is in [least, most)."""
    new, at = list(own), 7
    while similarity(" ".join(own), " ".join(new)) >= most:
        new[at] = "changed"
        at += 5
    assert least <= similarity(" ".join(own), " ".join(new)) < most
    return " ".join(new)


def kept_of_pairs(spark, least, most):
    """Ids that stay of 150 unrelated pairs (2k, 2k + 1) of texts with a similarity in [least, most)."""
    rng = np.random.default_rng(9)
    table = []
    for k in range(0, 300, 2):
        own = [f"w{x}" for x in rng.integers(0, 50_000, int(rng.integers(150, 400)))]
        table += [(k, " ".join(own)), (k + 1, edited(own, least, most))]
    return {r.doc_id for r in simhash.dedup_similar(spark.createDataFrame(table, "doc_id long, text string")).collect()}


def test_similar_finds_every_pair(spark):
    assert kept_of_pairs(spark, 0.8, 0.84) == set(range(0, 300, 2))


def test_similar_keeps_all_others(spark):
    assert kept_of_pairs(spark, 0.75, 0.8) == set(range(300))


def test_bk_forest_finds_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    x = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(b)) for b in (1, 9, 40)] + [base, base ^ np.uint64(0b1111)]))
    group = np.zeros(len(x), np.int64)
    forest = simhash.Forest(x, group)
    got = set()
    for a, b in forest.search(np.arange(len(x)), 3):
        got |= set(zip(a.tolist(), b.tolist()))
    assert got == {(i, j) for i in range(len(x)) for j in range(len(x)) if i != j and int(x[i] ^ x[j]).bit_count() <= 3}


# --- packing ---------------------------------------------------------------------------


def test_pack(docs, rows, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(pack.default_tokenizer())
    ids = {(r.doc_id, r.text): [*own.encode(r.text or "", add_special_tokens=False).ids, 1] for r in rows}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pack.pack(docs).collect():
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    copies = Counter(r.doc_id for r in rows)
    for (k, _), want in ids.items():
        parts = Counter()
        for p in by_doc[k]:
            assert p.doc_tokens == len(want) and p.ids_crc32 == zlib.crc32(np.array(want[p.start : p.start + p.length], "<u4").tobytes())
            parts.update(range(p.start, p.start + p.length))
        assert parts == Counter({i: copies[k] for i in range(len(want))})
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 2048 or at & (at - 1) == 0
    assert pack.digest(empty).count() == 0


def test_packed_sequences_hold_the_ids(docs, rows):
    some = docs.where("doc_id < 30")
    packed = pack.sequences(some)
    total = Counter(i for r in packed.collect() for i in r.ids)
    encode = pack.encoder(pack.default_tokenizer())
    assert total == Counter(i for r in rows if r.doc_id is not None and r.doc_id < 30 for i in [*encode(r.text or ""), 1])


def test_other_tokenizer_files_are_followed(tmp_path):
    """A normalizer or another pre-tokenizer in the file counts."""
    import json

    with open(pack.default_tokenizer(), encoding="utf-8") as f:
        model = json.load(f)
    assert pack.plain_byte_bpe(model)
    model["normalizer"] = {"type": "Lowercase"}
    path = str(tmp_path / "lower.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(model, f)
    assert pack.encoder(path)("Some TEXT") == pack.encoder(pack.default_tokenizer())("some text")


def test_plan_fills_windows():
    plan = pack.Plan({2048: 3, 2000: 2, 48: 5, 1000: 4, 24: 4, 700: 1})
    assert plan.stream_from + plan.whole >= 3
    assert pack.fill(np.bincount([3, 5, 5, 9], minlength=30), 13) == (13, {5: 2, 3: 1})


# --- shards ----------------------------------------------------------------------------


def test_shards(spark, docs, rows, empty):
    got = shard.digest(docs).collect()
    assert len(got) == len(rows)
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    assert set(by) <= set(range(8))
    assert shard.digest(empty).count() == 0


def spark_hash(*values):
    """Spark's xxhash64 of longs, ints and texts."""
    h = 42
    for v, form in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if form == "s" else struct.pack(form, v), h)
    return h - (1 << 64) if h >> 63 else h


def plain_tree(rows, depth=3):
    """Leaves of the k-d tree by sorting: {(group, piece): shard}."""
    top, unit = 1 << shard.VALUE_BITS, lambda x: spark_hash((x or "", "s")) % (1 << shard.VALUE_BITS) / (1 << shard.VALUE_BITS)
    size = lambda r: len((r.text or "").encode()) + 1
    most = max(1.0, sum(map(size, rows)) / 8 * shard.SPLIT_SHARE)
    texts = defaultdict(list)
    for r in rows:
        texts[spark_hash((r.text or "", "s"))].append(r)
    groups = defaultdict(list)
    for g, own in texts.items():
        weight = sum(map(size, own))
        for r in own:
            groups[g, spark_hash((r.doc_id, "<q")) % math.ceil(weight / most) if weight > most else 0].append(r)
    least = lambda own, f: min((getattr(r, f) for r in own if getattr(r, f) is not None), default=None)
    at = {k: least(own, "doc_id") for k, own in groups.items()}
    known = [x for x in at.values() if x is not None]
    scale, lo, span = math.log(max(map(size, rows)) + 2) / math.log(2), min(known), max(known) - min(known) + 1.0
    facts = {}
    for k, own in groups.items():
        tie = (spark_hash((k[0], "<q"), (k[1], "<i")) % (1 << 64)) >> (64 - (shard.KEY_BITS - shard.VALUE_BITS))
        length = math.log(max(map(size, own)) + 1) / math.log(2) / scale
        facts[k] = (sum(map(size, own)), [length, unit(least(own, "source")), unit(least(own, "lang")), 0.0 if at[k] is None else (at[k] - lo) / span], tie)
    nodes = [list(groups)]
    for _ in range(depth):
        halves = []
        for node in nodes:
            total = sum(facts[k][0] for k in node)
            if not node:
                halves += [[], []]
                continue
            spread = [sum(facts[k][0] * facts[k][1][d] ** 2 for k in node) / total - (sum(facts[k][0] * facts[k][1][d] for k in node) / total) ** 2 for d in range(4)]
            axis = max(range(4), key=lambda d: (spread[d], -d))
            order = sorted(node, key=lambda k: (min(int(facts[k][1][axis] * top), top - 1), facts[k][2]))
            before = 0
            for n, k in enumerate(order):
                upto = before + facts[k][0]
                if upto * 2 >= total:
                    break
                before = upto
            n += not (before > 0 and upto * 2 - total > total - before * 2)
            halves += [order[:n], order[n:]]
        nodes = halves
    return {k: i for i, node in enumerate(nodes) for k in node}, texts, most, size


def test_shards_against_a_plain_tree(docs, rows):
    leaf, texts, most, size = plain_tree(rows)
    want = Counter()
    for r in rows:
        g = spark_hash((r.text or "", "s"))
        weight = sum(map(size, texts[g]))
        want[r.doc_id, leaf[g, spark_hash((r.doc_id, "<q")) % math.ceil(weight / most) if weight > most else 0]] += 1
    assert Counter((r.doc_id, r.shard) for r in shard.digest(docs).collect()) == want


def test_shards_are_near_equal_with_a_hot_group(spark):
    rows = [(i, ("copied text " * 20) if i % 3 == 0 else f"text {i} " * (i % 40 + 1), "en", f"s{i % 2}") for i in range(6000)]
    got = shard.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 8 and max(sizes) < 1.03 * min(sizes)


# --- classifiers -----------------------------------------------------------------------


def plain_byte_logit(net, raw):
    """The byte network by loops: filters, the largest answer in each chunk, the largest and the mean over chunks."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    places = max(1, -(-(len(raw) - net.WIDTH) // net.STRIDE) + 1)
    raw = raw + bytes(net.WIDTH + net.STRIDE * places - len(raw))
    answers = []
    for i in range(places):
        x = np.concatenate([p["e"][b] for b in raw[i * net.STRIDE : i * net.STRIDE + net.WIDTH]])
        answers.append([max(0.0, sum(x[j] * p["k"][j, f] for j in range(len(x))) + p["b"][f]) for f in range(net.FILTERS)])
    halves = -(-places // net.HALF)
    chunks = [answers[h * net.HALF : (h + 2) * net.HALF] for h in range(max(1, halves - 1))]
    tops = [[max(a[f] for a in c) for f in range(net.FILTERS)] for c in chunks]
    features = [max(t[f] for t in tops) for f in range(net.FILTERS)] + [sum(t[f] for t in tops) / len(tops) for f in range(net.FILTERS)]
    return sum(a * b for a, b in zip(features, p["v"])) + p["c"][0]


def plain_word_logit(net, raw):
    """The word network by loops: buckets of words and stems, filters of each width, the largest answer over the text."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def bucket(w, n=None):
        data = np.frombuffer(w if n is None else w[:n], np.uint8)
        h = words.hashes(data, np.array([0]), np.array([len(data)]))
        return int((h if n is None else words.mix(h + np.uint64(n)))[0] % np.uint64(net.BUCKETS))

    own = [[bucket(w), *(bucket(w, n) for n in net.STEMS)] for w in (m.encode() for m in ALNUM.findall(low(raw.decode())))]
    own += [[net.BUCKETS] * net.PARTS] * (max(net.WIDTHS) * 2)
    features = []
    for width in net.WIDTHS:
        answers = []
        for i in range(len(own) - max(net.WIDTHS)):
            x = np.concatenate([p["e"][b] for word in own[i : i + width] for b in word])
            answers.append([max(0.0, sum(x[j] * p[f"k{width}"][j, f] for j in range(len(x))) + p[f"b{width}"][f]) for f in range(net.FILTERS)])
        features += [max(a[f] for a in answers) for f in range(net.FILTERS)]
    return sum(a * b for a, b in zip(features, p["v"])) + p["c"][0]


@pytest.mark.parametrize("kind,plain", [(nets.ByteNet, plain_byte_logit), (nets.WordNet, plain_word_logit)])
def test_networks_against_loops(kind, plain, monkeypatch):
    monkeypatch.setattr(kind, "SLICE", 8)
    rng = np.random.default_rng(3)
    net = kind()
    for v in net.p.values():
        v += rng.normal(0, 0.2, v.shape).astype(np.float32)
    texts = ["", "a", "one two", "Ünïcödé 漢字 😀", "the words of a longer text, " * 9, "x" * 300, "end"]
    got = net.logits(net.prepare(*words.utf8(pa.array(texts))))
    assert np.allclose(got, [plain(net, t.encode()) for t in texts], rtol=1e-3, atol=1e-3)
    for t, logit in zip(texts, got):  # the block around a text does not matter
        assert abs(net.logits(net.prepare(*words.utf8(pa.array([t]))))[0] - logit) < 1e-3


@pytest.mark.parametrize("kind", [nets.ByteNet, nets.WordNet])
def test_gradients_against_differences(kind):
    net = kind()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    docs = net.prepare(*words.utf8(pa.array(["some words of a text", "others " * 30, "third"])))
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.logits(docs).astype(np.float64)
        return float((np.log1p(np.exp(z)) - y * z).mean())

    for name, g in net.gradients(docs, y).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        weight = net.p[name][at]
        decay = 1e-4 * weight if name[0] in "kv" else 0.0
        steps = []
        for d in (1e-3, -1e-3):
            net.p[name][at] = weight + d
            steps.append(loss())
        net.p[name][at] = weight
        assert abs((steps[0] - steps[1]) / 2e-3 - (g[at] - decay)) < 0.1 * abs(g[at]) + 1e-4, name


def test_gradients_of_sliced_texts(monkeypatch):
    net = nets.WordNet()
    docs = net.prepare(*words.utf8(pa.array(["some words of a text", "", "others " * 30, "a longer text, word after word, and word after text " * 5])))
    y = np.array([1.0, 0.0, 1.0, 0.0], np.float32)
    whole = net.gradients(docs, y)
    monkeypatch.setattr(nets.WordNet, "SLICE", 8)
    for name, g in net.gradients(docs, y).items():
        assert np.allclose(g, whole[name], rtol=1e-4, atol=1e-7), name


def test_training_sample_is_bounded(spark):
    """Rows of a repeated id count once, long texts and the held-out fold not at all."""
    docs = spark.createDataFrame([(i % 40, f"text {i}", "en") for i in range(400)] + [(100, "x" * 5000, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(40), 100]], "doc_id long, quality int")
    rows = classify.labelled(docs, labels, "quality", 20, 1000, "doc_id", "text", "lang")
    ids = rows.column("k").to_pylist()
    assert len(ids) == len(set(ids)) <= 20 and all(zlib.crc32(k.encode()) % 5 for k in ids)


def test_toxicity_learns_from_every_row(spark):
    """What only long texts, or only rows late in any order of ids, can teach is learned; the order of rows does not matter."""
    ids = spark.range(12000).withColumnRenamed("id", "doc_id").where((classify.fold("doc_id") != 0)).orderBy(F.xxhash64("doc_id"), "doc_id")
    late = {r.doc_id for r in ids.collect()[8000:]}
    plain = "some plain words of a quiet text number "
    texts = [(i, plain + str(i) + (" gribbly" if i in late and i % 2 else ""), "en") for i in range(12000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.contains("text", F.lit("gribbly")).cast("int").alias("toxic"))
    rows, parts = classify.dealt(docs, labels, "toxic", 4000, 1 << 26, "doc_id", "text", "lang")
    assert rows.rdd.getNumPartitions() == parts == 3 and {r.k for r in rows.select("k").collect()} == {str(r.doc_id) for r in ids.collect()}
    model, _ = classify.train_toxicity(docs, labels, visits=2000)
    probe = pa.array([plain + "gribbly", plain])
    assert (model.score(probe) >= classify.TOXIC_AT).tolist() == [True, False]
    again, _ = classify.train_toxicity(docs.repartition(7), labels, visits=2000)
    assert again.score(probe).tolist() == model.score(probe).tolist()

    long = "words of a quiet text " * 3500  # 77,000 bytes
    docs = spark.createDataFrame([(i, ("gribbly " + long) if i % 2 else plain, "en") for i in range(60)], docs.schema)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    for parts in (1, 3):
        model, _ = classify.train_toxicity(docs, labels, part_bytes=-(-2_500_000 // parts), visits=2000)
        assert (model.score(pa.array(["gribbly " + long, plain])) >= classify.TOXIC_AT).tolist() == [True, False]


def test_classifiers(spark, docs, rows, empty):
    """Accuracy on documents of the held-out fold alone, of a table that is not part of the training."""
    base, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = base.where(classify.fold("doc_id") == 0)
    for label, at, visits in (("quality", classify.KEEP_AT, 6000), ("toxic", classify.TOXIC_AT, 6000)):
        if label == "quality":
            model = classify.train_quality(base, labels, visits=visits)
            judge = lambda d: classify.digest(classify.quality(d, model), at)
        else:
            model, thresholds = classify.train_toxicity(base, labels, visits=visits)
            judge = lambda d: classify.digest(classify.toxicity(d, model, thresholds), at, "threshold", "flagged")
        got = judge(docs).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
        assert len({r.score for r in got if r.doc_id in (100_000, 100_001)}) == 1
        truth = {r.doc_id: r[label] for r in labels.collect()}
        judged = [(r.predicted, truth[r.doc_id]) for r in judge(held).collect() if r.doc_id in truth]
        assert len(judged) > 30 and sum(a == b for a, b in judged) / len(judged) > 0.88
        assert judge(empty).count() == 0
    unlabelled, none = classify.train_toxicity(base, labels.limit(0))
    assert classify.toxicity(docs.drop("lang"), unlabelled, none).count() == len(rows)
