"""Embedding classes against brute force, and the pipeline's stages."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from test_documents import similarity
from tessera.llm import classify, decontaminate, pack, pii, secrets, shard, simhash, substrings, vectors

DATA = "/root/testdata/sf0.001"


def plain_classes(x, threshold=0.95):
    n = len(x)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(1))
        if (new == label).all():
            return linked.sum(1), label
        label = new


@pytest.fixture(scope="module")
def cloud():
    """Random vectors, near pairs, a dense group, exact copies."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 32))
    near = x[:100] + rng.normal(size=(100, 32)) * 0.1
    dense = x[5] + rng.normal(size=(300, 32)) * 0.1
    return np.concatenate([x, near, dense, np.repeat(x[7:8], 40, 0)]).astype(np.float32)


@pytest.mark.parametrize("group,part,big", [(4096, 4096, 16384), (128, 64, 16384), (128, 64, 100)])
def test_vector_classes(spark, cloud, group, part, big, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP", group)
    monkeypatch.setattr(vectors, "BIG", big)
    monkeypatch.setattr(vectors, "PART", part)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cloud)], "vec_id long, embedding array<float>").repartition(4)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.digest(df).collect())
    links, label = plain_classes(cloud.astype(np.float64))
    found = sum(r[1] for r in got)
    assert found >= 0.9 * links.sum()  # recall against brute force
    assert all(a[1] <= b for a, b in zip(got, links))
    assert sum(r[2] == c for r, c in zip(got, label)) >= 0.99 * len(got)
    assert all(r[3] == (r[0] == r[2]) for r in got)


def test_levels_below_the_sample_deal_evenly():
    """Bounds of levels that the sample is too small for come from its upper cells; groups stay near the wanted size."""
    x = np.random.default_rng(5).normal(size=(20_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    top = vectors.Top(x[:1000], 32, 7, trees=1)
    assert top.fitted < 7
    row, group = top.route(x)
    assert set(row) == set(range(len(x))) and len(row) < 2.2 * len(x)
    assert np.unique(group, return_counts=True)[1].max() < 4 * len(row) / 128


def test_recall_of_planted_pairs(spark, tmp_path):
    """23,000 vectors, 3,000 of them near others at cosines of 0.95 and more: links against brute force."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 64))
    near = x[:3000] + rng.normal(size=(3000, 64)) * rng.uniform(0.05, 0.32, (3000, 1))
    x = np.concatenate([x, near]).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x))}), tmp_path / "e.parquet")
    got = vectors.digest(spark.read.parquet(str(tmp_path / "e.parquet"))).toPandas().sort_values("vec_id")
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    links = np.concatenate([(unit[i : i + 1000] @ unit.T >= 0.95).sum(1) - 1 for i in range(0, len(x), 1000)])
    print("links", links.sum(), "found", got.n_links.sum())
    assert links.sum() > 5000 and got.n_links.sum() >= 0.98 * links.sum() and (got.n_links.to_numpy() <= links).all()


def test_awkward_vectors(spark):
    a = [1.0, 0.0, 2.0]
    rows = [(1, a), (2, None), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (7, [2.0, 0.0, 4.0]), (8, [1.0, 0.0]), (9, []), (10, a), (None, a), (11, [1e-30, 0.0, 2e-30])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, kept string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.digest(df).collect()}
    linked = {1, 7, 10, 11}
    assert got == {k: (3, 1) if k in linked else (0, k) for k in got} and len(got) == len(rows)
    assert vectors.digest(df.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, before, DATA).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == docs.columns
        if name == "near_duplicates":
            was, now = ({r.doc_id: r.text or "" for r in x.collect()} for x in (before, after))
            assert len(now) == after.count() < len(was)
            for k, text in was.items():
                near = [j for j, t in was.items() if j != k and similarity(text, t) >= simhash.LIKE]
                assert not set(near) & set(now) if k in now else near
        elif name == "decontaminate":
            assert after.count() == before.count()
            hit = {r.doc_id for r in decontaminate.digest(before, bench).where("contaminated").collect()}
            assert hit
            was, now = ({r.doc_id: r.text for r in x.collect()} for x in (before, after))
            assert {k for k in was if was[k] != now[k]} == hit
        elif name == "secrets":
            assert after.count() == before.count()
            assert secrets.digest(after).where("n_assign + n_access + n_hex > 0").count() == 0
        else:
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            kept = {r.doc_id for r in after.collect()}
            good = [k for k, q in labels.items() if q == 1]
            bad = [k for k, q in labels.items() if q == 0]
            assert sum(k in kept for k in good) >= 0.97 * len(good) and sum(k in kept for k in bad) <= 0.2 * len(bad)
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, DATA)
    tokens = packed.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(tokens) == before.count() and all(r[1] == r[2] for r in tokens)


@pytest.fixture(scope="module")
def long_docs(spark):
    """One text of two megabytes next to short ones, with columns whose names operators use for what they add."""
    long = ("word " * 40 + "a@b.cc 4111111111111111 token=abcdefgh\n") * 8000
    rows = [(1, long, "en", "s", len(long)), (2, "short", "en", "s", 5), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["n_words", "spans", "hit_lengths", "items", "score", "threshold", "flagged", "shard", "slot", "fp", "n", "bands", "print", "own", "label", "size", "d", "t", "h", "pii", "length", "start", "node", "id"]
    from pyspark.sql import functions as F

    return docs.withColumns({x: F.lit("mine") for x in names})


def test_long_texts_and_clashing_names(spark, long_docs):
    """Every document operator and its digest."""
    docs = long_docs
    bench = spark.createDataFrame([(1, "word " * 12)], "item_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.n_email for r in pii.digest(docs).collect()} == {8000, 0}
    assert pii.find_pii(docs).count() == 3
    assert {r.n_assign for r in secrets.digest(docs).collect()} == {8000, 0}
    assert decontaminate.digest(docs, bench).where("n_hit > 0").count() == 1
    assert decontaminate.scan(docs, bench, part_bytes=32).where("size(items) = 1").count() == 1
    assert Counter(r.component_id for r in simhash.digest(docs).collect()) == {1: 1, 2: 1, 3: 1}
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.digest(docs).collect()}
    assert removed[1][0] == 43 * 8000 and removed[1][1] > 40 * 7999 and removed[2] == (1, 0) and removed[3] == (0, 0)
    assert {r.doc_id for r in pack.digest(docs).collect()} == {1, 2, 3}
    assert shard.digest(docs).count() == 3
    assert classify.quality(docs, classify.train_quality(docs, none)).count() == 3
    assert classify.toxicity(docs, *classify.train_toxicity(docs, none)).count() == 3


def test_stages_on_long_texts_and_clashing_names(spark, long_docs):
    """Every stage keeps the columns it got; the values of foreign ones stay."""
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, long_docs, DATA)
        if name == "pack":
            assert {r.doc_id for r in got.collect()} == {1, 2, 3}
        else:
            assert got.columns == long_docs.columns, name
            assert all(r.shard == r.bands == r.score == "mine" for r in got.collect())
        empty = stage(spark, long_docs.limit(0), DATA)
        assert empty.count() == 0, name
