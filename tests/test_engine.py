"""Scoring, clusters, stores, serving, sources and streams on small fixtures."""

import datetime as dt
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import enrich, graph, incremental, resolve, score
from tessera.plans import serve
from tessera.plans.thesis import ThesisError, parse
from tessera.schemas import RECORD
from tessera.sources import limits, mentions, stores
from tessera.streaming import ingest

T0 = dt.datetime(2024, 6, 1)
YAML = """
name: Dev tools
description: Tools for developers
hard_filters: {stages: [seed, series-a], exclude_sectors: [gambling]}
soft_preferences: {sectors: [], geos: [], keywords: [open-source, api-first]}
anti_patterns: [no code in public repo]
weights: {semantic: 0.4, momentum: 0.3, keywords: 0.2, recency: 0.1}
"""


def test_thesis():
    t = parse(YAML)
    assert t.stages == ("seed", "series-a") and t.text == "Dev tools. Tools for developers"
    for bad in (YAML.replace("0.4", "0.5"), YAML.replace("seed,", "sead,"), YAML + "more: 1\n", YAML.replace("[seed, series-a]", "[]"), "[1", "7"):
        with pytest.raises(ThesisError):
            parse(bad)


def test_percentile(spark):
    for values, want in (([3.0, 3.0, 9.0], [1 / 3, 1 / 3, 5 / 6]), ([42.0], [0.5]), ([], [])):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = score.percentile(df, "v", "p").orderBy("v").collect()
        assert [r.p for r in got] == pytest.approx(want)


def test_scoring(spark):
    thesis = parse(YAML)
    base = dict(domain=None, one_liner=None, merged_into=None)
    rows = [
        ("a", "Alpha open-source", "api-first", "seed", None, ["merge_incierto"], T0),
        ("b", "Beta", "no code in public repo", "seed", "gambling", [], T0),
        ("c", "Gamma", None, None, None, [], T0 - dt.timedelta(days=30)),
        ("d", "Delta", "open-source", "series-a", "data", [], T0 - dt.timedelta(days=30)),
    ]
    companies = spark.createDataFrame(rows, "id string, canonical_name string, description string, estimated_stage string, sector string, flags array<string>, first_seen_at timestamp").withColumns({k: F.lit(v).cast("string") for k, v in base.items()})
    sig = spark.createDataFrame([("a", "hn_points", 10.0, T0), ("a", "hn_points", 50.0, T0 - dt.timedelta(1)), ("d", "github_stars", 9e9, T0)], "company_id string, kind string, value double, observed_at timestamp")
    fit = spark.createDataFrame([("a", 1.0), ("d", 0.5)], "company_id string, semantic double")
    got = {r.company_id: r for r in score.score_companies(companies, sig, fit, thesis, F.lit(T0), "run").collect()}
    assert got["a"].score == pytest.approx(100 * (0.4 + 0.3 * 0.75 + 0.2 + 0.1))
    assert got["d"].breakdown.recency.value == pytest.approx(0.5) and got["d"].breakdown.keywords.value == 0.5 and got["d"].breakdown.momentum.value == 0.25
    assert got["b"].score == 0 and got["b"].breakdown.failed_hard_filter == "sector 'gambling' is in thesis.hard_filters.exclude_sectors"
    assert got["c"].flags == ["etapa incierta"] and "does not include 'unknown'" in got["c"].breakdown.failed_hard_filter and got["c"].breakdown.semantic.weight == 0
    assert got["a"].rationale.startswith('Alpha open-source scores 93/100 against the "Dev tools" thesis, driven mostly by semantic fit with the thesis.')
    assert "Merged" not in got["a"].rationale and "Known context — stage seed; merged from multiple" in got["a"].rationale


def test_enrichment_policy(spark):
    df = spark.createDataFrame([("X", "a crypto marketplace", None, None), ("Y", "fintech", "own", "line")], "canonical_name string, description string, sector string, one_liner string")
    got = enrich.enrich(df).orderBy("canonical_name").collect()
    assert (got[0].sector, got[0].one_liner) == ("crypto", "a crypto marketplace") and (got[1].sector, got[1].one_liner) == ("own", "line")
    new = df.select(enrich.apply_policy(F.lit("old"), F.lit("new"), F.lit(0.5)).alias("x")).first()
    assert new.x == "new"


@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=20))
@settings(max_examples=5, deadline=None)
def test_components(spark, edges):
    label = list(range(15))
    for _ in range(15):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = graph.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.label for r in got} == {x: label[x] for e in edges if e[0] != e[1] for x in e}


def test_merge_chain_and_survivors(spark):
    items = spark.createDataFrame([("A", T0), ("B", T0 + dt.timedelta(1)), ("C", T0 + dt.timedelta(2))], "id string, first_seen_at timestamp")
    edges = spark.createDataFrame([("A", "B", 0.9), ("B", "C", 0.85)], "lo string, hi string, score double")
    got = {(r.absorbed, r.survivor, r.pair_score) for r in resolve.survivors(edges, items).collect()}
    assert got == {("B", "A", 0.9), ("C", "A", 0.85)}
    chain = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "a")], "id string, merged_into string")
    assert {r.id: r.root for r in resolve.canonical(chain).collect()} == {"c": "a", "b": "a", "x": "a"}
    with pytest.raises(Exception, match="cycle"):
        resolve.canonical(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, merged_into string")).collect()


def test_field_conflict(spark):
    rows = [("c", "1", "hn", "hackernews", T0 + dt.timedelta(9)), ("c", "2", "old", "github", T0), ("c", "3", "new", "github", T0 + dt.timedelta(1)), ("c", "4", None, "github", T0 + dt.timedelta(2)), ("d", "5", "?", "else", T0), ("d", "6", "rss", "rss", T0)]
    got = resolve.resolve_field(spark.createDataFrame(rows, "k string, id string, value string, source string, observed_at timestamp"), ["k"])
    assert {r.k: r.value for r in got.collect()} == {"c": "new", "d": "rss"}


def _record(i, name, source="hackernews", domain=None, people=None, days=0):
    return (i, int(i[1:]), source, T0 + dt.timedelta(days), name, domain, None, people, T0 + dt.timedelta(days))


def test_incremental_resolution(spark):
    rows = [
        _record("r1", "Loglane", "github", "loglane.com"), _record("r2", "Loglane", "rss", "loglane.com", days=1),
        _record("r3", "Quantstack", people=["Ann"]), _record("r4", "Quantstack Labs", people=["ann "], days=2), _record("r5", "Zephyr Freight"),
    ]
    df = spark.createDataFrame(rows, "id string, position int, source string, fetched_at timestamp, name string, domain string, description string, people array<string>, signal_at timestamp")
    got = {r.record_id: r for r in incremental.resolve_in_order(df).collect()}
    assert got["r2"].company_id == "c-r1" and got["r2"].confidence == "auto" and got["r2"].flags == []
    assert got["r4"].company_id == "c-r3" and got["r4"].flags == ["merge_incierto"] and got["r5"].company_id == "c-r5"


def test_batch_resolution(spark):
    rows = [(1, "loglane", "loglane.com", [], T0), (2, "loglane", None, [], T0), (3, "zephyr", "zephyr.io", [], T0)]
    items = spark.createDataFrame(rows, "id long, name string, domain string, people array<string>, first_seen_at timestamp")
    for most in (None, 1):  # even where every key is too common, equal names meet
        assert {(r.absorbed, r.survivor) for r in resolve.resolve_batch(items, most).collect()} == {(2, 1)}


def test_stores(spark, tmp_path):
    old = spark.createDataFrame([("i1", "s", "1", "a"), ("i2", "s", "2", "b")], "id string, source string, source_id string, raw string")
    new = spark.createDataFrame([("n1", "s", "2", "c"), ("n2", "s", "3", "d")], old.schema)
    got = {r.source_id: (r.id, r.raw, r.is_new) for r in stores.upsert(old, new, ["source", "source_id"]).collect()}
    assert got == {"1": ("i1", "a", False), "2": ("i2", "c", False), "3": ("n2", "d", True)}
    marks = spark.createDataFrame([("hn", "99")], "source string, watermark string")
    seen = spark.createDataFrame([(100,), (7,)], "at long")
    assert stores.advance(marks, "hn", seen, "at", True).first().watermark == "100"
    assert stores.advance(marks, "hn", seen.where("at < 50"), "at", True).first().watermark == "99"
    assert stores.advance(marks, "hn", seen, "at", False).first().watermark == "99"
    runs = spark.createDataFrame([("r1", "t", "running", T0, None, None)], "id string, thesis_name string, status string, started_at timestamp, finished_at timestamp, stats struct<failed_sources array<string>>")
    assert stores.latest_run(runs).count() == 0
    done = stores.finish_run(runs, "r1", "partial", F.lit(T0), ["github"])
    assert stores.latest_run(done).first().stats.failed_sources == ["github"]
    with pytest.raises(KeyError):
        stores.finish_run(runs, "no", "completed", F.lit(T0), [])
    companies = spark.createDataFrame([("a", None, []), ("b", None, [])], "id string, merged_into string, flags array<string>")
    merged = {r.id: r for r in stores.merged(companies, spark.createDataFrame([("b", "a", "uncertain")], "absorbed string, survivor string, confidence string")).collect()}
    assert merged["b"].merged_into == "a" and merged["a"].flags == ["merge_incierto"]
    path = str(tmp_path / "deals")
    for run, value in (("r1", 1.0), ("r2", 2.0), ("r1", 3.0)):
        stores.replace_run(spark.createDataFrame([(run, value)], "run_id string, score double"), path)
    assert {(r.run_id, r.score) for r in spark.read.parquet(path).collect()} == {("r1", 3.0), ("r2", 2.0)}


def test_keyset_pages(spark):
    deals = spark.createDataFrame([("run", f"c{i}", s) for i, s in enumerate([90.0, 50.0, 50.0, 10.0])], "run_id string, company_id string, score double")
    companies = spark.createDataFrame([(f"c{i}", f"N{i}", None, "data", "seed", None) for i in range(4)], "id string, canonical_name string, domain string, sector string, estimated_stage string, one_liner string")
    runs = spark.createDataFrame([("run", "completed", T0)], "id string, status string, finished_at timestamp")
    seen, cursor = [], None
    while True:
        page = serve.deal_page(deals, companies, runs, serve.DealQuery(limit=1, cursor=serve.decode_cursor(cursor) if cursor else None))
        seen += [x["company_id"] for x in page["items"]]
        cursor = page["cursor"]
        if cursor is None:
            break
    assert seen == ["c0", "c1", "c2", "c3"]
    assert serve.deal_page(deals, companies, runs.limit(0), serve.DealQuery()) == {"runId": None, "items": [], "cursor": None}
    for bad in ({"limit": "0"}, {"minScore": "101"}, {"stage": "x"}, {"cursor": "??"}):
        with pytest.raises(serve.RequestError):
            serve.DealQuery.parse(bad)


def test_sources(spark, tmp_path):
    (tmp_path / "repos.json").write_text(json.dumps({"total_count": 2, "incomplete_results": False, "items": [{"id": 7, "name": "thing", "html_url": "https://x/y", "description": "", "homepage": "www.thing.dev/a", "created_at": "2024-01-01T00:00:00Z", "stargazers_count": 5, "owner": {"login": "ann"}}, {"id": 8, "name": "none", "html_url": "https://x/z", "homepage": "", "created_at": "2024-01-01T00:00:00Z", "stargazers_count": 0}]}))
    stars = spark.createDataFrame([("ann/thing", T0 - dt.timedelta(10))] * 3 + [("ann/thing", T0 - dt.timedelta(45))] * 2, "full_name string, starred_at timestamp")
    got = {r.source_id: r.extracted for r in mentions.read_repos(spark, str(tmp_path / "repos.json"), F.lit(T0), deltas=mentions.star_delta(stars, F.lit(T0))).collect()}
    assert got["7"].domain == "www.thing.dev" and got["7"].people == ["ann"] and [(s.kind, s.value) for s in got["7"].signals] == [("github_stars", 5), ("github_stars_delta_30d", 3)]
    assert got["8"].domain is None and got["8"].signals[1].value == 0
    (tmp_path / "hn.json").write_text(json.dumps({"page": 0, "nbPages": 1, "hits": [{"objectID": "40333333", "created_at_i": 1700000300, "title": "Show HN: MyThing", "url": "https://my.thing", "points": None, "author": None}]}))
    post = mentions.read_posts(spark, str(tmp_path / "hn.json"), F.lit(T0), since=1700000000).first()
    assert post.extracted.name == "MyThing" and post.extracted.domain is None and post.extracted.people is None and post.extracted.signals[0].value == 0
    assert mentions.read_posts(spark, str(tmp_path / "hn.json"), F.lit(T0), since=1700000300).count() == 0
    (tmp_path / "rss.xml").write_text("<rss><channel><item><title>Acme raises</title><link>https://t/a</link><guid>https://t/?p=1</guid><pubDate>Thu, 13 Aug 2026 22:12:40 +0000</pubDate></item><item><title> </title><pubDate>Thu, 13 Aug 2026 22:12:40 +0000</pubDate></item><item><title>Undated</title></item></channel></rss>")
    (tmp_path / "atom.xml").write_text('<feed><entry><title>Atom thing</title><link href="javascript:x" rel="alternate"/><published>2026-08-14T00:00:00Z</published><summary>text</summary></entry></feed>')
    items = mentions.read_feed(spark, str(tmp_path / "rss.xml")).unionByName(mentions.read_feed(spark, str(tmp_path / "atom.xml")))
    got = {r.extracted.name: r for r in mentions.feed_items(items, F.lit(T0)).collect()}
    assert set(got) == {"Acme raises", "Atom thing"} and got["Acme raises"].source_id == "https://t/?p=1"
    assert got["Acme raises"].extracted.signals[0].observed_at == dt.datetime(2026, 8, 13, 22, 12, 40) and got["Atom thing"].extracted.url is None
    assert len(got["Atom thing"].source_id) == 64
    assert mentions.feed_items(items, F.lit(T0), F.lit(dt.datetime(2026, 8, 13, 22, 12, 40))).count() == 1


def test_stream_is_idempotent(spark, tmp_path):
    landing, root = str(tmp_path / "in"), str(tmp_path / "records")
    row = lambda i, raw, day: (f"id{i}{raw}", "rss", str(i), T0 + dt.timedelta(day), raw, None)
    spark.createDataFrame([row(1, "a", 0), row(2, "b", 0)], RECORD).write.parquet(landing)
    for _ in range(2):
        ingest.ingest(ingest.arrivals(spark, landing), root, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([row(2, "c", 1), row(3, "d", 1)], RECORD).write.mode("append").parquet(landing)
    ingest.ingest(ingest.arrivals(spark, landing), root, str(tmp_path / "cp")).awaitTermination()
    got = {r.source_id: (r.id, r.raw) for r in ingest.current(spark, root).collect()}
    assert got == {"1": ("id1a", "a"), "2": ("id2b", "c"), "3": ("id3d", "d")}


def test_limits():
    at, slept = [0.0], []
    bucket = limits.TokenBucket(2, 1, lambda: at[0], slept.append)
    for _ in range(3):
        bucket.take()
    assert slept == [1.0] and limits.backoff(1, rand=lambda: 0) == 0.15 and limits.backoff(9, rand=lambda: 1) == 8.0
    assert limits.reset_wait({"x-ratelimit-reset": "110"}, 100) == 10 and limits.reset_wait({}, 0) == 60
    tries = iter([(503, None), (429, None), (200, "ok")])
    assert limits.retry(lambda: next(tries), sleep=lambda s: None) == (200, "ok")
