"""Connectors, watermarks, settings, routes and golden pairs."""

import datetime as dt
import json
import re
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import domain, embed, similarity
from tessera.functions import text as T
from tessera.operators import incremental, resolve
from tessera.plans import api, pipeline, serve
from tessera.plans.thesis import parse
from tessera.schemas import RECORD, WATERMARK, duplicate_domains
from tessera.sources import limits, mentions, pages, stores
from tessera.streaming import ingest
from tests.golden_pairs import PAIRS
from tests.test_engine import YAML
from tests.test_pipeline import record

T0 = dt.datetime(2024, 6, 1)


def bag(text):
    """A 32-bucket bag of words, as the golden pairs' vectors are made."""
    vector = [0.0] * 32
    for word in re.findall(r"[^\W_]+", text.lower()):
        h = 0
        for c in word:
            h = (h * 31 + ord(c)) % (1 << 32)
        vector[h % 32] += 1
    return vector


def test_golden_pairs(spark):
    """All hand-labelled pairs: 16 found, one too many, none missed, 15 left apart."""
    side = "struct<name:string,domain:string,people:array<string>,embedding:array<double>>"
    rows = [(i, truth, *[(n, d, p or [], bag(t) if t is not None else None) for n, d, t, p in (a, b)]) for i, (truth, a, b) in enumerate(PAIRS)]
    df = spark.createDataFrame(rows, f"i int, truth boolean, a {side}, b {side}")
    for s in "ab":
        df = df.withColumn(s, F.struct(T.normalize_name(F.col(f"{s}.name")).alias("name"), domain.normalize_domain(F.col(f"{s}.domain")).alias("domain"), f"{s}.people", f"{s}.embedding"))
    scored = df.select("i", "truth", *resolve.pair_score("a", "b", embeddings=True)).cache()
    got = resolve.confusion(scored, F.col("score") >= resolve.UNCERTAIN, F.col("truth")).first()
    assert (got.tp, got.fp, got.fn, got.tn) == (16, 1, 0, 15) and round(got.precision, 3) == 0.941 and got.recall == 1.0
    by = {r.i: r for r in scored.collect()}
    assert round(by[16].score, 3) == 0.367
    assert (round(by[0].score, 4), by[0].confidence, round(by[1].score, 4), by[1].confidence) == (0.9301, "uncertain", 0.9634, "auto")
    # the bound that spares name comparisons never hides a pair that reaches the floor
    assert {r.i for r in df.where(resolve.possible("a", "b", resolve.UNCERTAIN, True)).collect()} >= {i for i, r in by.items() if r.score >= resolve.UNCERTAIN}


DOMAINS = [
    ("www.acme.com", "acme.com"), ("ACME.COM", "acme.com"), ("blog.acme.com", "acme.com"), ("foo.github.io", None), ("github.io", None), ("my-project.vercel.app", None), ("my-app.herokuapp.com", None),
    ("https://www.acme.com/careers", "acme.com"), ("acme.com/careers", "acme.com"), ("acme.co.uk", "acme.co.uk"), ("www.acme.co.uk", "acme.co.uk"), ("co.uk", None), ("192.168.1.1", None), ("", None), ("   ", None),
    ("localhost", None), ("a.internal", None), ("http://user@shop.acme.de:8080/x", "acme.de"), (None, None), ("a..com", None), ("acme.dev", "acme.dev"), ("com", None),
]


def test_domains(spark):
    df = spark.createDataFrame(DOMAINS, "url string, want string")
    listed = domain.suffix_rules("// a list\ncom\nuk\nco.uk\nde\ndev\nio\n*.ck\n!www.ck\n")
    for rules in (None, listed):
        got = {r.url: r.d for r in df.select("url", domain.normalize_domain(F.col("url"), rules).alias("d")).collect()}
        assert got == dict(DOMAINS)
    assert domain.registrable("a.b.ck", listed) == "a.b.ck" and domain.registrable("x.www.ck", listed) == "www.ck"


def test_names_bound(spark):
    names = ["", "acme", "acme labs", "vercel", "verceld", "zephyr freight", "a"]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    got = df.select(similarity.jaro_winkler("a", "b").alias("jw"), similarity.winkler_at_most(F.col("a"), F.col("b")).alias("most")).collect()
    assert all(r.jw <= r.most + 1e-12 for r in got)


def test_common_keys_are_dealt_in_parts(spark):
    keys = spark.createDataFrame([(i, k) for i in range(60) for k in (["all"] if i % 2 else ["all", f"k{i % 5}"])], "id long, key string")
    for part in (2048, 7):
        got = [(r.lo, r.hi) for r in resolve.candidate_pairs(keys, part).collect()]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(60) for b in range(a + 1, 60)}
    mine, stored = keys.where("id < 3"), keys.where("id >= 3 and key <> 'all'")
    assert {(r.incoming_id, r.stored_id) for r in resolve.overlapping(mine, stored).collect()} == {(i, j) for i in (0, 2) for j in range(4, 60, 2) if i % 5 == j % 5}


def test_batch_resolution_of_records(spark):
    rows = [
        ("r1", "1", "github", T0, "Loglane", "loglane.com", "old", None, T0), ("r2", "2", "rss", T0, "Loglane Inc.", "loglane.com", "rss text", None, T0),
        ("r3", "3", "hackernews", T0, "Quantstack", None, None, ["Ann"], T0), ("r4", "4", "rss", T0, "Quantstack Labs", None, "later", ["ann "], T0), ("r5", "5", "rss", T0, "Zephyr Freight", None, None, None, T0),
    ]
    df = spark.createDataFrame(rows, "id string, position string, source string, fetched_at timestamp, name string, domain string, description string, people array<string>, signal_at timestamp")
    got = {r.record_id: r for r in incremental.resolve_together(df).collect()}
    assert {k: (r.company_id, r.confidence) for k, r in got.items()} == {"r1": ("c-r1", "new"), "r2": ("c-r1", "auto"), "r3": ("c-r3", "new"), "r4": ("c-r3", "uncertain"), "r5": ("c-r5", "new")}
    assert got["r2"].description == "old" and got["r4"].flags == ["merge_incierto"] and got["r4"].canonical_name == "Quantstack Labs" and got["r1"].flags == []


def repo(i, stars, created, **more):
    return {"id": i, "name": f"n{i}", "html_url": f"https://h/{i}", "created_at": created, "stargazers_count": stars, "owner": {"login": "o"}, "homepage": ""} | more


def test_watermarks_follow_each_source(spark, tmp_path):
    """Creation times advance repositories and posts; forks, archives and few stars are not asked for."""
    (tmp_path / "repos.json").write_text(json.dumps({"items": [repo(1, 50, "2024-01-01T00:00:00Z"), repo(2, 9, "2024-02-01T00:00:00Z"), repo(3, 70, "2024-01-05T00:00:00Z"), repo(4, 99, "2024-03-01T00:00:00Z", fork=True), repo(5, 99, "2024-03-01T00:00:00Z", archived=True)]}))
    (tmp_path / "posts.json").write_text(json.dumps({"hits": [{"objectID": str(i), "created_at_i": 100 + i, "title": f"Show HN: P{i}", "points": 1} for i in range(4)]}))
    read = {
        "github": lambda since: mentions.read_repos(spark, str(tmp_path / "repos.json"), F.lit(T0), since, 10, searched=False),
        "hackernews": lambda since: mentions.read_posts(spark, str(tmp_path / "posts.json"), F.lit(T0), int(since) if since else None, 3),
    }
    assert {r.source_id for r in read["github"](None).collect()} == {"1", "3"}
    assert mentions.search_terms("2024-01-01") == "stars:>=10 fork:false archived:false created:>2024-01-01"
    store = pipeline.Store(spark, str(tmp_path / "store"))
    assert pipeline.ingest(store, read) == []
    assert {r.source: r.watermark for r in store.read("watermarks", WATERMARK).collect()} == {"github": "2024-01-05T00:00:00Z", "hackernews": "103"}
    assert store.read("records", RECORD).count() == 5
    assert pipeline.ingest(store, read) == [] and store.read("arrived-github", RECORD).count() == 0
    marks = stores.advanced(spark.createDataFrame([("a", "9")], WATERMARK), spark.createDataFrame([("a", 10), ("b", 3)], "source string, value long"))
    assert {r.source: r.watermark for r in marks.collect()} == {"a": "10", "b": "3"}
    rows = spark.createDataFrame([("a", 10), ("a", 11), ("c", 1)], "source string, at long")
    assert {(r.source, r.at) for r in stores.after(rows, marks, "source", "at").collect()} == {("a", 11), ("c", 1)}


def test_a_broken_feed_does_not_stop_the_others(spark, tmp_path):
    item = "<item><title>{0}</title><link>https://x.example/{0}</link><pubDate>Mon, 0{1} Jan 2024 10:00:00 +0000</pubDate></item>"
    (tmp_path / "a.xml").write_text("<rss><channel>" + "".join(item.format(f"a{i}", i) for i in (1, 3, 2)) + "</channel></rss>")
    (tmp_path / "b.xml").write_text("<rss><channel><item><title>b</item></channel>")
    (tmp_path / "c.xml").write_text("<rss><channel>" + item.format("c1", 4) + "</channel></rss>")
    failed = []
    feeds = [str(tmp_path / f"{x}.xml") for x in "abc"] + [str(tmp_path / "none.xml")]
    got = mentions.read_feeds(spark, feeds, F.lit(T0), None, None, lambda feed, error: failed.append(feed[-5:]))
    assert sorted(r.extracted.name for r in got.collect()) == ["a1", "a2", "a3", "c1"] and failed == ["b.xml", "e.xml"]
    some = mentions.read_feeds(spark, feeds, F.lit(T0), "2024-01-01 12:00:00", 2)
    assert sorted(r.extracted.name for r in some.collect()) == ["a2", "a3"]
    assert mentions.read_feeds(spark, feeds[1:2], F.lit(T0)).count() == 0


def test_refusals_and_cancellation():
    slept = []
    answers = [(403, {"x-ratelimit-remaining": "0", "x-ratelimit-reset": "110"}, None), (200, {}, "ok")]
    assert limits.polite(lambda: answers.pop(0), sleep=slept.append, now=lambda: 100.0) == (200, {}, "ok") and slept == [10.0]
    answers = [(403, {"x-ratelimit-remaining": "0", "retry-after": "3"}, None)] * 3
    assert limits.polite(lambda: answers.pop(0), sleep=slept.append)[0] == 403 and len(answers) == 1 and slept[-1] == 3.0
    assert limits.polite(lambda: (403, {}, None), sleep=slept.append)[0] == 403 and len(slept) == 2
    with pytest.raises(limits.Cancelled):
        limits.polite(lambda: (200, {}, None), stopped=lambda: True)


def test_pages_as_a_data_source(spark, tmp_path):
    for n, items in enumerate(([1, 2], [3, 4], []), 1):
        (tmp_path / f"p{n}.json").write_text(json.dumps({"items": [repo(i, 50, "2024-01-01T00:00:00Z") for i in items]}))
    pages.register(spark)
    read = lambda **more: spark.read.format("tessera_pages").options(url=f"file://{tmp_path}/p{{page}}.json", pages=3, **more).load()
    parsed = lambda df: df.select(F.from_json("body", mentions.REPO_PAGE).alias("p")).select(F.inline("p.items"))
    assert [r.id for r in parsed(read()).collect()] == [1, 2, 3, 4]
    assert [r.id for r in parsed(read(limit=3)).collect()] == [1, 2, 3]
    assert mentions.repos(parsed(read()), F.lit(T0)).count() == 4
    (tmp_path / "stop").write_text("")
    with pytest.raises(Exception, match="stopped before a request"):
        read(stop=str(tmp_path / "stop")).collect()


def test_malformed_pages_fail_the_read(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"items": [{"id": "not a number", "stargazers_count": []}]}')
    (tmp_path / "cut.json").write_text('{"hits": [{"objectID": "1"')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|FAILED_READ"):
        mentions.read_repos(spark, str(tmp_path / "bad.json"), F.lit(T0)).collect()
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|FAILED_READ"):
        mentions.read_posts(spark, str(tmp_path / "cut.json"), F.lit(T0)).collect()


def test_embedding_providers(spark):
    with pytest.raises(ValueError, match="384"):
        embed.Provider("small", 32, embed.deterministic, list)
    row = spark.createDataFrame([("acme",)], "t string").select(embed.DETERMINISTIC.column(F.col("t")).alias("v")).first()
    assert row.v == embed.DETERMINISTIC.one("acme")


def test_config():
    assert config.load({}) == config.Config() and config.load({"PORT": "80", "GITHUB_TOKEN": "x"}).port == 80
    with pytest.raises(config.ConfigError, match="LOG_LEVEL.*PORT.*GITHUB_TOKEN"):
        config.load({"LOG_LEVEL": "loud", "PORT": "0", "GITHUB_TOKEN": ""})


def test_routes(spark, tmp_path):
    """A run over two sources, then every route, its answers and its errors."""
    root, started = str(tmp_path), []
    app = api.Api(spark, root, lambda *a: started.append(a))
    assert app.handle("GET", "/health") == (200, {"status": "ok"})
    assert app.handle("GET", "/deals") == (200, {"runId": None, "items": [], "cursor": None})
    assert app.handle("GET", "/deals/c-x")[0] == 404
    run_id = "0b8f2f64-2c1e-4d0c-9a57-0e7a3c0d6a01"
    rows = [record("github", "1", "Acme", "acme.com"), record("rss", "a", "Acme Inc.", "www.acme.com", day=1), record("rss", "b", "Zephyr crypto", day=1)]
    thesis = parse(YAML.replace("[seed, series-a]", "[seed, unknown]"))
    pipeline.run(spark, root, thesis, {"rss": lambda since: spark.createDataFrame(rows[1:], RECORD), "github": lambda since: spark.createDataFrame(rows[:1], RECORD)}, F.lit(T0), run_id)
    status, page = app.handle("GET", "/deals", {"limit": "1"})
    assert status == 200 and page["runId"] == run_id and len(page["items"]) == 1 and page["cursor"]
    assert len(app.handle("GET", "/deals", {"limit": "1", "cursor": page["cursor"]})[1]["items"]) == 1
    assert app.handle("GET", "/deals", {"limit": "0"})[1]["error"]["code"] == "validation_error"
    status, detail = app.handle("GET", "/deals/c-github-1")
    assert status == 200 and detail["canonical_name"] == "Acme" and [r["source"] for r in detail["records"]] == ["github", "rss"]
    assert app.handle("GET", "/deals/c-nobody")[0] == 404 and app.handle("GET", "/deals/7")[0] == 400
    status, rows = app.handle("GET", "/companies/c-github-1/provenance")
    assert status == 200 and {r["field"]: r.get("source") for r in rows}["canonicalName"] == "github" and len(rows) == 5
    assert app.handle("GET", "/companies/c-nobody/provenance")[0] == 404
    status, answer = app.handle("POST", "/runs", body='{"limitPerSource": 3}')
    assert status == 202 and started == [(answer["runId"], None, 3)]
    assert app.handle("POST", "/runs", body='{"limitPerSource": 0}')[0] == 400
    assert app.handle("GET", f"/runs/{run_id}")[1]["status"] == "completed"
    assert app.handle("GET", "/runs/0b8f2f64-2c1e-4d0c-9a57-0e7a3c0d6a02")[0] == 404 and app.handle("GET", "/runs/x")[0] == 400 and app.handle("PUT", "/deals")[0] == 404
    httpd = api.server(app, 0)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{httpd.server_port}/health") as got:
        assert json.load(got) == {"status": "ok"}
    httpd.shutdown()


def test_ranks_and_store_helpers(spark):
    deals = spark.createDataFrame([(f"c{i:03}", float(i % 3)) for i in range(200)], "company_id string, score double")
    want = {c: n for n, (c, _) in enumerate(sorted(((f"c{i:03}", float(i % 3)) for i in range(200)), key=lambda x: (-x[1], x[0])), 1)}
    assert {r.company_id: r["rank"] for r in serve.ranked(deals).collect()} == want
    assert serve.ranked(deals.limit(0)).count() == 0
    rows = spark.createDataFrame([("a", 1, "x.com", None), ("b", 2, "x.com", None), ("c", 3, "y.com", "a")], "id string, n int, domain string, merged_into string")
    assert [r.n for r in stores.set_column(rows, spark.createDataFrame([("b", 9)], "id string, n int"), "id", "n").orderBy("id").collect()] == [1, 9, 3]
    assert [(r.domain, r.companies) for r in duplicate_domains(rows).collect()] == [("x.com", 2)]
    members = spark.createDataFrame([("a", "r1"), ("c", "r2"), ("c", "r1")], "company_id string, source_record_id string")
    roots = spark.createDataFrame([("c", "a")], "id string, root string")
    assert {(r.company_id, r.source_record_id) for r in stores.cluster_members(members, roots).collect()} == {("a", "r1"), ("a", "r2")}


def test_changes_are_merged_and_compacted(spark, tmp_path, monkeypatch):
    """A batch writes its own rows; the first id of a key stays, the last values count, before and after compaction."""
    monkeypatch.setattr(ingest, "COMPACT", 3)
    root = str(tmp_path / "records")
    rows = lambda *keys, day: spark.createDataFrame([(f"{k}-{day}", *record("rss", k, f"n{day}", day=day)[1:]) for k in keys], RECORD)
    write = ingest.upsert_batch(root)
    for day, keys in enumerate(("ab", "bc", "a", "d")):
        write(rows(*keys, day=day), day)
        assert ingest.versions(spark, root) == ([3] if day >= 2 else [])
    got = {r.source_id: (r.id, r.extracted.name) for r in ingest.current(spark, root).collect()}
    assert got == {"a": ("a-0", "n2"), "b": ("b-0", "n1"), "c": ("c-1", "n1"), "d": ("d-3", "n3")}
    assert ingest.versions(spark, root, "d") == [1, 2, 3, 4]
