"""Whole runs over small record sets."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.cli import arguments
from tessera.plans import pipeline
from tessera.plans.thesis import parse
from tessera.schemas import RECORD, RUN
from tests.test_engine import YAML

T0 = dt.datetime(2024, 6, 1)
THESIS = parse(YAML.replace("[seed, series-a]", "[seed, unknown]"))


def record(source, key, name, domain=None, people=None, day=0, kind="launch"):
    at = T0 + dt.timedelta(day)
    return (f"{source}-{key}", source, key, at, "{}", (name, domain, None, None, people, None, [(kind, 1.0, at, source, None)]))


def reader(spark, *rows):
    return lambda since: spark.createDataFrame(list(rows), RECORD)


def broken(since):
    raise OSError("no network")


def tables(spark, root, run_id):
    store = pipeline.Store(spark, root)
    companies = spark.read.parquet(f"{root}/companies/v{pipeline.versions(spark, f'{root}/companies')[-1]}")
    deals = spark.read.parquet(f"{root}/deals").where(F.col("run_id") == run_id)
    return store, {r.id: r for r in companies.collect()}, {r.company_id: r for r in deals.collect()}


def test_runs(spark, tmp_path):
    root = str(tmp_path)
    readers = {
        "github": reader(spark, record("github", "1", "Acme", "acme.com", kind="github_stars_delta_30d")),
        "hackernews": broken,
        "rss": reader(spark, record("rss", "a", "Acme Inc.", "www.acme.com", day=1), record("rss", "b", "Zephyr crypto", day=1)),
    }
    first = pipeline.run(spark, root, THESIS, readers, F.lit(T0), "run-1")
    assert (first.status, first.failed) == ("partial", ["hackernews"])
    store, companies, deals = tables(spark, root, "run-1")
    assert set(companies) == set(deals) == {"c-github-1", "c-rss-b"}
    assert companies["c-github-1"].canonical_name == "Acme" and companies["c-rss-b"].sector == "crypto"
    assert all(d.score > 0 and d.rationale and d.flags == ["etapa incierta"] for d in deals.values())
    again = pipeline.run(spark, root, THESIS, {**readers, "hackernews": reader(spark)}, F.lit(T0), "run-2")
    assert again.status == "completed"
    store, companies, deals = tables(spark, root, "run-2")
    assert len(companies) == 2 and len(deals) == 2 and store.read("runs", RUN).where("status = 'completed'").count() == 1
    members = spark.read.parquet(f"{root}/members/v2").count()
    assert members == 3


def test_failed_run_is_recorded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pipeline.score, "score_companies", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        pipeline.run(spark, str(tmp_path), THESIS, {"rss": reader(spark, record("rss", "a", "Acme"))}, F.lit(T0), "run")
    assert pipeline.Store(spark, str(tmp_path)).read("runs", RUN).first().status == "failed"


def test_arguments():
    base = ["--thesis", "t", "--root", "r", "--landing", "l"]
    assert arguments([*base, "--source", "rss", "--else", "x"]).source == ["rss"]
    for bad in (["--limit", "0"], ["--source", "nowhere"]):
        with pytest.raises(SystemExit):
            arguments([*base, *bad])
