"""Names, domains, similarity and the golden pairs' figures."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import domain as D
from tessera.functions import embed, similarity
from tessera.functions import text as T
from tessera.operators import resolve


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("name,want", [
    ("Acme Inc.", "acme"), ("Acme S.A.", "acme"), ("Acme Ltd Inc", "acme"), ("Acme, Widgets & Co.", "acme widgets co"),
    ("Café Solutions", "cafe solutions"), ("Müller Analytics", "muller analytics"), (", Inc", "inc"), ("GreenGrid S.R.L.", "greengrid"), ("  Two   words ", "two words"), ("Incline", "incline"),
])
def test_normalize_name(spark, name, want):
    assert one(spark, T.normalize_name(F.col("n")), n=name) == want


@pytest.mark.parametrize("url,want", [
    ("www.acme.com", "acme.com"), ("ACME.COM", "acme.com"), ("blog.acme.com", "acme.com"), ("https://www.acme.com/careers", "acme.com"), ("acme.co.uk", "acme.co.uk"), ("www.other-thing.co.uk", "other-thing.co.uk"),
    ("foo.github.io", None), ("my-project.vercel.app", None), ("my-app.herokuapp.com", None), ("x.notion.site", None), ("192.168.1.1", None), ("localhost", None), ("", None), ("name.unlistedtld", None), ("co.uk", None),
])
def test_normalize_domain(spark, url, want):
    assert one(spark, D.normalize_domain(F.col("u")), u=url) == want


@pytest.mark.parametrize("title,name,text", [
    ("Show HN: Loglane – a tiny logging library", "Loglane", "a tiny logging library"), ("Show HN: PixelCanvas - pixel art", "PixelCanvas", "pixel art"),
    ("Show HN: MyThing", "MyThing", None), ("Show HN: Foo Bar – Baz – Qux", "Foo Bar", "Baz – Qux"), ("self-hosted thing", "self-hosted thing", None),
])
def test_show_title(spark, title, name, text):
    got = one(spark, T.show_title(F.col("t")), t=title)
    assert (got.name, got.description) == (name, text)


def test_small_texts(spark):
    assert one(spark, D.safe_url(F.col("u")), u="javascript:alert(1)") is None
    assert one(spark, T.sector(F.col("t")), t="An AI developer tool") == "devtools"
    assert one(spark, T.sector(F.col("t")), t="nothing here") is None
    line = one(spark, T.one_liner(F.col("t")), t=" " + "word " * 60)
    assert line.endswith("word…") and len(line) <= 140
    assert one(spark, T.blocking_keys(F.col("n"), F.col("d")), n="ab", d=None) == []
    assert one(spark, T.blocking_keys(F.col("n"), F.col("d")), n="acme", d="acme.com") == ["domain:acme.com", "name4:acme", "trigram:acm", "trigram:cme"]


# (name, domain, people) of both sides, cosine of their texts where it matters, expected score without the vector term
PAIRS = [
    (("acme plumbing", "acmeplumbing.com", []), ("acme robotics", "acmerobotics.io", []), 0.8154, "none"),
    (("vercel", "vercel.com", []), ("verceld", "verceld.io", []), 0.9714, "none"),
    (("northwind labs", "northwind.dev", ["Sam Rivera"]), ("northwind labs", None, ["sam rivera "]), 1.0, "uncertain"),
    (("techflow", "techflow.io", []), ("techflow", "techflow.io", []), 1.0, "auto"),
    (("devtools", None, []), ("devtoolspro", None, []), 0.9455, "uncertain"),
]


def test_pair_scores(spark):
    side = "struct<name:string,domain:string,people:array<string>>"
    df = spark.createDataFrame([(a, b) for a, b, _, _ in PAIRS], f"a {side}, b {side}")
    rows = df.select(similarity.jaro_winkler("a.name", "b.name").alias("jw"), *resolve.pair_score("a", "b")).collect()
    for r, (a, b, jw, band) in zip(rows, PAIRS):
        assert round(r.jw, 4) == jw and r.confidence == band
    assert rows[2].matched_signals == ["name-similarity", "shared-person"] and rows[3].score == 1.0


def test_jaro_winkler_known_values():
    assert round(similarity.winkler("martha", "marhta"), 3) == 0.961
    assert round(similarity.winkler("abcd", "abxyzwvu"), 4) == 0.6667
    assert similarity.winkler("", "a") == 0.0


@given(st.text("abcdé", max_size=12), st.text("abcdé", max_size=12))
@settings(max_examples=200, deadline=None)
def test_jaro_winkler_is_symmetric_and_bounded(a, b):
    assert 0 <= similarity.winkler(a, b) <= 1
    assert math.isclose(similarity.jaro(a, b), similarity.jaro(b, a), abs_tol=0.15)
    assert similarity.winkler(a, a) == 1.0


def test_cosine_and_embeddings(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [1.0, 0.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [r.x for r in df.select(similarity.unit_interval(similarity.cosine(F.col("a"), F.col("b"))).alias("x")).collect()] == [1.0, 0.0, 0.5, 0.5, 0.5]
    assert embed.fnv1a("") == 0x811C9DC5 and embed.fnv1a("a") == 0xE40C292C
    v = embed.unit_vectors(np.array([1, 2], np.uint32))
    assert v.shape == (2, 384) and np.allclose((v * v).sum(1), 1) and abs(v[0] @ v[1]) < 0.3
