"""The engine's operators as queries over the tables of a folder, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import domain as D
from tessera.functions import embed
from tessera.functions import text as T
from tessera.functions.similarity import cosine, unit_interval
from tessera.operators import enrich, graph, resolve, score
from tessera.plans import serve
from tessera.plans.thesis import Thesis
from tessera.sources import stores

NOW = "2024-06-01 00:00:00"
THESIS = Thesis(
    "Developer tools, early stage",
    "Tools for developers with organic traction",
    ("pre-seed", "seed", "series-a"),
    {"semantic": 0.4, "momentum": 0.3, "keywords": 0.2, "recency": 0.1},
    exclude_sectors=("BUILDING",),
    keywords=("the", "and", "000001"),
    anti_patterns=("#9",),
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def now(text: str = NOW):
    return F.lit(text).cast("timestamp_ntz")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as signals: users are companies, event types are kinds."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("company_id"), F.col("event_type").alias("kind"), "value", F.col("ts").alias("observed_at"), "event_id")


SIGNALS_SQL = "SELECT user_id AS company_id, event_type AS kind, value, ts AS observed_at, event_id FROM events"
LATEST_SQL = f"SELECT company_id, kind, max(observed_at) AS observed_at, max(value) FILTER (observed_at = top) AS value FROM (SELECT *, max(observed_at) OVER (PARTITION BY company_id, kind) AS top FROM ({SIGNALS_SQL})) GROUP BY company_id, kind"


def latest_per_kind(spark, sf_dir):
    return score.latest_signals(signals(spark, sf_dir))


def _momentum(spark, sf_dir):
    return score.raw_momentum(latest_per_kind(spark, sf_dir), kinds=None)


MOMENTUM_SQL = f"SELECT company_id, sum(ln(1 + greatest(0, value))) AS raw FROM ({LATEST_SQL}) GROUP BY company_id"
PERCENTILE_SQL = f"SELECT company_id, raw, (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 - 0.5) / count(*) OVER () AS momentum FROM (SELECT company_id, raw, round(raw, 9) AS v FROM ({MOMENTUM_SQL}))"


def momentum_percentile(spark, sf_dir):
    rows = score.percentile(_momentum(spark, sf_dir), "raw", "momentum")
    return rows.select("company_id", F.round("raw", 6).alias("raw"), F.round("momentum", 6).alias("momentum"))


def recency(spark, sf_dir):
    first = signals(spark, sf_dir).groupBy("company_id").agg(F.min("observed_at").alias("first_seen_at"))
    return first.select("company_id", F.round(score.age_days(F.col("first_seen_at"), now()), 6).alias("age_days"), F.round(score.recency(F.col("first_seen_at"), now()), 6).alias("recency"))


RECENCY_SQL = f"SELECT company_id, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(first_seen_at)) / 86400000000.0 AS age, first_seen_at FROM (SELECT company_id, min(observed_at) AS first_seen_at FROM ({SIGNALS_SQL}) GROUP BY company_id)"


def momentum_ranking(spark, sf_dir):
    """The flagship: momentum and recency of all companies, combined and ranked."""
    rows = score.percentile(_momentum(spark, sf_dir), "raw", "momentum")
    seen = signals(spark, sf_dir).groupBy("company_id").agg(F.min("observed_at").alias("first_seen_at"))
    both = rows.join(seen, "company_id").withColumn("recency", score.recency(F.col("first_seen_at"), now()))
    total = F.round(100 * (0.75 * F.col("momentum") + 0.25 * F.col("recency")), 6)
    return both.select("company_id", F.round("momentum", 6).alias("momentum"), F.round("recency", 6).alias("recency"), total.alias("score")).orderBy(F.desc("score"), "company_id")


def recent_counts(spark, sf_dir):
    stars = signals(spark, sf_dir).select(F.col("company_id").cast("string").alias("full_name"), F.col("observed_at").alias("starred_at"))
    from tessera.sources.mentions import star_delta

    return star_delta(stars, now("2024-01-31 00:00:00"))


def last_signal_kind(spark, sf_dir):
    return score.last_signal(signals(spark, sf_dir), "company_id", ["observed_at", "event_id"], "kind")


# --- names and domains -------------------------------------------------------------

TAILS = ["", ", Inc.", " S.A.", " Ltd Inc", " GmbH", " & Co. L.L.C."]


def _dressed(names: DataFrame, key: str, name: str) -> DataFrame:
    tail = F.element_at(F.array(*[F.lit(t) for t in TAILS]), (F.col(key) % len(TAILS) + 1).cast("int"))
    return names.select(F.col(key).alias("id"), F.concat(F.lit("Čafé "), F.col(name), tail).alias("name"))


def normalized_names(spark, sf_dir):
    rows = _dressed(read(spark, sf_dir, "part"), "p_partkey", "p_name")
    return rows.select("id", "name", T.normalize_name(F.col("name")).alias("normalized"))


_SUFFIX_RE = r"(?i)(?:[\s,]+(?:i\.?n\.?c|l\.?l\.?c|l\.?t\.?d|s\.?a|s\.?r\.?l|g\.?m\.?b\.?h)\.?\s*)+$"
_CASE = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TAILS)) + " END"
NAMES_SQL = f"SELECT p_partkey AS id, 'Čafé ' || p_name || {_CASE} AS name FROM part"
NORMALIZED_SQL = rf"SELECT id, name, trim(regexp_replace(regexp_replace(regexp_replace(trim(strip_accents(lower(name))), '{_SUFFIX_RE}', ''), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS normalized FROM ({NAMES_SQL})"


#: hosts that the pages' own are given in turn: plain, country, hosting, unlisted, address
HOSTS = ["example.com", "Shop.example.co.uk:8080", "team.github.io", "example.internal", "vercel.app", "10.0.0.1", "example.de", "user@www.example.org"]


def page_domains(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    other = F.element_at(F.array(*[F.lit(h) for h in HOSTS]), (F.col("page_id") % len(HOSTS) + 1).cast("int"))
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://"), other, F.lit("/x?y#z"))).otherwise(F.regexp_replace("url", r"example\.[a-z]+", other))
    pages = pages.withColumn("url", F.when(F.col("page_id") % 7 == 0, F.regexp_replace(url, "^https?", "ftp")).otherwise(url))
    host = D.host(F.col("url"))
    return pages.select("page_id", host.alias("host"), D.normalize_domain(F.col("url")).alias("domain"), D.generic(host).alias("generic"), D.safe_url(F.col("url")).isNotNull().alias("safe"), D.homepage_host(F.col("url")).alias("homepage"))


_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
DOMAINS_SQL = rf"""WITH u AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://' || other || '/x?y#z' ELSE regexp_replace(url, 'example\.[a-z]+', other) END AS url FROM (SELECT *, {_LIST(HOSTS)}[page_id % {len(HOSTS)} + 1] AS other FROM pages)),
v AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN regexp_replace(url, '^https?', 'ftp') ELSE url END AS url FROM u),
h AS (SELECT *, string_split(string_split_regex(split_part(lower(url), '://', 2), '[/?#]')[1], '@')[-1] AS a FROM v),
w AS (SELECT *, split_part(a, ':', 1) AS host FROM h),
l AS (SELECT *, string_split(regexp_replace(host, '^www\.', ''), '.') AS x FROM w),
z AS (SELECT *, CASE WHEN len(x) > 1 AND regexp_matches(x[-1], '^[a-z][a-z]$') AND list_contains({_LIST(D.SECOND_LEVELS)}, x[-2]) THEN 2 WHEN regexp_matches(x[-1], '^[a-z][a-z]$') OR list_contains({_LIST(D.GENERIC_NAMES)}, x[-1]) THEN 1 ELSE 0 END AS suffix,
  len(list_filter({_LIST(D.GENERIC_HOSTS)}, lambda g: host = g OR ends_with(host, '.' || g))) > 0 AS generic FROM l)
SELECT page_id, host, CASE WHEN NOT generic AND suffix > 0 AND len(x) > suffix THEN array_to_string(x[len(x) - suffix:], '.') END AS domain, generic, regexp_matches(lower(url), '^https?://') AS safe, CASE WHEN contains(host, '.') THEN host END AS homepage FROM z"""


def show_titles(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Show HN: "), "p_name", F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit(" – "), "p_type", F.lit(" - "), "p_brand")).otherwise("")).alias("title"))
    t = T.show_title(F.col("title"))
    return rows.select("p_partkey", t["name"].alias("name"), t["description"].alias("description"))


def text_enrichment(spark, sf_dir):
    """Sector guess, one-liner and policy over whole documents, some of which have a sector already."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("Company "), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 0, " ai tools").otherwise("")).alias("canonical_name"), F.col("text").alias("description"), F.when(F.col("doc_id") % 8 == 0, F.lit("data")).alias("sector"), F.lit(None).cast("string").alias("one_liner"))
    return enrich.enrich(docs).select(F.col("id").alias("doc_id"), "sector", "one_liner")


_PAD = "(' ' || lower('Company ' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 4 = 0 THEN ' ai tools' ELSE '' END || ' ' || coalesce(text, '')) || ' ')"
_GUESS = "CASE " + " ".join(f"WHEN contains({_PAD}, '{n}') THEN '{s}'" for n, s in T.SECTOR_NEEDLES) + " END"
ENRICH_SQL = rf"SELECT doc_id, coalesce(CASE WHEN doc_id % 8 = 0 THEN 'data' END, {_GUESS}) AS sector, CASE WHEN length(t) = 0 THEN NULL WHEN length(t) <= 140 THEN t ELSE regexp_replace(substr(t, 1, 139), '\s+$', '') || '…' END AS one_liner FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)"


# --- blocking, pairs, clusters -------------------------------------------------------


def _items(spark, sf_dir) -> DataFrame:
    """All distinct part names and brands as entities, with a domain for some and people for all."""
    names = read(spark, sf_dir, "part").groupBy("p_name", F.col("p_brand").alias("brand")).agg(F.min("p_partkey").alias("id"))
    low = T.normalize_name(F.col("p_name"))
    domain = F.when(F.length("p_name") % 3 > 0, F.concat(F.regexp_replace("brand", "[^A-Za-z0-9]", ""), F.lit(".example")))
    return names.select("id", low.alias("name"), F.lower(domain).alias("domain"), F.array(F.col("brand")).alias("people"), F.col("id").alias("first_seen_at"))


ITEMS_SQL = r"SELECT id, trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}\s]', ' ', 'g')) AS name, CASE WHEN length(p_name) % 3 > 0 THEN lower(regexp_replace(brand, '[^A-Za-z0-9]', '', 'g')) || '.example' END AS domain, brand FROM (SELECT p_name, min(p_partkey) AS id, p_brand AS brand FROM part GROUP BY p_name, p_brand)"
KEYS_SQL = f"SELECT DISTINCT id, key FROM (SELECT id, 'domain:' || domain AS key FROM ({ITEMS_SQL}) WHERE domain IS NOT NULL UNION ALL SELECT id, 'name4:' || name[1:4] FROM ({ITEMS_SQL}) WHERE length(name) >= 4 UNION ALL SELECT id, 'trigram:' || name[i:i + 2] FROM (SELECT id, name, unnest(range(1, length(name) - 1)) AS i FROM ({ITEMS_SQL})))"
PAIRS_SQL = f"SELECT DISTINCT a.id AS lo, b.id AS hi FROM ({KEYS_SQL}) a JOIN ({KEYS_SQL}) b USING (key) WHERE a.id < b.id"
SCORES_SQL = f"""SELECT lo, hi, round(top / weight, 6) AS score,
  CASE WHEN top / weight >= 0.82 AND both_ THEN 'auto' WHEN top / weight >= 0.55 THEN 'uncertain' ELSE 'none' END AS confidence,
  concat_ws(',', CASE WHEN both_ AND same = 1 THEN 'domain' END, CASE WHEN jw >= 0.85 THEN 'name-similarity' END, CASE WHEN person = 1 THEN 'shared-person' END) AS matched_signals
FROM (SELECT lo, hi, both_, same, jw, person, CASE WHEN both_ THEN 0.5 * same ELSE 0 END + 0.25 * jw + 0.1 * person AS top, CASE WHEN both_ THEN 0.5 ELSE 0 END + 0.25 + 0.1 AS weight
FROM (SELECT p.lo, p.hi, a.domain IS NOT NULL AND b.domain IS NOT NULL AS both_, CAST(a.domain = b.domain AS INT) AS same, CAST(a.brand = b.brand AS INT) AS person,
  j + 0.1 * pre * (1 - j) AS jw FROM (SELECT p.*, jaro_similarity(a.name, b.name) AS j,
    CASE WHEN a.name[1:4] = b.name[1:4] THEN least(4, length(a.name), length(b.name)) WHEN a.name[1:3] = b.name[1:3] THEN 3 WHEN a.name[1:2] = b.name[1:2] THEN 2 WHEN a.name[1:1] = b.name[1:1] THEN 1 ELSE 0 END AS pre
    FROM ({PAIRS_SQL}) p JOIN ({ITEMS_SQL}) a ON a.id = p.lo JOIN ({ITEMS_SQL}) b ON b.id = p.hi) p JOIN ({ITEMS_SQL}) a ON a.id = p.lo JOIN ({ITEMS_SQL}) b ON b.id = p.hi))"""


def blocking_keys(spark, sf_dir):
    return resolve.keyed(_items(spark, sf_dir), "id", F.col("name"), F.col("domain"))


def candidate_pairs(spark, sf_dir):
    return resolve.candidate_pairs(blocking_keys(spark, sf_dir))


def pair_scores(spark, sf_dir):
    scored = resolve.score_pairs(candidate_pairs(spark, sf_dir), _items(spark, sf_dir))
    return scored.select("lo", "hi", F.round("score", 6).alias("score"), "confidence", F.array_join("matched_signals", ",").alias("matched_signals"))


def best_candidates(spark, sf_dir):
    scored = resolve.score_pairs(candidate_pairs(spark, sf_dir), _items(spark, sf_dir)).withColumn("score", F.round("score", 6))
    return resolve.best_candidate(scored, "hi", "lo")


def resolved(spark, sf_dir):
    """Merges of all items; the SQL closure of so many edges is too slow, so a test compares with all pairs on a small table."""
    merges = resolve.resolve_batch(_items(spark, sf_dir))
    return merges.select("absorbed", "survivor", F.round("pair_score", 6).alias("pair_score"), "confidence")


def order_components(spark, sf_dir):
    """Components of all customers and the parts that they ordered; SQL cannot close the whole graph, so a test compares with union-find."""
    o, l = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    own = o.join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    return graph.components(own.select((-F.col("l_partkey")).alias("v"), F.col("o_custkey").alias("u")).distinct()).select("node", "label")


def merge_chains(spark, sf_dir):
    """Customers merged in chains of up to ten, followed to their roots."""
    c = read(spark, sf_dir, "customer")
    rows = c.where(F.col("c_custkey") % 10 > 0).select(F.col("c_custkey").alias("id"), (F.col("c_custkey") - 1).alias("merged_into"))
    return resolve.canonical(rows)


# --- vectors -------------------------------------------------------------------------


def semantic_fit(spark, sf_dir):
    """Every vector against one thesis vector, on [0, 1]."""
    rows = read(spark, sf_dir, "embeddings")
    thesis = [round(((i * 37) % 64) / 32 - 1, 6) for i in range(64)]
    return rows.select("vec_id", F.round(unit_interval(cosine(F.col("embedding"), F.array(*[F.lit(x) for x in thesis]))), 6).alias("semantic"))


_THESIS_VECTOR = "[" + ", ".join(f"CAST({round(((i * 37) % 64) / 32 - 1, 6)} AS DOUBLE)" for i in range(64)) + "]"


def text_hashes(spark, sf_dir):
    """FNV-1a of part names, and three components, the length and the norm of their deterministic vectors."""
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    v = embed.deterministic(F.col("p_name"))
    return rows.select("p_partkey", embed.fnv(F.col("p_name")).alias("hash"), *[F.round(v[i].cast("double"), 6).alias(n) for n, i in (("first", 0), ("middle", 191), ("last", 383))], F.size(v).alias("dimensions"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x), 4).alias("norm"))


_M = "4294967296"
HASHES_SQL = f"""WITH h AS (SELECT p_partkey, list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS HUGEINT))),
  lambda h, c: (xor(CAST(h AS BIGINT), CAST(c AS BIGINT))::HUGEINT * 16777619) % {_M})::BIGINT AS hash FROM part),
s AS (SELECT *, list_transform(range(1, 385), lambda i: CAST((hash + CAST(i AS HUGEINT) * 1831565813) % {_M} AS BIGINT)) AS s FROM h),
t AS (SELECT *, list_transform(s, lambda x: CAST((CAST(xor(x, x >> 15) AS HUGEINT) * (x | 1)) % {_M} AS BIGINT)) AS t FROM s),
u AS (SELECT *, list_transform(t, lambda x: xor(x, CAST((x + CAST(xor(x, x >> 7) AS HUGEINT) * (x | 61) % {_M}) % {_M} AS BIGINT))) AS u FROM t),
x AS (SELECT *, list_transform(u, lambda x: CAST(xor(x, x >> 14) AS DOUBLE) / {_M}.0::DOUBLE * 2 - 1) AS x FROM u),
n AS (SELECT *, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS n FROM x)
SELECT p_partkey, hash, round(CAST(CAST(x[1] / n AS FLOAT) AS DOUBLE), 6) AS first, round(CAST(CAST(x[192] / n AS FLOAT) AS DOUBLE), 6) AS middle, round(CAST(CAST(x[384] / n AS FLOAT) AS DOUBLE), 6) AS last, 384 AS dimensions, 1.0 AS norm FROM n"""


# --- scoring -------------------------------------------------------------------------


def _companies(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    stage = F.element_at(F.array(*[F.lit(s) for s in ("pre-seed", "seed", "series-a", "later", "unknown")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    first = F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(F.col("c_custkey").cast("int") % 400)
    flags = F.when(F.col("c_custkey") % 7 == 0, F.array(F.lit("merge_incierto"))).otherwise(F.array().cast("array<string>"))
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("canonical_name"), F.concat(F.lit("the "), F.lower("c_mktsegment")).alias("description"), F.col("c_mktsegment").alias("sector"),
        F.when(F.col("c_custkey") % 11 > 0, stage).alias("estimated_stage"), flags.alias("flags"), first.alias("first_seen_at"), F.lit(None).cast("string").alias("merged_into"),
    )


COMPANIES_SQL = f"""SELECT c_custkey AS id, c_name AS canonical_name, 'the ' || lower(c_mktsegment) AS description, c_mktsegment AS sector,
  CASE WHEN c_custkey % 11 > 0 THEN ['pre-seed', 'seed', 'series-a', 'later', 'unknown'][c_custkey % 5 + 1] END AS estimated_stage,
  CASE WHEN c_custkey % 7 = 0 THEN ['merge_incierto'] ELSE [] END AS flags, TIMESTAMP '{NOW}' - to_days(CAST(c_custkey % 400 AS INT)) AS first_seen_at FROM customer"""


def hard_filters(spark, sf_dir):
    rows = _companies(spark, sf_dir)
    return rows.select("id", score.hard_filter(F.col("estimated_stage"), F.col("sector"), THESIS).alias("reason"), F.round(score.keywords(F.col("canonical_name"), F.col("description"), THESIS), 6).alias("keywords"))


_LISTED = f"[{', '.join(THESIS.stages)}]"
FILTER_SQL = f"""CASE WHEN coalesce(estimated_stage, 'unknown') = 'unknown' THEN 'estimatedStage is unconfirmed (''unknown'') and thesis.hard_filters.stages {_LISTED} does not include ''unknown'''
  WHEN estimated_stage NOT IN ('pre-seed', 'seed', 'series-a') THEN 'stage ''' || estimated_stage || ''' is not in thesis.hard_filters.stages {_LISTED}'
  WHEN sector = 'BUILDING' THEN 'sector ''BUILDING'' is in thesis.hard_filters.exclude_sectors' END"""
_TEXT = "lower(canonical_name || ' ' || description)"
KEYWORDS_SQL = f"greatest(0, least(1, (CAST(contains({_TEXT}, 'the') AS INT) + CAST(contains({_TEXT}, 'and') AS INT) + CAST(contains({_TEXT}, '000001') AS INT)) / 3.0 - 0.5 * CAST(contains({_TEXT}, '#9') AS INT)))"


def _deals(spark, sf_dir) -> DataFrame:
    rows = _companies(spark, sf_dir)
    kinds = {"click": "launch", "view": "hn_show", "purchase": "hn_points"}
    named = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in kinds.items()], F.lit("hiring"))
    own = signals(spark, sf_dir).withColumn("kind", named)
    fit = rows.select(F.col("id").alias("company_id"), ((F.col("id") % 101) / 100.0).alias("semantic"))
    return score.score_companies(rows, own, fit, THESIS, now(), "run-1")


def scored_deals(spark, sf_dir):
    """The whole scoring: filters, components, percentile among survivors, weighted score, flags, rationale."""
    d = _deals(spark, sf_dir)
    parts = [F.round(F.col(f"breakdown.{k}.value"), 6).alias(k) for k in ("semantic", "momentum", "keywords", "recency")]
    return d.select("company_id", F.round("score", 6).alias("score"), *parts, F.array_join("flags", ",").alias("flags"), F.col("breakdown.failed_hard_filter").alias("failed"), "rationale")


SCORED_SQL = f"""WITH c AS ({COMPANIES_SQL}), f AS (SELECT *, {FILTER_SQL} AS failed, {KEYWORDS_SQL} AS kw FROM c),
sig AS (SELECT user_id AS id, CASE event_type WHEN 'click' THEN 'launch' WHEN 'view' THEN 'hn_show' WHEN 'purchase' THEN 'hn_points' ELSE 'hiring' END AS kind, value, ts FROM events),
top AS (SELECT *, max(ts) OVER (PARTITION BY id, kind) AS m FROM sig),
raw AS (SELECT id, sum(ln(1 + greatest(0, v))) AS raw FROM (SELECT id, kind, max(value) AS v FROM top WHERE ts = m GROUP BY id, kind) GROUP BY id),
p AS (SELECT f.*, round(coalesce(raw, 0), 9) AS r FROM f LEFT JOIN raw USING (id) WHERE failed IS NULL),
s AS (SELECT id, (id % 101) / 100.0 AS semantic, (rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0 - 0.5) / count(*) OVER () AS momentum, kw AS keywords,
  greatest(0, least(1, exp(-ln(2) * (epoch_us(TIMESTAMP '{NOW}') - epoch_us(first_seen_at)) / 86400000000.0 / 30))) AS recency FROM p),
w AS (SELECT f.*, s.* EXCLUDE (id), coalesce(0.4 * semantic, 0) AS c1, coalesce(0.3 * momentum, 0) AS c2, coalesce(0.2 * s.keywords, 0) AS c3, coalesce(0.1 * s.recency, 0) AS c4 FROM f LEFT JOIN s USING (id)),
o AS (SELECT *, list_sort([{{'c': -c1, 'i': 0, 'l': 'semantic fit with the thesis'}}, {{'c': -c2, 'i': 1, 'l': 'recent momentum'}}, {{'c': -c3, 'i': 2, 'l': 'keyword alignment'}}, {{'c': -c4, 'i': 3, 'l': 'how recently the company was first seen'}}]) AS q,
  concat_ws(', ', CASE WHEN sector <> '' THEN 'sector ' || sector END, CASE WHEN estimated_stage <> 'unknown' THEN 'stage ' || estimated_stage END) AS known,
  CASE WHEN list_contains(flags, 'merge_incierto') THEN 'merged from multiple source records with only moderate confidence (''merge_incierto'')' END AS merged_ FROM w),
x AS (SELECT *, concat_ws('; ', CASE WHEN known <> '' THEN 'known context — ' || known END, merged_) AS extras FROM o)
SELECT id AS company_id, CASE WHEN failed IS NULL THEN round(100 * (c1 + c2 + c3 + c4), 6) ELSE 0 END AS score, round(coalesce(semantic, 0), 6) AS semantic, round(coalesce(momentum, 0), 6) AS momentum,
  round(coalesce(keywords, 0), 6) AS keywords, round(coalesce(recency, 0), 6) AS recency,
  array_to_string(CASE WHEN coalesce(estimated_stage, 'unknown') = 'unknown' THEN list_append(flags, 'etapa incierta') ELSE flags END, ',') AS flags, failed,
  CASE WHEN failed IS NULL THEN canonical_name || ' scores ' || CAST(CAST(floor(100 * (c1 + c2 + c3 + c4) + 0.5) AS BIGINT) AS VARCHAR) || '/100 against the "{THESIS.name}" thesis, ' ||
    CASE WHEN q[1].c >= 0 THEN 'no single component stood out — every component contributed only modestly' ELSE 'driven mostly by ' || q[1].l || CASE WHEN q[2].c < 0 AND q[2].c <= 0.75 * q[1].c THEN ' and ' || q[2].l ELSE '' END END || '.' ||
    ' Component contributions (points out of 100): semantic ' || CAST(CAST(floor(100 * c1 + 0.5) AS BIGINT) AS VARCHAR) || ', momentum ' || CAST(CAST(floor(100 * c2 + 0.5) AS BIGINT) AS VARCHAR) || ', keywords ' || CAST(CAST(floor(100 * c3 + 0.5) AS BIGINT) AS VARCHAR) || ', recency ' || CAST(CAST(floor(100 * c4 + 0.5) AS BIGINT) AS VARCHAR) || '.'
    ELSE canonical_name || ' scored 0 against the "{THESIS.name}" thesis: ' || failed || '. This is a hard-filter disqualification, so no weighted component score applies.' END || CASE WHEN extras <> '' THEN ' ' || upper(extras[1:1]) || extras[2:] || '.' ELSE '' END AS rationale
FROM x"""


# --- serving -------------------------------------------------------------------------


def _stored_deals(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = read(spark, sf_dir, "orders")
    deals = o.groupBy(F.col("o_custkey").alias("company_id")).agg(F.round(F.sum("o_totalprice") / 100000, 0).alias("score")).withColumn("run_id", F.lit("run-1"))
    companies = _companies(spark, sf_dir).withColumn("domain", F.lit(None).cast("string")).withColumn("one_liner", F.col("description"))
    return deals, companies


def deal_list(spark, sf_dir):
    """One keyset page of ranked deals, and the row that tells whether there are more."""
    deals, companies = _stored_deals(spark, sf_dir)
    return serve.list_deals(deals, companies, "run-1", serve.DealQuery(min_score=5.0, stage="seed", limit=20, cursor=(20.0, 300))).select("company_id", "score", "canonical_name", "sector", "estimated_stage")


DEALS_SQL = "SELECT o_custkey AS company_id, round(sum(o_totalprice) / 100000, 0) AS score FROM orders GROUP BY o_custkey"
DEAL_LIST_SQL = f"SELECT company_id, score, canonical_name, sector, estimated_stage FROM ({DEALS_SQL}) d JOIN ({COMPANIES_SQL}) c ON d.company_id = c.id WHERE score >= 5 AND estimated_stage = 'seed' AND (score < 20 OR (score = 20 AND company_id > 300)) ORDER BY score DESC, company_id LIMIT 21"


def ranked_lines(spark, sf_dir):
    deals, companies = _stored_deals(spark, sf_dir)
    rows = deals.withColumns({"rationale": F.lit(""), "flags": F.when(F.col("company_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))})
    return serve.ranked_text(rows, companies).select("rank", "line")


RANKED_SQL = f"SELECT CAST(row_number() OVER (ORDER BY score DESC, company_id) AS INT) AS rank, CAST(row_number() OVER (ORDER BY score DESC, company_id) AS VARCHAR) || '. ' || c_name || ' — score ' || printf('%.1f', score) || CASE WHEN company_id % 2 = 0 THEN ' [a, b]' ELSE '' END AS line FROM ({DEALS_SQL}) JOIN customer ON company_id = c_custkey"


def field_conflicts(spark, sf_dir):
    """The winning language of each label's documents' sources: precedence, then time, then id."""
    d = read(spark, sf_dir, "documents")
    src = F.element_at(F.array(F.lit("hackernews"), F.lit("rss"), F.lit("github"), F.lit("other")), (F.col("doc_id") % 4 + 1).cast("int"))
    obs = d.select((F.col("doc_id") % 97).alias("company_id"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("value"), src.alias("source"), F.timestamp_seconds(F.col("n_chars") + 1_700_000_000).alias("observed_at"))
    return resolve.resolve_field(obs, ["company_id"]).select("company_id", "value", "source", "id")


CONFLICTS_SQL = """SELECT company_id, value, source, id FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY CASE source WHEN 'github' THEN 0 WHEN 'rss' THEN 1 WHEN 'hackernews' THEN 2 ELSE 3 END, n_chars DESC, id) AS n
FROM (SELECT doc_id % 97 AS company_id, doc_id AS id, lang AS value, ['hackernews', 'rss', 'github', 'other'][doc_id % 4 + 1] AS source, n_chars FROM documents WHERE doc_id % 5 > 0)) WHERE n = 1"""


def _records(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    src = F.element_at(F.array(F.lit("hackernews"), F.lit("rss"), F.lit("github")), (F.col("doc_id") % 3 + 1).cast("int"))
    return d.select(F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 50).cast("string").alias("company_id"), src.alias("source"), F.timestamp_seconds(F.col("n_chars") + 1_700_000_000).alias("fetched_at"), F.col("source").alias("name"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("domain"), F.lit(None).cast("string").alias("description"))


def provenance(spark, sf_dir):
    companies = spark.range(60).select(F.col("id").cast("string").alias("id"), F.lit("own name").alias("canonical_name"), F.lit("own.example").alias("domain"), F.lit("own text").alias("description"), F.lit("ai").alias("sector"), F.lit(None).cast("string").alias("estimated_stage"))
    return resolve.provenance(companies, _records(spark, sf_dir))


PROVENANCE_SQL = """WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS id, CAST(doc_id % 50 AS VARCHAR) AS company_id, ['hackernews', 'rss', 'github'][doc_id % 3 + 1] AS source, n_chars, source AS name, CASE WHEN doc_id % 2 = 0 THEN lang END AS domain FROM documents),
o AS (SELECT company_id, id, source, n_chars, 'canonicalName' AS field, name AS value FROM r UNION ALL SELECT company_id, id, source, n_chars, 'domain', domain FROM r WHERE domain IS NOT NULL),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, field ORDER BY CASE source WHEN 'github' THEN 0 WHEN 'rss' THEN 1 ELSE 2 END, n_chars DESC, id) AS n FROM o) WHERE n = 1),
c AS (SELECT CAST(i AS VARCHAR) AS company_id, f.field, f.value, f.method FROM range(60) t(i), (VALUES ('canonicalName', 'own name', 'reconstructed'), ('domain', 'own.example', 'reconstructed'), ('description', 'own text', 'reconstructed'), ('sector', 'ai', 'enrichment-not-attributable'), ('estimatedStage', NULL, 'enrichment-not-attributable')) f(field, value, method))
SELECT company_id, field, coalesce(w.value, c.value) AS value, method, source, id AS source_record_id FROM c LEFT JOIN w USING (company_id, field)"""


# --- stores and increments -------------------------------------------------------------


def record_upsert(spark, sf_dir):
    """Events stored up to a time, then all later ones and some old ones again: ids stay, values change."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    old = e.where("event_id % 3 > 0").select(F.concat(F.lit("old-"), F.col("event_id").cast("string")).alias("id"), "event_type", "event_id", "value")
    new = e.where("event_id % 3 < 2").select(F.concat(F.lit("new-"), F.col("event_id").cast("string")).alias("id"), "event_type", "event_id", (F.col("value") + 1).alias("value"))
    return stores.upsert(old, new, ["event_type", "event_id"])


def member_union(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    pair = lambda d: d.select(F.col("l_suppkey").alias("company_id"), F.col("l_partkey").alias("source_record_id"))
    return stores.insert_ignore(pair(l.where("l_linenumber <= 3")), pair(l.where("l_linenumber >= 2")))


def incremental_read(spark, sf_dir):
    """Two runs over the events of each type: the first sees what came before a time, the second what its cursor leaves."""
    e = read(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    seen = lambda rows: rows.select(F.col("event_type").alias("source"), F.col("ts").alias("value"))
    none = spark.createDataFrame([], "source string, watermark string")
    marks = stores.advanced(none, seen(e.where(F.col("event_id") % 10 < 7)))
    late = stores.after(e, marks, "event_type", "ts")
    fresh = late.groupBy("event_type").agg(F.count("*").alias("fresh"))
    now_ = stores.advanced(marks, seen(late)).select(F.col("source").alias("event_type"), F.col("watermark").cast("timestamp_ntz").alias("watermark"))
    return now_.join(fresh, "event_type", "left").select("event_type", F.coalesce("fresh", F.lit(0)).alias("fresh"), "watermark")


INCREMENTAL_SQL = "WITH m AS (SELECT event_type, max(ts) FILTER (event_id % 10 < 7) AS watermark FROM events GROUP BY event_type) SELECT e.event_type, count(*) FILTER (ts > watermark) AS fresh, greatest(any_value(watermark), max(ts) FILTER (ts > watermark)) AS watermark FROM events e JOIN m USING (event_type) GROUP BY e.event_type"


def record_page(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("fetched_at"))
    return stores.page(o, 100, 50)


def latest_run(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "partial")
    return stores.latest_run(o.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("finished_at")))


def label_quality(spark, sf_dir):
    """Precision and recall of a rule (repeated symbols mean low quality) against the labels."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    said, true = F.col("text").rlike(r"\*\*\*|!!"), F.col("quality") == 0
    return resolve.confusion(d, said, true)


def company_assembly(spark, sf_dir):
    """Customers with their orders and the dates of them as arrays."""
    o = read(spark, sf_dir, "orders")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("canonical_name"))
    members = o.select(F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("source_record_id"))
    sig = o.select(F.col("o_custkey").alias("company_id"), F.col("o_orderstatus").alias("kind"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("observed_at"), F.lit("orders").alias("source"))
    rows = stores.assembled(c, members, sig)
    return rows.select("id", "canonical_name", F.array_join(F.transform("member_record_ids", lambda x: x.cast("string")), ",").alias("members"), F.array_join(F.transform("signals", lambda s: s["kind"]), "").alias("kinds"))


ASSEMBLY_SQL = "SELECT c_custkey AS id, c_name AS canonical_name, string_agg(DISTINCT CAST(o_orderkey AS VARCHAR), ',' ORDER BY lpad(CAST(o_orderkey AS VARCHAR), 20, '0')) AS members, string_agg(o_orderstatus, '' ORDER BY o_orderdate, o_orderstatus) AS kinds FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name"


def hourly_activity(spark, sf_dir):
    from tessera.streaming.ingest import activity

    return activity(read(spark, sf_dir, "events"), "ts", "event_type")


QUERIES = {
    f.__name__: f
    for f in (
        momentum_ranking, latest_per_kind, momentum_percentile, recency, recent_counts, last_signal_kind, normalized_names, page_domains, show_titles, text_enrichment,
        blocking_keys, candidate_pairs, pair_scores, best_candidates, resolved, order_components, merge_chains, semantic_fit, text_hashes, hard_filters, scored_deals,
        deal_list, ranked_lines, field_conflicts, provenance, record_upsert, member_union, incremental_read, record_page, latest_run, label_quality, company_assembly, hourly_activity,
    )
}

ORACLE = {
    "latest_per_kind": LATEST_SQL,
    "momentum_percentile": f"SELECT company_id, round(raw, 6) AS raw, round(momentum, 6) AS momentum FROM ({PERCENTILE_SQL})",
    "recency": f"SELECT company_id, round(age, 6) AS age_days, round(greatest(0, least(1, exp(-ln(2) * age / 30))), 6) AS recency FROM ({RECENCY_SQL})",
    "momentum_ranking": f"SELECT company_id, round(momentum, 6) AS momentum, round(r, 6) AS recency, round(100 * (0.75 * momentum + 0.25 * r), 6) AS score FROM ({PERCENTILE_SQL}) JOIN (SELECT company_id, greatest(0, least(1, exp(-ln(2) * age / 30))) AS r FROM ({RECENCY_SQL})) USING (company_id)",
    "recent_counts": "SELECT CAST(user_id AS VARCHAR) AS full_name, count(*) FILTER (ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAYS) AS delta FROM events GROUP BY user_id",
    "last_signal_kind": "SELECT user_id AS company_id, arg_max(event_type, {'t': ts, 'i': event_id}) AS kind FROM events GROUP BY user_id",
    "normalized_names": NORMALIZED_SQL,
    "page_domains": DOMAINS_SQL,
    "show_titles": "SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 3 > 0 THEN p_type || ' - ' || p_brand END AS description FROM part",
    "text_enrichment": ENRICH_SQL,
    "blocking_keys": KEYS_SQL,
    "candidate_pairs": PAIRS_SQL,
    "pair_scores": SCORES_SQL,
    "best_candidates": f"SELECT hi, lo, score, confidence FROM (SELECT *, row_number() OVER (PARTITION BY hi ORDER BY score DESC, lo) AS n FROM ({SCORES_SQL}) WHERE confidence <> 'none') WHERE n = 1",
    "merge_chains": "WITH RECURSIVE r(id, root) AS (SELECT c_custkey, c_custkey - 1 FROM customer WHERE c_custkey % 10 > 0 UNION ALL SELECT id, root - 1 FROM r WHERE root % 10 > 0) SELECT id, min(root) AS root FROM r GROUP BY id",
    "semantic_fit": f"SELECT vec_id, round((list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_THESIS_VECTOR}) + 1) / 2, 6) AS semantic FROM embeddings",
    "text_hashes": HASHES_SQL,
    "hard_filters": f"SELECT id, {FILTER_SQL} AS reason, round({KEYWORDS_SQL}, 6) AS keywords FROM ({COMPANIES_SQL})",
    "scored_deals": SCORED_SQL,
    "deal_list": DEAL_LIST_SQL,
    "ranked_lines": RANKED_SQL,
    "field_conflicts": CONFLICTS_SQL,
    "provenance": PROVENANCE_SQL,
    "record_upsert": "SELECT coalesce(a.id, b.id) AS id, event_type, event_id, coalesce(b.value, a.value) AS value, a.id IS NULL AS is_new FROM (SELECT 'old-' || event_id AS id, event_type, event_id, value FROM events WHERE event_id % 3 > 0) a FULL JOIN (SELECT 'new-' || event_id AS id, event_type, event_id, value + 1 AS value FROM events WHERE event_id % 3 < 2) b USING (event_type, event_id)",
    "member_union": "SELECT DISTINCT l_suppkey AS company_id, l_partkey AS source_record_id FROM lineitem",
    "incremental_read": INCREMENTAL_SQL,
    "record_page": "SELECT o_orderkey AS id, o_orderdate AS fetched_at FROM orders, (SELECT max(o_orderdate) AS mark FROM orders WHERE o_orderkey = 100) WHERE mark IS NULL OR o_orderdate > mark OR (o_orderdate = mark AND o_orderkey > 100) ORDER BY 2, 1 LIMIT 50",
    "latest_run": "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'partial' END AS status, o_orderdate AS finished_at FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_orderdate DESC, o_orderkey LIMIT 1",
    "label_quality": r"SELECT *, coalesce(round(tp / nullif(tp + fp, 0), 6), 1) AS precision, coalesce(round(tp / nullif(tp + fn, 0), 6), 1) AS recall FROM (SELECT count(*) FILTER (s AND t) AS tp, count(*) FILTER (s AND NOT t) AS fp, count(*) FILTER (NOT s AND t) AS fn, count(*) FILTER (NOT s AND NOT t) AS tn FROM (SELECT regexp_matches(text, '\*\*\*|!!') AS s, quality = 0 AS t FROM documents JOIN labels USING (doc_id)))",
    "company_assembly": ASSEMBLY_SQL,
    "hourly_activity": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
