"""Mentions of companies from landed payloads: repository search, launch posts, feeds.

Payload files are read with explicit schemas, in batch or as a stream. Each
reader gives rows of ``schemas.RECORD`` and a column ``mark``, the value that advances
the source's watermark: creation times of repositories and posts, publication times of
feed items. Ids come from a hash of source and source id, so a repeated read gives the
same rows. A limit keeps the first rows of a stated order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import domain as D
from tessera.functions import text as T
from tessera.schemas import SIGNAL
from tessera.store import table

REPO = "id long, name string, html_url string, description string, homepage string, created_at string, stargazers_count long, owner struct<login string>, fork boolean, archived boolean"
POST = "objectID string, created_at_i long, title string, url string, points long, author string"
STARS = "full_name string, starred_at timestamp"
ITEM = "title string, link string, guid string, pubDate string, description string"
ENTRY = "title string, link struct<_href string, _rel string>, id string, published string, updated string, summary string"

# Fixed values of the sources.
ITEM_PAGE = "https://news.ycombinator.com/item?id="
MIN_STARS, DELTA_DAYS, RESULT_CAP = 10, 30, 1000


def _struct(ddl: str) -> str:
    return "struct<" + ", ".join(f"{f.split(' ', 1)[0]}:{f.split(' ', 1)[1]}" for f in ddl.split(", ")) + ">"


REPO_PAGE = f"total_count long, incomplete_results boolean, items array<{_struct(REPO)}>"
POST_PAGE = f"hits array<{_struct(POST)}>, page int, nbPages int"


def filled(c: str | Column) -> Column:
    """The trimmed text, null if empty."""
    return F.nullif(F.trim(c), F.lit(""))


def signal(kind: str, value: Column, at: Column, source: str, url: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.cast("double").alias("value"), at.alias("observed_at"), F.lit(source).alias("source"), url.alias("evidence_url"))


def record(rows: DataFrame, source: str, source_id: Column, fetched_at: Column, mark: Column, **fields: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    own = {"name": none, "domain": none, "description": none, "url": none, "people": F.lit(None).cast("array<string>"), "location": none} | fields
    signals = F.filter(own.pop("signals"), lambda s: s.isNotNull()).cast(f"array<{SIGNAL}>").alias("signals")
    raw = F.to_json(F.struct(*rows.columns))
    key = F.sha2(F.concat_ws("\0", F.lit(source), source_id), 256)
    return rows.select(
        key.alias("id"), F.lit(source).alias("source"), source_id.alias("source_id"), fetched_at.alias("fetched_at"), raw.alias("raw"),
        F.struct(*[v.alias(k) for k, v in own.items()], signals).alias("extracted"), mark.cast("string").alias("mark"),
    )


# --- repository search -----------------------------------------------------------


def star_delta(stars: DataFrame, now: Column, days: int = DELTA_DAYS) -> DataFrame:
    """(full_name, delta): stars of the last days among those listed; only repositories with a listing have a row."""
    return stars.groupBy("full_name").agg(F.count_if(F.col("starred_at") >= now - F.expr(f"INTERVAL {days} DAYS")).alias("delta"))


def repos(items: DataFrame, fetched_at: Column, deltas: DataFrame | None = None) -> DataFrame:
    """Records of search items (REPO); an item without stars has a delta of 0, one without an owner or listing none."""
    rows = items
    if deltas is not None:
        named = deltas.select(F.col("full_name").alias("_f"), F.col("delta").alias("_d"))
        rows = rows.join(named, F.concat(F.col("owner.login"), F.lit("/"), F.col("name")) == F.col("_f"), "left").drop("_f")
    else:
        rows = rows.withColumn("_d", F.lit(None).cast("long"))
    delta = F.when(F.col("stargazers_count") <= 0, F.lit(0)).when(filled("owner.login").isNotNull(), F.col("_d"))
    owner = filled("owner.login")
    url = F.col("html_url")
    return record(
        rows, "github", F.col("id").cast("string"), fetched_at, F.col("created_at"),
        name=F.col("name"), domain=D.homepage_host(F.col("homepage")), description=F.nullif("description", F.lit("")), url=url,
        people=F.when(owner.isNotNull(), F.array(owner)),
        signals=F.array(signal("github_stars", F.col("stargazers_count"), fetched_at, "github", url), F.when(delta.isNotNull(), signal("github_stars_delta_30d", delta, fetched_at, "github", url))),
    )


def search_terms(since: str | None = None) -> str:
    """The search of live connectors: enough stars, no forks, no archives, created after the watermark."""
    return " ".join([f"stars:>={MIN_STARS}", "fork:false", "archived:false", *([f"created:>{since}"] if since else [])])


def read_repos(spark: SparkSession, path: str, fetched_at: Column, since: str | None = None, limit: int | None = None, deltas: DataFrame | None = None, searched: bool = True) -> DataFrame:
    """Items of landed search pages, most stars first; a malformed page fails the read.

    Pages of a search hold what :func:`search_terms` asks for; of others (``searched`` false) the same is chosen here.
    """
    items = spark.read.schema(REPO_PAGE).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline("items"))
    if not searched:
        unwanted = F.coalesce("fork", F.lit(False)) | F.coalesce("archived", F.lit(False))
        items = items.where((F.col("stargazers_count") >= MIN_STARS) & ~unwanted)
    if since:
        items = items.where(F.col("created_at") > since)
    if limit:
        items = items.orderBy(F.desc("stargazers_count"), "id").limit(min(limit, RESULT_CAP))
    return repos(items, fetched_at, deltas)


# --- launch posts ----------------------------------------------------------------


def posts(hits: DataFrame, fetched_at: Column) -> DataFrame:
    """Records of launch posts (POST). They never have a domain, whatever their URL."""
    title = T.show_title(F.col("title"))
    page = F.concat(F.lit(ITEM_PAGE), F.col("objectID"))
    return record(
        hits, "hackernews", F.col("objectID"), fetched_at, F.col("created_at_i"),
        name=title["name"], description=title["description"], url=F.nullif("url", F.lit("")),
        people=F.when(filled("author").isNotNull(), F.array("author")),
        signals=F.array(signal("hn_points", F.coalesce("points", F.lit(0)), fetched_at, "hackernews", page), signal("hn_show", F.lit(1), fetched_at, "hackernews", page)),
    )


def read_posts(spark: SparkSession, path: str, fetched_at: Column, since: int | None = None, limit: int | None = None) -> DataFrame:
    hits = spark.read.schema(POST_PAGE).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline("hits"))
    if since is not None:
        hits = hits.where(F.col("created_at_i") > since)
    if limit:
        hits = hits.orderBy(F.desc("created_at_i"), "objectID").limit(limit)
    return posts(hits, fetched_at)


# --- feeds -----------------------------------------------------------------------


def feed_time(iso: Column, rfc: Column) -> Column:
    """An ISO time, else an RFC 822 one, else null."""
    bare = F.regexp_replace(F.trim(rfc), r"^[A-Za-z]+,\s*", "")
    return F.coalesce(F.try_to_timestamp(iso), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")))


def stable_id(guid: Column, own: Column, link: Column, title: Column) -> Column:
    """The item's guid or id, else a hash of its link or title."""
    return F.coalesce(filled(guid), filled(own), F.sha2(F.coalesce(filled(link), filled(title), F.lit("")), 256))


def feed_items(items: DataFrame, fetched_at: Column, since: Column | None = None) -> DataFrame:
    """Records of feed items (title, link, guid, id, iso, rfc, snippet, summary); untitled and undated ones are left out."""
    rows = items.withColumn("_at", feed_time(F.col("iso"), F.col("rfc"))).where(filled("title").isNotNull() & F.col("_at").isNotNull())
    if since is not None:
        rows = rows.where(F.col("_at") > since)
    link = D.safe_url(filled("link"))
    return record(
        rows, "rss", stable_id(F.col("guid"), F.col("id"), F.col("link"), F.col("title")), fetched_at, F.col("_at"),
        name=filled("title"), description=F.coalesce(filled("snippet"), filled("summary")), url=link,
        signals=F.array(signal("launch", F.lit(1), F.col("_at"), "rss", link)),
    )


def read_feed(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Items of RSS 2.0 and Atom files in one shape."""
    read = lambda tag, ddl: spark.read.format("xml").option("rowTag", tag).option("mode", mode).schema(ddl).load(path)
    none = F.lit(None).cast("string")
    rss = read("item", ITEM).select("title", "link", "guid", none.alias("id"), none.alias("iso"), F.col("pubDate").alias("rfc"), F.col("description").alias("snippet"), none.alias("summary"))
    atom = read("entry", ENTRY).select("title", F.col("link._href").alias("link"), none.alias("guid"), "id", F.coalesce("published", "updated").alias("iso"), none.alias("rfc"), none.alias("snippet"), "summary")
    return rss.unionByName(atom)


def read_feeds(spark: SparkSession, feeds: list[str], fetched_at: Column, since: str | None = None, limit: int | None = None, failed: Callable[[str, Exception], None] = lambda feed, error: None) -> DataFrame:
    """Records of many feeds (paths), in their order; one that cannot be read is reported and left out, the others stay.

    The limit holds over all feeds: the first feeds' items, the latest of each first.
    """
    after = F.lit(since).cast("timestamp") if since else None
    out = []
    for n, feed in enumerate(feeds):
        try:
            rows = feed_items(read_feed(spark, feed, "FAILFAST"), fetched_at, after).withColumn("_feed", F.lit(n))
            out.append(table(rows, "feed"))  # read now, so that its failure is its own
        except Exception as error:  # whatever is wrong with one feed concerns that feed alone
            failed(feed, error)
    if not out:
        return feed_items(spark.createDataFrame([], "title string, link string, guid string, id string, iso string, rfc string, snippet string, summary string"), fetched_at)
    rows = together(out)
    if limit:
        rows = rows.orderBy("_feed", F.desc("mark"), "source_id").limit(limit)
    return rows.drop("_feed")


def together(parts: list[DataFrame]) -> DataFrame:
    """All sources' records, in the order given."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
