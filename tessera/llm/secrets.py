"""Secret scans with corpus-wide ownership frequency.

Patterns propose candidates in each text. The hash of each candidate's value is
counted over the whole corpus by distinct repositories and distinct owners: a
value with many owners, or in many repositories even of one owner, is a widely
copied example; one of at most ``most_owners`` owners and ``most_repos``
repositories looks live. Live values add a span of kind ``live``;
opaque tokens (long mixed strings that no base pattern names) are reported only
when they look live. Base spans are always reported.

Only narrow rows (ids, places, hashes) are shuffled, and texts only where they
hold a candidate. One pattern tells which texts may, so that the others are read
over once.

Defined results: null and empty texts have no spans; null owners or
repositories count as one of their own; rows that repeat both id and text share
one result; an empty table gives an empty result; other columns are carried
unless they have the name of an added one.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from tessera.llm.blocks import map_blocks
from tessera.llm.spans import find, joined, let
from tessera.store import table

# Fixed forms: assign, access and hex are
#   (password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+), AKIA[A-Z0-9]+, [0-9a-f]+
# with group 2 of 6, and 20 and 24 characters at least. Hex and opaque runs start only where a run starts.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "opaque": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32,}+",
}
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "opaque", "live"]
LEAST_ASSIGNED = 6
MOST_OWNERS, MOST_REPOS = 2, 20
#: stands in every text that has a candidate
HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}|AKIA[A-Z0-9]{16}|(?<![0-9a-f])[0-9a-f]{24}|(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32}"""
MASK = "[SECRET]"


def kind_candidates(text: Column, kind: str) -> Column:
    """Candidates of one kind: places of the match, start of its value, hash of its value."""

    def value(s: Column) -> Column:
        return F.regexp_extract(s["hit"], ASSIGN, 1) if kind == "assign" else s["hit"]

    def keep(s: Column) -> Column:
        if kind == "assign":
            return F.length(value(s)) >= LEAST_ASSIGNED
        if kind == "opaque":
            return s["hit"].rlike("[0-9]") & s["hit"].rlike("[a-z]") & s["hit"].rlike("[A-Z]")
        return F.lit(True)

    return F.transform(
        F.filter(find(text, kind, PATTERNS[kind]), keep),
        lambda s: F.struct(s["kind"], s["start"], s["end"], (s["end"] - F.length(value(s))).alias("at"), F.sha2(value(s), 256).alias("h")),
    )


def hinted(text: Column) -> Column:
    """Whether HINT stands in the text; it is looked for only where a plain search finds what each of its forms needs."""
    some = let(F.lower(text), lambda low: reduce(lambda a, b: a | b, [low.contains(w) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")]))
    return F.coalesce((some | text.contains("AKIA") | text.rlike("[A-Za-z0-9_-]{24}")) & text.rlike(HINT), F.lit(False))


def candidates(text: Column) -> Column:
    none = F.array().cast("array<struct<kind:string,start:int,end:int,at:int,h:string>>")
    return F.when(hinted(text), F.concat(*[kind_candidates(text, kind) for kind in PATTERNS])).otherwise(none)


def ownership(found: DataFrame, owner: str, repo: str) -> DataFrame:
    """Distinct owners and repositories of each candidate hash; null is one of its own."""
    one = found.select(F.explode("_found.h").alias("h"), F.coalesce(F.col(owner).cast("string"), F.lit("\0")).alias("o"), F.coalesce(F.col(repo).cast("string"), F.lit("\0")).alias("r"))
    return one.groupBy("h").agg(F.count_distinct("o").alias("owners"), F.count_distinct("r").alias("repos"))


def judged(docs: DataFrame, doc_id: str, text: str, owner: str, repo: str, most_owners: int, most_repos: int) -> tuple[DataFrame, DataFrame]:
    """Narrow rows of all documents with their candidates, and the judged candidates by id and text hash."""
    found = table(
        docs.select(F.col(doc_id).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_t"), F.col(owner).alias("_owner"), F.col(repo).alias("_repo"), candidates(F.col(text)).alias("_found")),
        "candidates",
    )
    some = found.where(F.size("_found") > 0)
    freq = table(ownership(some, "_owner", "_repo"), "ownership")
    each = some.select("_id", "_t", F.explode("_found").alias("c")).select("_id", "_t", F.col("c.h").alias("h"), "c").join(freq, "h")
    row = F.struct("c.kind", "c.start", "c.end", "c.at", "owners", "repos", ((F.col("owners") <= most_owners) & (F.col("repos") <= most_repos)).alias("live"))
    grouped = each.groupBy("_id", "_t").agg(F.collect_set(row).alias("secrets"))
    return found, grouped.select(F.col("_id").alias("_sid"), F.col("_t").alias("_st"), "secrets")


def all_spans(secrets: Column) -> Column:
    """Base spans, and what the ownership adds: live values and live opaque tokens."""
    base = F.filter(secrets, lambda s: s["kind"].isin(BASE) | s["live"])
    live = F.array_distinct(F.transform(F.filter(secrets, lambda s: s["live"]), lambda s: F.struct(F.lit("live").alias("kind"), s["at"].alias("start"), s["end"].alias("end"))))
    return F.concat(F.transform(base, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), live)


def mask(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """``docs`` with base and live spans replaced by MASK; texts without a candidate are not shuffled."""
    has = hinted(F.col(text))
    some = table(docs.where(has), "hinted")
    _, secrets = judged(some, doc_id, text, owner, repo, most_owners, most_repos)
    secrets = secrets.select("_sid", "_st", all_spans(F.col("secrets")).alias("_spans"))
    dirty = some.withColumn("_t", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    dirty = dirty.join(secrets, F.col(doc_id).eqNullSafe(F.col("_sid")) & (F.col("_t") == F.col("_st")), "left").drop("_sid", "_st", "_t")

    def work(block: pa.RecordBatch) -> dict:
        texts = block.column(text).to_pylist()
        for i, own in enumerate(block.column("_spans").to_pylist()):
            out, at = [], 0
            for s, e in sorted((x["start"], x["end"]) for x in own or []):
                if s >= at:
                    out += [texts[i][at:s], MASK]
                at = max(at, e)
            texts[i] = "".join(out) + texts[i][at:]
        return {text: pa.array(texts, pa.string())}

    masked = map_blocks(dirty, text, work, [StructField(text, StringType())], drop=("_spans",)).select(*docs.columns)
    return docs.where(~has).unionByName(masked)


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """Counts and places by document."""
    found, secrets = judged(docs, doc_id, text, owner, repo, MOST_OWNERS, MOST_REPOS)
    both = found.join(secrets, F.col("_id").eqNullSafe(F.col("_sid")) & (F.col("_t") == F.col("_st")), "left").select(
        F.col("_id").alias("doc_id"), F.filter("_found", lambda s: s["kind"].isin(BASE)).alias("base"), F.coalesce(all_spans(F.col("secrets")), F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("every")
    )
    return both.select(
        "doc_id",
        *[count(F.col("base"), kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
        joined(F.col("every"), KINDS).alias("spans"),
    )


def count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
