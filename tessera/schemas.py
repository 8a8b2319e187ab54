"""Explicit schemas of the data model; reads never infer types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SIGNAL = "struct<kind string, value double, observed_at timestamp, source string, evidence_url string>"
EXTRACTED = f"struct<name string, domain string, description string, url string, people array<string>, location string, signals array<{SIGNAL}>>"
RECORD = f"id string, source string, source_id string, fetched_at timestamp, raw string, extracted {EXTRACTED}"
COMPANY = (
    "id string, canonical_name string, domain string, description string, one_liner string, sector string, estimated_stage string, "
    f"people array<string>, flags array<string>, signals array<{SIGNAL}>, embedding array<float>, member_record_ids array<string>, "
    "first_seen_at timestamp, last_seen_at timestamp, merged_into string"
)
MEMBERS = "company_id string, source_record_id string"
RUN = "id string, thesis_name string, status string, started_at timestamp, finished_at timestamp, stats struct<failed_sources array<string>>"
WATERMARK = "source string, watermark string"
COMPONENT = "struct<value double, weight double>"
BREAKDOWN = f"struct<semantic {COMPONENT}, momentum {COMPONENT}, keywords {COMPONENT}, recency {COMPONENT}, failed_hard_filter string>"
DEAL = f"run_id string, company_id string, score double, breakdown {BREAKDOWN}, rationale string, flags array<string>"

# Fixed values of the data model.
SOURCES = ["github", "hackernews", "rss"]
STAGES = ["pre-seed", "seed", "series-a", "later", "unknown"]
SIGNAL_KINDS = ["github_stars", "github_stars_delta_30d", "hn_points", "hn_show", "launch", "hiring"]
RUN_STATUSES = ["running", "completed", "partial", "failed"]


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def duplicate_domains(companies: DataFrame) -> DataFrame:
    """Domains that more than one canonical company has; empty in a sound store."""
    live = companies.where(F.col("merged_into").isNull() & F.col("domain").isNotNull())
    return live.groupBy("domain").agg(F.count("*").alias("companies")).where("companies > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Child rows whose key has no parent row."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
