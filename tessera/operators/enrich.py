"""Keyword enrichment and its policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# The confidence of a rule's guess, and from where a guess may overwrite.
GUESS_CONFIDENCE, TRUSTED = 0.3, 0.5


def guess(name: Column, description: Column) -> Column:
    """(sector, one_liner, confidence) from the name and the description."""
    found = T.sector(F.concat_ws(" ", name, F.coalesce(description, F.lit(""))))
    line = F.when(description != "", T.one_liner(description))
    return F.struct(found.alias("sector"), line.alias("one_liner"), F.when(found.isNotNull(), GUESS_CONFIDENCE).otherwise(0.0).alias("confidence"))


def apply_policy(old: Column, new: Column, confidence: Column) -> Column:
    """A trusted value overwrites, another only fills a gap."""
    old, new = F.nullif(old, F.lit("")), F.nullif(new, F.lit(""))
    return F.when(confidence >= TRUSTED, F.coalesce(new, old)).otherwise(F.coalesce(old, new))


def enrich(companies: DataFrame) -> DataFrame:
    rows = companies.withColumn("_g", guess(F.col("canonical_name"), F.col("description")))
    for field in ("sector", "one_liner"):
        rows = rows.withColumn(field, apply_policy(F.col(field), F.col(f"_g.{field}"), F.col("_g.confidence")))
    return rows.drop("_g")
