"""Scores of companies against a thesis: hard filters, four components, rationale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.similarity import clamp
from tessera.plans.thesis import COMPONENTS, Thesis

# Fixed values of the scoring and its texts.
MOMENTUM_KINDS = ["github_stars_delta_30d", "hn_points", "hn_show", "launch", "hiring"]
HALF_LIFE_DAYS = 30
ANTI_PENALTY = 0.5
SECOND_SHARE = 0.75
STAGE_FLAG = "etapa incierta"
LABELS = {
    "semantic": "semantic fit with the thesis",
    "momentum": "recent momentum",
    "keywords": "keyword alignment",
    "recency": "how recently the company was first seen",
}

RANGES = 64  # of distinct values, for ranks


def hard_filter(stage: Column, sector: Column, thesis: Thesis) -> Column:
    """Why a company fails the thesis's hard filters; null if it passes. The stage is checked first."""
    own = F.coalesce(stage, F.lit("unknown"))
    listed = f"[{', '.join(thesis.stages)}]"
    unknown = f"estimatedStage is unconfirmed ('unknown') and thesis.hard_filters.stages {listed} does not include 'unknown'"
    other = F.concat(F.lit("stage '"), own, F.lit(f"' is not in thesis.hard_filters.stages {listed}"))
    excluded = F.concat(F.lit("sector '"), sector, F.lit("' is in thesis.hard_filters.exclude_sectors"))
    bad_sector = (sector != "") & sector.isin(list(thesis.exclude_sectors)) if thesis.exclude_sectors else F.lit(False)
    return F.when(~own.isin(list(thesis.stages)), F.when(own == "unknown", unknown).otherwise(other)).when(bad_sector, excluded)


def latest_signals(signals: DataFrame, by: str = "company_id") -> DataFrame:
    """The latest value of each kind; of equal times the larger value."""
    return signals.groupBy(by, "kind").agg(F.max(F.struct("observed_at", "value")).alias("m")).select(by, "kind", F.col("m.observed_at").alias("observed_at"), F.col("m.value").alias("value"))


def last_signal(signals: DataFrame, by: str, order: list[str], column: str) -> DataFrame:
    """(by, column): a column of the latest signal of each company, as its source or kind; ``order`` tells which is last."""
    return signals.groupBy(by).agg(F.max_by(column, F.struct(*order)).alias(column))


def raw_momentum(latest: DataFrame, by: str = "company_id", kinds: tuple[str, ...] | None = tuple(MOMENTUM_KINDS)) -> DataFrame:
    """Sum over the kinds (None: all) of log1p of the latest value, negative values as 0."""
    own = latest if kinds is None else latest.where(F.col("kind").isin(list(kinds)))
    return own.groupBy(by).agg(F.sum(F.log1p(F.greatest(F.lit(0.0), F.col("value")))).alias("raw"))


def percentile(rows: DataFrame, value: str, into: str, digits: int = 9) -> DataFrame:
    """``rows`` with (average rank - 0.5) / n of a value; ties share a rank.

    Ranks come from the counts of the distinct values (rounded to ``digits``).
    Approximate quantiles deal these into RANGES ranges; a window inside each
    range and the ranges' totals give exact ranks, so no task sorts all values.
    """
    keyed = rows.withColumn("_v", F.round(value, digits))
    counts = keyed.groupBy("_v").agg(F.count("*").alias("_n"))
    bounds = counts.agg(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 10_000).alias("_q"))
    dealt = counts.crossJoin(F.broadcast(bounds))  # one row of bounds
    dealt = dealt.select("_v", "_n", F.size(F.filter("_q", lambda q: q < F.col("_v"))).alias("_r"))
    totals = dealt.groupBy("_r").agg(F.sum("_n").alias("_t"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most RANGES rows
    starts = totals.select("_r", (F.sum("_t").over(before) - F.col("_t")).alias("_s"), F.sum("_t").over(Window.partitionBy()).alias("_all"))
    upto = Window.partitionBy("_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = dealt.withColumn("_u", F.sum("_n").over(upto)).join(F.broadcast(starts), "_r")
    ranks = inside.select("_v", ((F.col("_s") + F.col("_u") - F.col("_n") + (F.col("_n") + 1) / 2 - 0.5) / F.col("_all")).alias(into))
    return keyed.join(ranks, "_v", "left").drop("_v")


def keywords(name: Column, description: Column, thesis: Thesis) -> Column:
    """Share of the keywords that the text has (1 without any), less ANTI_PENALTY for each anti-pattern."""
    text = F.concat_ws(" ", name, F.coalesce(description, F.lit("")))
    share = T.contains_all(text, thesis.keywords) / len(thesis.keywords) if thesis.keywords else F.lit(1.0)
    return clamp(share - ANTI_PENALTY * T.contains_all(text, thesis.anti_patterns))


def age_days(then: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(86_400_000_000.0)


def recency(first_seen: Column, now: Column) -> Column:
    """1 for what is seen now (or later), half of it each HALF_LIFE_DAYS."""
    import math

    return clamp(F.exp(-math.log(2) * age_days(first_seen, now) / HALF_LIFE_DAYS))


def weighted(values: dict[str, Column], weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for key in COMPONENTS:
        total = total + F.lit(weights[key]) * values[key]
    return 100 * total


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("long")


def rationale(name: Column, sector: Column, stage: Column, flags: Column, failed: Column, values: dict[str, Column], thesis: Thesis) -> Column:
    """A sentence or three that can be audited from the components alone."""
    parts = F.array(*[F.struct((-F.lit(thesis.weights[k]) * values[k]).alias("c"), F.lit(i).alias("i"), F.lit(LABELS[k]).alias("label")) for i, k in enumerate(COMPONENTS)])
    ordered = F.array_sort(parts)
    one, two = ordered[0], ordered[1]
    named = F.when(one["c"] >= 0, F.lit("no single component stood out — every component contributed only modestly")).otherwise(
        F.concat(F.lit("driven mostly by "), one["label"], F.when((two["c"] < 0) & (two["c"] <= one["c"] * SECOND_SHARE), F.concat(F.lit(" and "), two["label"])).otherwise(""))
    )
    points = F.concat_ws(", ", *[F.concat(F.lit(f"{k} "), half_up(100 * F.lit(thesis.weights[k]) * values[k]).cast("string")) for k in COMPONENTS])
    scores = F.concat(name, F.lit(" scores "), half_up(weighted(values, thesis.weights)).cast("string"), F.lit(f'/100 against the "{thesis.name}" thesis, '), named, F.lit("."))
    fails = F.concat(name, F.lit(f' scored 0 against the "{thesis.name}" thesis: '), failed, F.lit("."))
    known = F.concat_ws(
        ", ",
        F.when(sector != "", F.concat(F.lit("sector "), sector)),
        F.when((stage != "") & (stage != "unknown"), F.concat(F.lit("stage "), stage)),
    )
    merged = F.when(F.array_contains(flags, "merge_incierto"), F.lit("merged from multiple source records with only moderate confidence ('merge_incierto')"))
    clauses = F.concat_ws("; ", F.when(known != "", F.concat(F.lit("known context — "), known)), merged)
    extras = F.when(clauses != "", F.concat(F.upper(F.substring(clauses, 1, 1)), F.substring(clauses, F.lit(2), F.length(clauses)), F.lit(".")))
    passing = F.concat_ws(" ", scores, F.concat(F.lit("Component contributions (points out of 100): "), points, F.lit(".")), extras)
    failing = F.concat_ws(" ", fails, F.lit("This is a hard-filter disqualification, so no weighted component score applies."), extras)
    return F.when(failed.isNull(), passing).otherwise(failing)


def score_companies(companies: DataFrame, signals: DataFrame, semantic: DataFrame, thesis: Thesis, now: Column, run_id: str) -> DataFrame:
    """Deals of all canonical companies.

    signals: (company_id, kind, value, observed_at); semantic: (company_id,
    semantic). Percentiles are taken among the companies that pass the filters;
    the others stay with score 0, zero weights and the reason.
    """
    live = companies.where(F.col("merged_into").isNull())
    judged = live.withColumn("failed", hard_filter(F.col("estimated_stage"), F.col("sector"), thesis))
    unsure = F.coalesce(F.col("estimated_stage"), F.lit("unknown")) == "unknown"
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    judged = judged.withColumn("flags", F.when(unsure, F.array_distinct(F.concat(flags, F.array(F.lit(STAGE_FLAG))))).otherwise(flags))
    passed = judged.where("failed is null")
    moved = raw_momentum(latest_signals(signals)).withColumnRenamed("company_id", "id")
    passed = passed.join(moved, "id", "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    passed = percentile(passed, "raw", "momentum").join(semantic.withColumnRenamed("company_id", "id"), "id", "left")
    passed = passed.withColumns({"semantic": F.coalesce("semantic", F.lit(0.0)), "keywords": keywords(F.col("canonical_name"), F.col("description"), thesis), "recency": recency(F.col("first_seen_at"), now)})
    values = {k: F.col(k) for k in COMPONENTS}
    zero = {k: F.lit(0.0) for k in COMPONENTS}

    def deals(rows: DataFrame, own: dict[str, Column], weights: dict[str, float], failed: Column) -> DataFrame:
        parts = [F.struct(own[k].cast("double").alias("value"), F.lit(weights[k]).alias("weight")).alias(k) for k in COMPONENTS]
        told = rationale(F.col("canonical_name"), F.col("sector"), F.col("estimated_stage"), F.col("flags"), failed, own, thesis)
        return rows.select(F.lit(run_id).alias("run_id"), F.col("id").alias("company_id"), weighted(own, weights).alias("score"), F.struct(*parts, failed.alias("failed_hard_filter")).alias("breakdown"), told.alias("rationale"), "flags")

    none = F.lit(None).cast("string")
    return deals(passed, values, thesis.weights, none).unionByName(deals(judged.where("failed is not null"), zero, dict.fromkeys(COMPONENTS, 0.0), F.col("failed")))
