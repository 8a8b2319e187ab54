"""A whole run: ingest each source, resolve, enrich, score, persist, finish.

A source that fails leaves its cursor and does not stop the others. Companies
are a function of the stored records by batch resolution, so a run over the same
records gives the same companies. Tables are written version beside version
below ``root``; a run that fails after its start is recorded and raised again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import domain as D
from tessera.functions import embed
from tessera.functions.similarity import cosine, unit_interval
from tessera.operators import enrich, incremental, score
from tessera.plans.thesis import Thesis
from tessera.schemas import RECORD, RUN, SOURCES, WATERMARK, struct
from tessera.sources import stores
from tessera.store import table
from tessera.streaming.ingest import versions

#: gives a source's records after a cursor (null at first); a column ``mark``, else the signals' times, advances it
Reader = Callable[[str | None], DataFrame]


@dataclass
class Result:
    run_id: str
    status: str
    failed: list[str] = field(default_factory=list)


class Store:
    """Tables below a folder, each as numbered versions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def read(self, name: str, ddl: str) -> DataFrame:
        known = versions(self.spark, f"{self.root}/{name}")
        return self.spark.read.schema(ddl).parquet(f"{self.root}/{name}/v{known[-1]}") if known else self.spark.createDataFrame([], struct(ddl))

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        known = versions(self.spark, f"{self.root}/{name}")
        path = f"{self.root}/{name}/v{(known[-1] if known else 0) + 1}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)


def ingest(store: Store, readers: dict[str, Reader]) -> list[str]:
    """Upserts every source's new records; returns the sources that failed."""
    failed = []
    for source, reader in readers.items():
        marks = store.read("watermarks", WATERMARK)
        since = marks.where(F.col("source") == source).first()
        try:
            rows = reader(since["watermark"] if since else None)
            arrived = store.write(f"arrived-{source}", stores.latest(rows, ["source", "source_id"], [F.desc("fetched_at"), F.desc("raw")]))
        except Exception:  # one source's failure is part of the result, whatever its kind
            failed.append(source)
            continue
        store.write("records", stores.upsert(store.read("records", RECORD), arrived, ["source", "source_id"]).drop("is_new"))
        seen = arrived.select(F.col("mark").alias("at")) if "mark" in arrived.columns else arrived.select(F.explode("extracted.signals.observed_at").alias("at"))
        store.write("watermarks", stores.advance(marks, source, seen, "at", True))
    return failed


def companies(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(companies, members, signals) of records in arrival order."""
    nth = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source")).cast("string")
    flat = records.select(
        "id",
        "source",
        "fetched_at",
        F.concat(F.date_format("fetched_at", "yyyyMMddHHmmssSSSSSS"), F.lit("-"), nth).alias("position"),
        F.col("extracted.name").alias("name"),
        D.normalize_domain(F.col("extracted.domain")).alias("domain"),
        F.col("extracted.description").alias("description"),
        F.col("extracted.people").alias("people"),
        F.array_max("extracted.signals.observed_at").alias("signal_at"),
    )
    joined = table(incremental.resolve_together(flat), "companies-of-records")
    members = joined.select("company_id", F.col("record_id").alias("source_record_id"))
    seen = members.join(records.select(F.col("id").alias("source_record_id"), "fetched_at", "extracted.signals"), "source_record_id")
    spans = seen.groupBy("company_id").agg(F.min("fetched_at").alias("first_seen_at"), F.max("fetched_at").alias("last_seen_at"))
    signals = seen.select("company_id", F.inline("signals"))
    fields = ["canonical_name", "domain", "description", "people", "flags"]
    one = joined.groupBy("company_id").agg(F.first(F.struct(*fields)).alias("x")).select(F.col("company_id").alias("id"), "x.*")
    none = F.lit(None).cast("string")
    own = one.join(spans.withColumnRenamed("company_id", "id"), "id").withColumns({"sector": none, "one_liner": none, "estimated_stage": none, "merged_into": none})
    return own, members, signals


def semantic(rows: DataFrame, signals: DataFrame, thesis: Thesis, provider: embed.Provider = embed.DETERMINISTIC) -> DataFrame:
    """(company_id, semantic): the provider's embeddings of companies against the thesis's."""
    kinds = signals.groupBy("company_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    texts = rows.join(kinds.withColumnRenamed("company_id", "id"), "id", "left").select("id", embed.company_text(F.col("canonical_name"), F.col("description"), F.coalesce("kinds", F.array().cast("array<string>"))).alias("t"))
    vector = F.array(*[F.lit(float(x)) for x in provider.one(thesis.text)])
    return texts.select(F.col("id").alias("company_id"), unit_interval(cosine(provider.column(F.col("t")), vector)).alias("semantic"))


def run(spark: SparkSession, root: str, thesis: Thesis, readers: dict[str, Reader], now: Column, run_id: str | None = None, provider: embed.Provider = embed.DETERMINISTIC) -> Result:
    store, run_id = Store(spark, root), run_id or str(uuid.uuid4())
    start = spark.range(1).select(F.lit(run_id).alias("id"), F.lit(thesis.name).alias("thesis_name"), F.lit("running").alias("status"), now.cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("struct<failed_sources:array<string>>").alias("stats"))
    store.write("runs", store.read("runs", RUN).unionByName(start))

    def finish(status: str, failed: list[str]) -> Result:
        store.write("runs", stores.finish_run(store.read("runs", RUN), run_id, status, now.cast("timestamp"), failed))
        return Result(run_id, status, failed)

    try:
        failed = ingest(store, readers)
        found, members, signals = companies(store.read("records", RECORD))
        found = store.write("companies", enrich.enrich(found))
        store.write("members", members)
        signals = store.write("signals", signals)
        stores.replace_run(score.score_companies(found, signals, semantic(found, signals, thesis, provider), thesis, now, run_id), f"{root}/deals")
    except Exception:
        finish("failed", [])
        raise
    return finish(stores.run_status(failed, list(readers)), failed)
