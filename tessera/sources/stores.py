"""Keyed tables: upserts, members, merges, runs and watermarks as DataFrame plans.

Nothing is changed in place: each function returns the new state, to be written
beside the old one and swapped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], keep: tuple[str, ...] = ("id",), new: str = "is_new") -> DataFrame:
    """``stored`` with the incoming rows (one for each key): they win, but an existing row keeps its ``keep`` columns.

    ``new`` tells rows whose key was not stored.
    """
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    arrived = F.col("_in").isNotNull()
    joined = stored.withColumn("_st", F.lit(True)).alias("a").join(incoming.withColumn("_in", F.lit(True)).alias("b"), on, "full_outer")
    out = []
    for c in stored.columns:
        if c in keep or c in keys:
            out.append(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c))
        else:
            out.append(F.when(arrived, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
    return joined.select(*out, F.col("_st").isNull().alias(new))


def insert_ignore(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The set union; rows that are there already stay once."""
    return stored.unionByName(incoming).dropDuplicates()


def append(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The bag union: repeated signals stay repeated."""
    return stored.unionByName(incoming)


def replace_run(deals: DataFrame, path: str) -> None:
    """Writes a run's deals over what the run had, other runs untouched."""
    deals.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def set_column(rows: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with a column set where ``values`` (key, column) has the row."""
    other = values.select(F.col(key), F.col(column).alias("_v"), F.lit(True).alias("_set"))
    return rows.join(other, key, "left").withColumn(column, F.when(F.col("_set"), F.col("_v")).otherwise(F.col(column))).select(*rows.columns)


def merged(companies: DataFrame, merges: DataFrame, flag: str = "merge_incierto") -> DataFrame:
    """``companies`` after merges (absorbed, survivor, confidence): links set, uncertain survivors flagged, nothing deleted."""
    links = merges.select(F.col("absorbed").alias("id"), F.col("survivor").alias("_into"))
    unsure = merges.where(F.col("confidence") == "uncertain").select(F.col("survivor").alias("id")).distinct().withColumn("_unsure", F.lit(True))
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    rows = companies.join(links, "id", "left").join(unsure, "id", "left")
    rows = rows.withColumn("merged_into", F.coalesce("_into", "merged_into")).withColumn("flags", F.when(F.col("_unsure"), F.array_union(flags, F.array(F.lit(flag)))).otherwise(flags))
    return rows.select(*companies.columns)


def cluster_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of whole clusters: (company_id, source_record_id) moved to the root that (id, root) names."""
    moved = members.join(roots.withColumnRenamed("id", "company_id"), "company_id", "left")
    return moved.select(F.coalesce("root", "company_id").alias("company_id"), "source_record_id").distinct()


def assembled(companies: DataFrame, members: DataFrame, signals: DataFrame) -> DataFrame:
    """Companies with their member ids and signals as arrays."""
    own = members.groupBy("company_id").agg(F.array_sort(F.collect_set("source_record_id")).alias("member_record_ids"))
    seen = signals.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("observed_at", "kind", "value", "source"))).alias("signals"))
    base = companies.drop("member_record_ids", "signals")
    return base.join(own.withColumnRenamed("company_id", "id"), "id", "left").join(seen.withColumnRenamed("company_id", "id"), "id", "left")


def advanced(watermarks: DataFrame, seen: DataFrame) -> DataFrame:
    """Watermarks (source, watermark) after rows (source, value) were seen: the largest value, never smaller than before.

    Watermarks are texts; two that are numbers are compared as numbers.
    """
    top = seen.where("value is not null").groupBy("source").agg(F.max("value").cast("string").alias("_w"))
    joined = watermarks.join(top, "source", "full_outer")
    number = lambda c: F.col(c).try_cast("double")
    ahead = F.coalesce(number("_w") > number("watermark"), F.col("_w") > F.col("watermark"), F.lit(True))
    return joined.select("source", F.when(F.col("_w").isNotNull() & ahead, F.col("_w")).otherwise(F.col("watermark")).alias("watermark"))


def advance(watermarks: DataFrame, source: str, seen: DataFrame, column: str, succeeded: bool) -> DataFrame:
    """The watermarks after one source's run: advanced by the values it saw, unchanged after a failure."""
    return advanced(watermarks, seen.select(F.lit(source).alias("source"), F.col(column).alias("value"))) if succeeded else watermarks


def after(rows: DataFrame, watermarks: DataFrame, source: str, at: str) -> DataFrame:
    """``rows`` beyond the watermark of their source; all rows of a source without one."""
    marks = watermarks.select(F.col("source").alias(source), F.col("watermark").alias("_w"))
    mark = F.col("_w").cast(rows.schema[at].dataType)
    return rows.join(marks, source, "left").where(F.col("_w").isNull() | (F.col(at) > mark)).drop("_w")


def run_status(failed: list[str], sources: list[str]) -> str:
    return "completed" if not failed else "partial"


def finish_run(runs: DataFrame, run_id: str, status: str, at: Column, failed: list[str]) -> DataFrame:
    """``runs`` with one run finished; an unknown run is an error."""
    if runs.where(F.col("id") == run_id).limit(1).count() == 0:
        raise KeyError(f"no run {run_id}")
    own = F.col("id") == run_id
    stats = F.struct(F.array(*[F.lit(x) for x in failed]).cast("array<string>").alias("failed_sources"))
    return runs.withColumns({"status": F.when(own, status).otherwise(F.col("status")), "finished_at": F.when(own, at).otherwise(F.col("finished_at")), "stats": F.when(own, stats).otherwise(F.col("stats"))})


def latest_run(runs: DataFrame) -> DataFrame:
    """The last finished run that can be ranked."""
    return runs.where(F.coalesce("status", F.lit("running")).isin("completed", "partial")).orderBy(F.desc("finished_at"), "id").limit(1)


def page(records: DataFrame, after: object, limit: int) -> DataFrame:
    """Records by (fetched_at, id) after the one with the id ``after``; the first page if there is no such record."""
    cursor = records.where(F.col("id") == F.lit(after)).agg(F.max("fetched_at")).first()[0] if after is not None else None
    if cursor is not None:
        records = records.where((F.col("fetched_at") > F.lit(cursor)) | ((F.col("fetched_at") == F.lit(cursor)) & (F.col("id") > F.lit(after))))
    return records.orderBy("fetched_at", "id").limit(limit)
