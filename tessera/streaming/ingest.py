"""Incremental ingestion with Structured Streaming.

The checkpoint's offsets are the resume cursor of each source; records are
upserted by (source, source_id) in foreachBatch, so a repeated batch changes
nothing. A batch writes its own rows only, as a numbered change (d1, d2, ...) of the
record table; a reader merges the changes since the last whole version (v...). After
COMPACT changes the merged table is written as a whole version. A pointer file is
never needed, because only complete folders (with _SUCCESS) count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.schemas import RECORD, struct
from tessera.sources import stores


COMPACT = 32  # changes that a reader merges at most


def versions(spark: SparkSession, root: str, kind: str = "v") -> list[int]:
    """Numbers of the complete folders of one kind below a folder of any file system that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [n for n in names if n.startswith(kind) and n[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in done)


def _state(spark: SparkSession, root: str) -> tuple[int, list[int]]:
    """The last whole version (0: none) and the changes since."""
    whole = max(versions(spark, root), default=0)
    return whole, [n for n in versions(spark, root, "d") if n > whole]


def current(spark: SparkSession, root: str) -> DataFrame:
    """The record table: the last values of each key under the id it first had."""
    whole, changes = _state(spark, root)
    read = lambda name: spark.read.schema(RECORD).parquet(f"{root}/{name}")
    base = read(f"v{whole}") if whole else spark.createDataFrame([], struct(RECORD))
    if not changes:
        return base
    every = base.withColumn("_n", F.lit(whole))
    for n in changes:
        every = every.unionByName(read(f"d{n}").withColumn("_n", F.lit(n)))
    rest = [c for c in base.columns if c not in ("id", "source", "source_id")]
    merged = every.groupBy("source", "source_id").agg(F.min_by("id", "_n").alias("id"), F.max_by(F.struct(*rest), "_n").alias("x"))
    return merged.select("id", "source", "source_id", *[F.col(f"x.{c}").alias(c) for c in rest]).select(*base.columns)


def upsert_batch(root: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        whole, changes = _state(spark, root)
        last = max([whole, *changes])
        rows = stores.latest(batch, ["source", "source_id"], [F.desc("fetched_at"), F.desc("raw")])
        rows.write.mode("overwrite").parquet(f"{root}/d{last + 1}")
        if len(changes) + 1 >= COMPACT:
            current(spark, root).write.mode("overwrite").parquet(f"{root}/v{last + 1}")

    return write


def ingest(records: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Runs over what has arrived and stops."""
    return records.writeStream.foreachBatch(upsert_batch(root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Landed record files as a stream, so many a batch."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def activity(events: DataFrame, at: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by window; what comes later than the watermark is dropped. Batch or stream."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def fresh(items: DataFrame, at: str, since: Column) -> DataFrame:
    """Items after the cursor; an item at the cursor is old."""
    return items.where(F.col(at) > since)
