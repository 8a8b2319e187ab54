"""Lineage cuts that survive the loss of an executor.

Intermediate tables go to the folder that all machines share, named by
``spark.checkpoint.dir``. Only where that setting is missing (tests, a laptop)
is a temporary folder made, and then only for a local master.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; set to a temporary one on a local master that has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from reliable checkpoint files."""
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    out.stored_at = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
    return out


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Unlike a checkpoint it is columnar and compressed, so later passes read
    only the columns they name.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def own_folder(spark: SparkSession) -> str:
    """This application's folder of tables; nothing in it is needed once the application has ended."""
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spent(*tables: DataFrame) -> None:
    """Deletes the files of tables made by :func:`table` or :func:`cut` that no later plan reads."""
    for one in tables:
        _delete(one.sparkSession, one.stored_at)


def clear(spark: SparkSession) -> None:
    """Deletes all tables of this application; results that still read them must have been written."""
    _delete(spark, own_folder(spark))


def children(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the files and folders in a folder of any file system that Spark knows, by name; none if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(str(x.getPath()) for x in fs.listStatus(at)) if fs.exists(at) else []
