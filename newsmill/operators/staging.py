"""Cutting lineage in loops by written tables in the shared folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes the shuffle files of a query when it has ended, or some time after.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.cache
def _own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="newsmill-")


def folder(spark: SparkSession) -> str:
    """A new path in the folder in ``spark.checkpoint.dir``. Where that is unset,
    in an own folder, in local mode only."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = _own_dir(spark.sparkContext.applicationId)
    return f"{top.rstrip('/')}/loop-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written to a new path of ``folder`` and read back."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, path: str, *by: str) -> DataFrame:
    """df written to a path, in a folder for each value of the columns ``by``, and
    read back; what was shuffled to make df leaves the disk when it is written."""
    spark = df.sparkSession
    had = spark.conf.get(_FREE)
    spark.conf.set(_FREE, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(_FREE, had)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete what a loop staged at a path and doesn't need any more."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)
