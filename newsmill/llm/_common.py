"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow rows per batch: whole texts travel in these, so batches stay small.
ARROW_ROWS = 1000
#: Bytes of text handled at once inside a Python worker.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds. Spark has this as a setting of the session
    only; a smaller bound that is set there stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


@functools.cache
def _own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="newsmill-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the cluster names in
    ``spark.checkpoint.dir``. Where that is unset, an own folder, in local mode
    only: elsewhere executors wouldn't share it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _own_dir(spark.sparkContext.applicationId)
    return found.rstrip("/")


#: Paths made inside each open ``scratch``, the innermost last.
_made: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/newsmill-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return f"{path}/{name}"


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What is staged inside goes when the block ends. A result that outlives it
    has to be staged at a path that was taken before."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts lineage: executors that are lost later cost no recomputation of df.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than 1 / HOT of the rows is hot, so fewer than HOT keys are.
HOT = 1000
#: Rows of a key that one task takes in any case.
FEW_ROWS = 20_000


def hot_keys(df: DataFrame, key: str) -> list:
    """The keys with more than 1 / HOT of the rows of ``df`` (and FEW_ROWS): fewer
    than HOT, however many rows there are."""
    total = df.count()
    if total <= FEW_ROWS:
        return []
    most = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > max(FEW_ROWS, total / HOT))
    return [bytes(r[0]) if isinstance(r[0], bytearray) else r[0] for r in most.collect() if r[0] is not None]


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """``left.join(right, key, how)`` (inner or left) where a key may have a large
    share of left's rows; right has one row of a key at most. The rows of right
    for hot keys (fewer than HOT rows) are broadcast, the others are shuffled."""
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    own = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return left.where(own).join(F.broadcast(right.where(F.col(key).isin(hot))), key, how).unionByName(left.where(~own).join(right.where(~own), key, how))


def text_column(df: DataFrame, column: str = "text"):
    """The text, with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``limit`` bytes of ``column`` each (or one
    longer text), with that column's bytes and their n+1 offsets."""
    for batch in batches:
        at = 0
        text = batch.column(batch.schema.get_field_index(column))
        if text.null_count:
            raise ValueError(f"{column} must not hold nulls here")
        large = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
        kind = np.int64 if large else np.int32
        buffers = text.buffers()
        offsets = np.frombuffer(buffers[1], kind, len(text) + 1 + text.offset)[text.offset :].astype(np.int64) if len(text) else np.zeros(1, np.int64)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
        while at < len(text):
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), len(text))
            own = offsets[at : to + 1]
            yield batch.slice(at, to - at), data[own[0] : own[-1]], own - own[0]
            at = to


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The runs of rows with equal keys, of batches that are sorted by them.

    One group is held at a time; callers bound the size of a group before."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*columns))
        at = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[at]:
                if held and rows[at] != key:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = rows[at]
                held.append(batch.slice(at, i - at))
                at = i
    if held:
        yield key, pa.Table.from_batches(held)
