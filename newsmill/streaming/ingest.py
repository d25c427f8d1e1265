"""Structured Streaming: ingest, event windows and keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmill.operators import dedup
from newsmill.sources.items import EVENT_SCHEMA

LATE = "1 hour"


def ingest(stream: DataFrame, target: str, checkpoint: str, interval: str = "5 minutes", embed: Callable[[DataFrame], DataFrame] | None = None):
    """Append the new items of each micro batch to the Parquet table ``target``;
    ids and urls that it has already, or has earlier in the batch, are ignored.
    ``embed`` adds vectors to what is new."""

    def write(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        have = batch.select("id", "url").limit(0)
        if _there(batch.sparkSession, target):
            # of the table only what the batch can meet is kept for the joins
            own = batch.sparkSession.read.parquet(target).select("id", "url")
            have = own.join(batch.select("id"), "id", "left_semi").unionByName(own.join(batch.select("url"), "url", "left_semi"))
        new = dedup.save_items(batch, have.distinct())
        (embed(new) if embed else new).write.mode("append").parquet(target)
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=interval)


def _there(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def enrich(stream: DataFrame, target: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame], interval: str = "2 seconds"):
    """Append ``id, embedding`` of each micro batch's items that have text; rows
    that the embedder leaves null are left out and come again with a backfill."""

    def write(batch: DataFrame, _: int) -> None:
        made = embed(batch.where(F.coalesce("title", F.lit("")) != ""))
        made.where("embedding IS NOT NULL").select("id", "embedding").write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=interval)


def follow(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON-lines event logs as a stream, as its files come; blank and
    malformed lines are left out."""
    return spark.readStream.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED").json(path).where("kind IS NOT NULL")


def error_streaks(results: DataFrame) -> DataFrame:
    """Per source of a stream (source, ok) the errors since its last success; the
    number is kept as state."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, batches, state):
        import pandas as pd

        n = state.get[0] if state.exists else 0
        for b in batches:
            for ok in b["ok"]:
                n = 0 if ok else n + 1
        state.update((n,))
        yield pd.DataFrame({"source": [key[0]], "errors": [n]})

    return results.groupBy("source").applyInPandasWithState(update, "source string, errors bigint", "errors bigint", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events (t, kind) by window and kind; late ones are dropped after an hour."""
    return events.withWatermark("t", LATE).groupBy(F.window("t", size, slide) if slide else F.window("t", size), "kind").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("t", LATE).groupBy(F.session_window("t", gap), "qid").agg(F.count("*").alias("n"))


def poll_state(results: DataFrame) -> DataFrame:
    """Per source the seconds to its next poll, over a stream (source, fresh) of
    poll results; the interval is kept as state."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, batches, state):
        import pandas as pd

        now = state.get[0] if state.exists else 300.0
        for b in batches:
            for n in b["fresh"]:
                now = max(now * 0.7, 30.0) if n > 0 else min(now * 1.5, 900.0)
        state.update((now,))
        yield pd.DataFrame({"source": [key[0]], "interval": [now]})

    return results.groupBy("source").applyInPandasWithState(update, "source string, interval double", "interval double", "update", GroupStateTimeout.NoTimeout)
