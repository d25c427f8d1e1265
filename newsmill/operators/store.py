"""Reads and writes of a store of items, as functions of its tables.

A write takes tables and returns the table after it; the caller keeps it (as a
table, or in a ``foreachBatch``). Times are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsmill.operators.stories import error_streaks


def newest(items: DataFrame, limit: int = 100, unread: bool = False, hidden: Column | None = None, default: int = 100) -> DataFrame:
    """The newest items, unread ones or all, without hidden ones; a limit of 0 or
    less is the default."""
    kept = items.where(~F.col("read")) if unread else items
    kept = kept.where(~hidden) if hidden is not None else kept
    return kept.orderBy(F.desc("published"), "pos").limit(limit if limit > 0 else default)


def since(items: DataFrame, at: Column, hidden: Column | None = None) -> DataFrame:
    """Items published after ``at``, newest first."""
    kept = items.where(F.col("published") > at)
    return (kept.where(~hidden) if hidden is not None else kept).orderBy(F.desc("published"), "pos")


def without_vectors(items: DataFrame, vectors: DataFrame, limit: int, newest_first: bool = False, hidden: Column | None = None) -> DataFrame:
    """Items that still need a vector, those fetched first, or the newest, first."""
    left = items.join(vectors.where("embedding IS NOT NULL").select("id"), "id", "left_anti")
    left = left.where(~hidden) if hidden is not None else left
    return left.orderBy(*([F.desc("published")] if newest_first else [F.col("fetched")]), "pos").limit(limit)


def with_vectors(items: DataFrame, vectors: DataFrame, at: Column, limit: int = 500) -> DataFrame:
    """Items since ``at`` with their vector, newest first."""
    own = items.join(vectors.where("embedding IS NOT NULL"), "id").where(F.col("published") > at)
    return own.orderBy(F.desc("published"), "pos").limit(limit if limit > 0 else 500)


def save_vectors(vectors: DataFrame, new: DataFrame, items: DataFrame, strict: bool = False) -> DataFrame:
    """``id, embedding`` after ``new`` (id, embedding, at) is saved: the last write
    of an id wins. Ids that are no items are passed over, or with ``strict``
    nothing is written: an error."""
    unknown = new.join(items.select("id"), "id", "left_anti")
    if strict and not unknown.isEmpty():
        raise ValueError("vectors of unknown items; nothing was saved")
    last = new.join(items.select("id"), "id", "left_semi").groupBy("id").agg(F.max_by("embedding", "at").alias("embedding"))
    return vectors.select("id", "embedding").join(last.select("id"), "id", "left_anti").unionByName(last)


def clear_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """No vectors, and how many there were."""
    return vectors.limit(0), vectors.where("embedding IS NOT NULL").count()


def overlay(items: DataFrame, flags: DataFrame, column: str) -> DataFrame:
    """Items with ``column`` from ``flags`` (id, value) where it says one; ids
    that are no items change nothing."""
    own = flags.groupBy("id").agg(F.last("value").alias("_value"))
    return items.join(own, "id", "left").withColumn(column, F.coalesce("_value", column)).select(items.columns)


def upsert(items: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Items with ``columns`` from ``new`` where the id is known; new ids are added
    whole (columns that ``new`` has not are null)."""
    fresh = new.select("id", *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_there"))
    changed = items.join(fresh, "id", "left").withColumns({c: F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}).select(items.columns)
    return changed.unionByName(new.join(items.select("id"), "id", "left_anti"), allowMissingColumns=True).select(items.columns)


def add_new(have: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``have`` and the rows of ``new`` whose keys are not there (insert or
    ignore); of equal new ones any stays."""
    return have.unionByName(new.dropDuplicates(keys).join(have.select(keys), keys, "left_anti"))


def source_status(log: DataFrame) -> DataFrame:
    """Per source of (source, at, ok, n, err): fetches, the last one's time, its
    number of items and error, and the errors in a row up to now."""
    last = log.groupBy("source").agg(F.count("*").alias("fetches"), F.max("at").alias("last_fetch"), F.max_by("n", "at").alias("last_items"), F.max_by("err", "at").alias("last_error"))
    return last.join(error_streaks(log), "source").withColumnRenamed("errors", "error_count")


def source_health(status: DataFrame) -> DataFrame:
    """Sources in all; of those fetched: healthy, warning (1 or 2 errors in a
    row), failing."""
    e, there = F.col("error_count"), F.col("last_fetch").isNotNull()
    return status.agg(F.count("*").alias("total"), F.count_if(there & (e == 0)).alias("healthy"), F.count_if(there & e.between(1, 2)).alias("warning"), F.count_if(there & (e >= 3)).alias("failing"))


def due(status: DataFrame, now: Column, minutes: Column, backoff: bool = False) -> DataFrame:
    """Sources that were never fetched, or whose last fetch is ``minutes`` ago;
    with ``backoff`` the square of the errors in a row, 30 at most, is added."""
    wait = minutes + (F.least(F.col("error_count") * F.col("error_count"), F.lit(30)) if backoff else F.lit(0))
    return status.where(F.col("last_fetch").isNull() | ((F.unix_micros(now) - F.unix_micros("last_fetch")) / 60e6 >= wait))


def history(analyses: DataFrame, item_id: str) -> DataFrame:
    """All analyses of an item, the last first."""
    return analyses.where(F.col("item_id") == item_id).orderBy(F.desc("at"), F.desc("seq"))


def latest(analyses: DataFrame, with_content: bool = False) -> DataFrame:
    """The last analysis of each item, or the last that has content."""
    own = analyses.where(F.coalesce("content", F.lit("")) != "") if with_content else analyses
    return own.groupBy("item_id").agg(F.max(F.struct("at", "seq", "content")).alias("m")).select("item_id", "m.at", "m.seq", "m.content")


def end_session(sessions: DataFrame, session_id: str, at: Column) -> DataFrame:
    return sessions.withColumn("ended", F.when((F.col("session_id") == session_id) & F.col("ended").isNull(), at).otherwise(F.col("ended")))


def last_session(sessions: DataFrame) -> DataFrame:
    """The session that ended last; open ones are none."""
    return sessions.where("ended IS NOT NULL").orderBy(F.desc("ended"), "session_id").limit(1)


def save_top_stories(cache: DataFrame, new: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """The cache (item_id, title, hit, miss, first_seen, last_seen) without entries
    that were last seen ``hours`` ago, with ``new`` written over it; first_seen
    stays."""
    kept = cache.where(F.col("last_seen") >= now - F.expr(f"INTERVAL {hours} HOURS"))
    first = kept.select("item_id", F.col("first_seen").alias("_first"))
    fresh = new.join(first, "item_id", "left").withColumn("first_seen", F.coalesce("_first", "first_seen")).select(cache.columns)
    return kept.join(new.select("item_id"), "item_id", "left_anti").select(cache.columns).unionByName(fresh)


def load_top_stories(cache: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    return cache.where(F.col("last_seen") > now - F.expr(f"INTERVAL {hours} HOURS")).orderBy(F.desc("hit"), "item_id")


def queue_stats(items: DataFrame, polls: DataFrame) -> DataFrame:
    """Per source its items, poll interval, last poll and last number of new items
    of ``polls`` (source_name, interval, at, fresh); a row without source: all."""
    n = items.groupBy("source_name").agg(F.count("*").alias("n"))
    last = polls.groupBy("source_name").agg(F.max_by("interval", "at").alias("interval"), F.max("at").alias("last_poll"), F.max_by("fresh", "at").alias("last_new"))
    each = n.join(last, "source_name", "left").select("source_name", "n", "interval", "last_poll", "last_new")
    return each.unionByName(n.agg(F.sum("n").alias("n")), allowMissingColumns=True)


def job_stats(jobs: DataFrame) -> DataFrame:
    """Jobs in all and by state (pending, active, completed, failed)."""
    return jobs.agg(F.count("*").alias("created"), *(F.count_if(F.col("state") == s).alias(s) for s in ("pending", "active", "completed", "failed")))


def job_history(jobs: DataFrame, keep: int = 100, test: Column | None = None) -> DataFrame:
    """The last ``keep`` jobs that ended, newest first; of those the ones that fit."""
    last = jobs.where(F.col("state").isin("completed", "failed")).orderBy(F.desc("at"), F.desc("seq")).limit(keep)
    return last.where(test).orderBy(F.desc("at"), F.desc("seq")) if test is not None else last


def poll_intervals(polls: DataFrame, start: float = 120.0) -> DataFrame:
    """``source_name, interval``: the wait after all polls (source_name, at, fresh)
    in their order: shorter after new items, longer after none."""
    steps = polls.groupBy("source_name").agg(F.sort_array(F.collect_list(F.struct("at", "fresh"))).alias("l"))
    step = lambda a, x: F.when(x.fresh > 0, F.greatest(a * 0.7, F.lit(30.0))).otherwise(F.least(a * 1.5, F.lit(900.0)))
    return steps.select("source_name", F.aggregate("l", F.lit(start), step).alias("interval"))


def recent_activity(log: DataFrame, n: int = 50) -> DataFrame:
    return log.orderBy(F.desc("at"), F.desc("seq")).limit(min(n, 50) if n > 0 else 50)


def sparkline(rates: DataFrame, n: int) -> DataFrame:
    """``cluster, line``: the last n rates of (cluster, ts, rate1h), oldest first,
    as shares of the largest; all 0: zeros."""
    last = rates.withColumn("_n", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("ts"), F.desc("seq")))).where(F.col("_n") <= n)
    lists = last.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("k"), "rate1h"))), lambda x: x.rate1h).alias("l"))
    return lists.select("cluster", F.transform("l", lambda x: F.coalesce(F.try_divide(x, F.array_max("l")), F.lit(0.0))).alias("line"))
