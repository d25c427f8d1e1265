"""Balancing and sampling items across sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def limit_per_source(items: DataFrame, n: int) -> DataFrame:
    """The newest n items of each source, newest first; n of 0 or less: none."""
    if n <= 0:
        return items.limit(0)
    own = W.partitionBy("source_name").orderBy(F.desc("published"), "pos")
    kept = items.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= n).drop("_n")
    return kept.orderBy(F.desc("published"), "pos")


def first_per_group(items: DataFrame, group: Column, n: Column | int, order: list) -> DataFrame:
    ranked = items.withColumn("_g", group)
    ranked = ranked.withColumn("_n", F.row_number().over(W.partitionBy("_g").orderBy(*order)))
    return ranked.where(F.col("_n") <= n).drop("_g", "_n")


def interleave(items: DataFrame, cap: int) -> DataFrame:
    """Round robin over sources in the order they are first seen: ``round``, from
    1, and ``turn``, the first position of the source; their order is the result's."""
    own = W.partitionBy("source_name")
    return items.withColumns({"round": F.row_number().over(own.orderBy("pos")), "turn": F.min("pos").over(own)}).where(F.col("round") <= cap)


def round_robin(items: DataFrame, n: int, cap: int | None = None) -> DataFrame:
    """n items, one of each source by turns; sources by name."""
    ranked = items.withColumn("round", F.row_number().over(W.partitionBy("source_name").orderBy("pos")))
    if cap:
        ranked = ranked.where(F.col("round") <= cap)
    return ranked.orderBy("round", "source_name").limit(n)


def fair_recent(items: DataFrame, as_of: Column, n: int, quota: int = 20, hours: int = 24) -> DataFrame:
    recent = items.where(F.col("published") > as_of - F.expr(f"INTERVAL {hours} HOURS"))
    own = W.partitionBy("source_name").orderBy("pos")
    return recent.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= quota).drop("_n").orderBy(F.desc("published"), "pos").limit(n)


def throttled(items: DataFrame, n: int, per_source: int = 3) -> DataFrame:
    return limit_per_source(items, per_source).orderBy(F.desc("published"), "pos").limit(n)


def schedule(counts: list[tuple[str, float, int]], n: int, kind: str = "deficit", cap: int | None = None, credit: dict | None = None) -> list[tuple[str, int, int]]:
    """(source, its n-th item, place) for weighted or deficit round robin; it
    depends on weights and counts alone. counts: source, weight, items, in queue
    order. A round that gives nothing ends the schedule; ``credit`` is kept up
    to date for the next call."""
    credit = credit if credit is not None else {}
    taken = dict.fromkeys((s for s, *_ in counts), 0)
    out: list[tuple[str, int, int]] = []
    mean = sum(w for _, w, _ in counts) / len(counts) if counts else 0
    while len(out) < n:
        before = len(out)
        for source, weight, have in counts:
            if kind == "weighted" and weight < 0.1:
                continue
            credit[source] = credit.get(source, 0.0) + (weight / mean if kind == "weighted" else weight)
            while credit[source] >= 1 and taken[source] < have and len(out) < n and (not cap or taken[source] < cap):
                taken[source] += 1
                credit[source] -= 1
                out.append((source, taken[source], len(out) + 1))
        if len(out) == before:
            break
    return out


def scheduled(items: DataFrame, weights: dict[str, float], n: int, kind: str = "deficit", cap: int | None = None) -> DataFrame:
    """Items in the order of the schedule: one small count per source, the
    schedule as a table of at most n rows, and a join."""
    spark = items.sparkSession
    counts = [(r.source_name, weights.get(r.source_name, 1.0), r["count"]) for r in items.groupBy("source_name").count().orderBy("source_name").collect()]
    plan = spark.createDataFrame(schedule(counts, n, kind, cap) or [("", 0, 0)], "source_name string, nth bigint, place bigint")
    ranked = items.withColumn("nth", F.row_number().over(W.partitionBy("source_name").orderBy("pos")))
    return ranked.join(F.broadcast(plan), ["source_name", "nth"]).drop("nth")


def cooldown(rows: list[tuple], gap: int) -> list[tuple]:
    """(source, ...) rows reordered so that a source comes again after more than
    ``gap`` others where possible."""
    left, out, last = list(rows), [], {}
    while left:
        pick = next((i for i, r in enumerate(left) if r[0] not in last or len(out) - last[r[0]] > gap), 0)
        row = left.pop(pick)
        last[row[0]] = len(out)
        out.append(row)
    return out


def poll_interval(now: Column, fresh: Column) -> Column:
    """Seconds to the next poll: shorter (30 s at least) after new items, longer
    (15 minutes at most) after none."""
    return F.when(fresh > 0, F.greatest(now * 0.7, F.lit(30.0))).otherwise(F.least(now * 1.5, F.lit(900.0)))
