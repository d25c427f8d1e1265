"""Top-story counters over analysis runs, velocity of clusters and briefings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsmill.functions import scores


def lifecycle(hits: DataFrame, runs: DataFrame) -> DataFrame:
    """``item_id, hit, miss, streak, first_seen, last_seen, status`` after all
    runs (run, at): hits (item_id, run) are the stories a run named. miss counts
    the runs since the last hit, streak the last unbroken runs of hits."""
    last = runs.agg(F.max("run").alias("last_run"))
    own = hits.select("item_id", "run").distinct().join(runs, "run")
    gap = own.withColumn("group", F.col("run") - F.row_number().over(W.partitionBy("item_id").orderBy("run")))
    islands = gap.groupBy("item_id", "group").agg(F.count("*").alias("length"), F.max("run").alias("end"), F.min("at").alias("a"), F.max("at").alias("b"))
    per = islands.groupBy("item_id").agg(F.sum("length").alias("hit"), F.max("end").alias("end"), F.max_by("length", "end").alias("streak"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen"))
    out = per.crossJoin(F.broadcast(last)).withColumn("miss", F.col("last_run") - F.col("end"))
    return out.select("item_id", "hit", "miss", "streak", "first_seen", "last_seen", scores.story_status(F.col("hit"), F.col("miss")).alias("status"))


DAY = 86400
#: Looks back, to so many seconds ago from so many (a day at most).
RATES = {"rate15m": (900, 0), "rate1h": (3600, 0), "rate6h": (21600, 0)}
BASELINE = {"baseline": (DAY, 3601)}


def looked_back(snapshots: DataFrame, looks: dict[str, tuple[int, int]]) -> DataFrame:
    """Snapshots (cluster, ts) with how many of their cluster each look back finds.
    Snapshots without a time find each other.

    Snapshots are counted by second; the seconds are dealt by cluster and day, each
    to its own day and, if one that looks back so far meets it, the next. A count is
    the difference of two running sums, so no frame is added up again for each row.
    Seconds are looked up by hash: no snapshot is sorted."""
    own = snapshots.withColumn("_second", F.unix_seconds("ts"))
    per = own.groupBy(F.col("cluster").alias("_cluster"), F.col("_second").alias("_at")).agg(F.count("*").alias("_n"))
    day = F.floor(F.col("_at") / DAY)
    late = F.col("_at") - day * DAY >= DAY - max(a for a, _ in looks.values())
    dealt = per.withColumn("_own", day).withColumn("_day", F.explode(F.when(late, F.array(day, day + 1)).otherwise(F.array(day))))
    upto = lambda s: F.coalesce(F.sum("_n").over(W.partitionBy("_cluster", "_day").orderBy("_at").rangeBetween(W.unboundedPreceding, s)), F.lit(0))
    counted = dealt.select("_cluster", "_at", "_own", "_day", *((upto(-b) - upto(-a - 1)).alias(name) for name, (a, b) in looks.items())).where("_own = _day").drop("_own", "_day")
    # in windows over seconds a snapshot without a time meets the others without one
    none = per.where("_at IS NULL").select("_cluster", "_at", *(F.col("_n").alias(name) for name in looks))
    met = own.join(counted.unionByName(none).hint("shuffle_hash"), F.col("cluster").eqNullSafe(F.col("_cluster")) & F.col("_second").eqNullSafe(F.col("_at")), "left")
    return met.select(*snapshots.columns, *looks)


def hourly(looks: dict[str, tuple[int, int]]) -> dict:
    """Counts of looks back as snapshots an hour; a baseline of none is 1."""
    rate = {name: F.col(name) / (a / 3600) for name, (a, _) in looks.items() if name in RATES}
    return rate | {name: F.when(F.col(name) > 0, F.col(name) / 23.0).otherwise(1.0) for name in looks if name in BASELINE}


def rates(snapshots: DataFrame) -> DataFrame:
    """Per snapshot (cluster, ts) the snapshots an hour over the last 15 minutes,
    hour and 6 hours; they look back on a quarter of a day only."""
    return looked_back(snapshots, RATES).withColumns(hourly(RATES))


def velocity(snapshots: DataFrame) -> DataFrame:
    """Per snapshot (cluster, ts) the rates of ``rates``, the baseline (the 23 hours
    before the last; 1 if none) and whether two rates of three are over twice the
    baseline."""
    looks = RATES | BASELINE
    out = looked_back(snapshots, looks).withColumns(hourly(looks))
    over = sum((F.when(F.col(c) > 2 * F.col("baseline"), 1).otherwise(0) for c in RATES), F.lit(0))
    return out.withColumns({"spike": over >= 2, "trend": scores.trend(F.col("rate1h"))})


def error_streaks(log: DataFrame) -> DataFrame:
    """``source, errors``: errors since the last success of (source, at, ok). The
    last successes are a grouped maximum; no window holds a source's log."""
    good = log.groupBy("source").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("good"))
    late = F.col("good").isNull() | (F.col("at") > F.col("good"))
    return log.join(good, "source").groupBy("source").agg(F.count_if(~F.col("ok") & late).alias("errors"))


def parts_of(own: DataFrame) -> DataFrame:
    """``pos, part`` for each item of (pos, entity_id); the part is the least item
    that entities join it with. Each round all items of a label take the least
    label that one of them meets, then the label of that item (a jump)."""
    from newsmill.operators.staging import staged

    own = staged(own.select("pos", "entity_id").distinct())
    label = staged(own.select("pos", F.col("pos").alias("part")).distinct())
    while True:
        least = own.where("entity_id IS NOT NULL").join(label, "pos").groupBy("entity_id").agg(F.min("part").alias("least"))
        near = own.join(least, "entity_id").join(label, "pos")
        hook = staged(near.groupBy("part").agg(F.min("least").alias("to")))
        if hook.where("part <> to").isEmpty():
            return label
        to = staged(label.join(hook, "part", "left").select("pos", F.coalesce("to", "part").alias("part")))
        jump = to.select(F.col("pos").alias("part"), F.col("part").alias("far"))
        label = staged(to.join(jump, "part").select("pos", F.col("far").alias("part")))


def assign_clusters(entities: DataFrame, hours: int = 48) -> DataFrame:
    """``pos, cluster``: items (pos, at in seconds, entity_id) by position join
    the cluster that holds most of their entities, half of them at least and not
    idle for ``hours``; else they start one. Items that no entity joins never
    meet, so each connected part of items and entities is one sequential pass.
    Ties: the earliest cluster. An item whose only entity is null is alone."""
    import pandas as pd

    from newsmill.operators.staging import staged

    own = staged(entities.select("pos", "at", "entity_id"))
    alone = own.groupBy("pos").agg(F.count("entity_id").alias("n")).where("n = 0").select("pos", F.col("pos").alias("cluster"))
    own = own.where("entity_id IS NOT NULL")
    label = parts_of(own)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        clusters: list[dict] = []
        out = []
        for pos, rows in pdf.sort_values("pos").groupby("pos"):
            have, at = set(rows.entity_id.dropna()), int(rows["at"].iloc[0])
            need, best = max(1, len(have) // 2), None
            for c in clusters:
                n = len(have & c["own"])
                if n >= need and at - c["last"] <= hours * 3600 and (best is None or n > best[0]):
                    best = (n, c)
            c = best[1] if best else {"id": pos, "own": set(), "last": at}
            if not best:
                clusters.append(c)
            c["own"] |= have
            c["last"] = max(c["last"], at)
            out.append((pos, c["id"]))
        return pd.DataFrame(out, columns=["pos", "cluster"])

    return own.join(label, "pos").groupBy("part").applyInPandas(run, "pos bigint, cluster bigint").union(alone)
