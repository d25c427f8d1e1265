"""Composed views: feeds, search, statistics of their stages, briefings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsmill.functions import scores
from newsmill.functions import text as tx
from newsmill.operators import dedup, entities, sampling, stories


def similarity(items: DataFrame, vectors: DataFrame, query: list[float]) -> DataFrame:
    """Items with ``sim``, the cosine of their vector with the query's, or null."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return items.join(vectors.select("id", scores.cosine(F.col("embedding"), q).alias("sim")), "id", "left")


def feed(items: DataFrame, vectors: DataFrame, since: Column, threshold: float = 0.85, per_source: int = 50, newest: int | None = None) -> DataFrame:
    """The unread items after ``since`` (of the newest, where a number is given),
    without near duplicates, some of each source, newest first."""
    own = items.where(~F.col("read"))
    own = own.orderBy(F.desc("published"), "pos").limit(newest) if newest else own
    return sampling.limit_per_source(dedup.semantic_dedup(own.where(F.col("published") > since), vectors, threshold), per_source)


def balanced_feed(items: DataFrame, since: Column, per_source: int = 10) -> DataFrame:
    """Items after ``since`` without copies by URL or whole title, the first of
    each source."""
    return sampling.first_per_group(dedup.dedup_all_prefixes(items.where(F.col("published") > since)), F.col("source_name"), per_source, ["pos"])


def search(items: DataFrame, vectors: DataFrame, query: list[float], since: Column, threshold: float = 0.85, per_source: int = 50, n: int = 10, newest: int = 10_000) -> DataFrame:
    """The command line's search: the newest items, read ones too, after
    ``since``, without near duplicates, some of each source, the n nearest; then a
    reranker may order them (``models.rerank``)."""
    pool = items.orderBy(F.desc("published"), "pos").limit(newest).where(F.col("published") > since)
    own = sampling.limit_per_source(dedup.semantic_dedup(pool, vectors, threshold), per_source)
    return similarity(own, vectors, query).orderBy(F.desc_nulls_last("sim"), F.desc("published"), "pos").limit(n)


def stage_counts(items: DataFrame, vectors: DataFrame, as_of: Column, threshold: float = 0.85, per_source: int = 50, newest: int = 500) -> DataFrame:
    """``stage, n``: how many items each stage of the feed keeps."""
    day = F.col("published") > as_of - F.expr("INTERVAL 24 HOURS")
    unread = ~F.col("read")
    first = items.agg(F.count("*").alias("all"), F.count_if(unread).alias("unread"), F.count_if(day).alias("day"), F.count_if(day & unread).alias("day_unread")).unpivot([], ["all", "unread", "day", "day_unread"], "stage", "n")
    pool = items.where(unread).orderBy(F.desc("published"), "pos").limit(newest)
    aged = pool.where(day)
    alone = dedup.semantic_dedup(aged, vectors, threshold)
    capped = sampling.limit_per_source(alone, per_source)
    steps = {"pool": pool, "aged": aged, "embedded": aged.join(vectors.select("id"), "id", "left_semi"), "deduplicated": alone, "capped": capped}
    out = first
    for name, df in steps.items():
        out = out.union(df.agg(F.lit(name).alias("stage"), F.count("*").alias("n")))
    return out


def by_rank(items: DataFrame, ranked: DataFrame) -> DataFrame:
    """The items of ``ranked`` (id, rank) in its order, then the others, newest
    first."""
    return items.join(ranked.groupBy("id").agg(F.min("rank").alias("rank")), "id", "left").orderBy(F.asc_nulls_last("rank"), F.desc("published"), "pos")


def by_scores(items: DataFrame, scored: DataFrame) -> DataFrame:
    """The scored candidates (id, score), best first, then the others as they were."""
    return items.join(scored, "id", "left").orderBy(F.desc_nulls_last("score"), "pos")


def rerank_count(height: int, items: int) -> int:
    """How many items are reranked for a view of this height."""
    return min(max(30, height + 10), items)


def prepend(items: DataFrame, new: DataFrame) -> DataFrame:
    """New items before the others, without those whose URL is there or came
    before; ``pos`` counts anew."""
    fresh = dedup.first_by_key(new.join(items.select("url").where("url <> ''").distinct(), "url", "left_anti").select(new.columns), F.col("url"))
    low = fresh.agg((F.max("pos") + 1).alias("_n"))
    moved = items.crossJoin(F.broadcast(low)).withColumn("pos", F.col("pos") + F.coalesce("_n", F.lit(0))).drop("_n")
    return fresh.unionByName(moved)


def headlines(items: DataFrame, vectors: DataFrame, query: list[float]) -> DataFrame:
    """Items as headlines: their likeness to the query (0.5 where unknown); the
    factors that nothing measures are 0.5."""
    s = similarity(items, vectors, query)
    half = F.lit(0.5)
    return s.select("id", "pos", "title", "source_name", "published", F.struct(F.coalesce(F.col("sim").cast("double"), half).alias("semantic"), half.alias("rerank"), half.alias("arousal"), half.alias("negative"), half.alias("diversity")).alias("factors"))


def rerank_stories(scored: DataFrame, most: int = 8) -> DataFrame:
    """The best of (id, score) with label and reason."""
    top = scored.orderBy(F.desc("score"), "id").limit(most).withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "id")) - 1)
    return top.select("id", "place", scores.relevance_label(F.col("place"), F.col("score")).alias("label"), F.concat(F.lit("Relevance: "), scores.whole(F.col("score") * 100), F.lit("%")).alias("reason"))


def clusters_of(assigned: DataFrame, items: DataFrame, as_of: Column) -> DataFrame:
    """``cluster, size, first_at, last_at, rate1h, trend`` of (pos, cluster) and
    items: rate1h counts the items of the hour before ``as_of``."""
    own = assigned.join(items.select("pos", "published"), "pos")
    recent = (F.col("published") > as_of - F.expr("INTERVAL 1 HOUR")) & (F.col("published") <= as_of)
    out = own.groupBy("cluster").agg(F.count("*").alias("size"), F.min("published").alias("first_at"), F.max("published").alias("last_at"), F.count_if(recent).cast("double").alias("rate1h"))
    return out.withColumn("trend", scores.trend(F.col("rate1h")))


def active_clusters(clusters: DataFrame, n: int = 10) -> DataFrame:
    return clusters.where("size >= 2").orderBy(F.desc("rate1h"), F.desc("size"), "cluster").limit(n)


def top_entities(entities: DataFrame, n: int = 20) -> DataFrame:
    """``entity_id, mentions`` of (pos, entity_id), most first."""
    return entities.groupBy("entity_id").agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "entity_id").limit(n)


def briefing(clusters: DataFrame, entities: DataFrame, items: DataFrame, last_session: Column, as_of: Column, least: int = 3) -> DataFrame:
    """``kind, name, importance, n`` since the last session, if that is over four
    hours ago: clusters that are new or larger than 3, and entities of ``least``
    mentions."""
    away = last_session < as_of - F.expr("INTERVAL 4 HOURS")
    rate = F.col("rate1h")
    c = clusters.where(away & ((F.col("first_at") > last_session) | (F.col("size") > 3))).select(F.lit("cluster").alias("kind"), F.col("cluster").cast("string").alias("name"), F.when(rate > 5, 5).when(rate > 2, 4).otherwise(3).alias("importance"), F.col("size").alias("n"))
    own = entities.join(items.where(F.col("published") > last_session).select("pos"), "pos", "left_semi")
    e = own.where(away).groupBy("entity_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.lit("entity").alias("kind"), F.col("entity_id").alias("name"), F.lit(2).alias("importance"), "n")
    return c.unionByName(e).orderBy(F.desc("importance"), F.desc("n"), "name")


def radar(clusters: DataFrame, entities: DataFrame, items: DataFrame, as_of: Column, n_clusters: int = 10, n_entities: int = 20, hours: int = 6) -> DataFrame:
    """``kind, name, n``: the most active clusters and the entities most mentioned
    in the last hours."""
    c = active_clusters(clusters, n_clusters).select(F.lit("cluster").alias("kind"), F.col("cluster").cast("string").alias("name"), F.col("size").alias("n"))
    own = entities.join(items.where(F.col("published") > as_of - F.expr(f"INTERVAL {hours} HOURS")).select("pos"), "pos", "left_semi")
    return c.unionByName(top_entities(own, n_entities).select(F.lit("entity").alias("kind"), F.col("entity_id").alias("name"), F.col("mentions").alias("n")))


def correlated(items: DataFrame, as_of: Column) -> DataFrame:
    """Clusters (as ``clusters_of``) of the items that aren't duplicates by title:
    duplicates, entities, clusters, rates, one after the other. Duplicates go no
    further; items without an entity are alone."""
    firsts = dedup.primaries(items, dedup.simhash_groups(items).withColumnRenamed("primary", "root"))
    at = firsts.select("pos", F.unix_seconds("published").alias("at"))
    named = at.join(entities.entities(firsts).select("pos", "entity_id"), "pos", "left")
    return clusters_of(stories.assign_clusters(named), firsts, as_of)


def story_candidates(items: DataFrame, vectors: DataFrame, as_of: Column, threshold: float = 0.85, hours: int = 6, most: int = 200) -> DataFrame:
    """``id, pos, doc`` of the newest ``most`` items of the last hours (of all, if
    there is none), without near duplicates; doc is title and summary in 300 bytes,
    what a reranker is given."""
    recent = items.where(F.col("published") > as_of - F.expr(f"INTERVAL {hours} HOURS"))
    own = (items if recent.isEmpty() else recent).orderBy(F.desc("published"), "pos").limit(most)
    groups = dedup.chained_groups(own.select("id", "pos").join(vectors, "id").select("pos", "embedding"), threshold)
    title, summary = F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))
    doc = F.concat(title, F.when(summary != "", F.concat(F.lit(" - "), summary)).otherwise(""))
    return dedup.primaries(own, groups).select("id", "pos", tx.truncate_bytes(doc, 300, mark="").alias("doc"))
