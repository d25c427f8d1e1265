"""First-wins duplicate removal without a sequential pass.

Rows are taken by ``pos``; a row stays unless a row that stays has one of its
keys. That is the lexicographically first maximal independent set of the
conflict graph, found in rounds: a row that is the first undecided one of each
of its keys stays, and rows that share a key with it go. Conflicts of two rows
(similar vectors) are keys that just these rows have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmill.functions import scores
from newsmill.functions import text as tx
from newsmill.operators import similarity
from newsmill.operators.staging import drop, folder, staged, written


def first_wins(keys: DataFrame) -> DataFrame:
    """``pos`` of the rows that stay; keys: pos and key, a row for each key a
    row has. Rows without any key are not among them: they always stay. A round
    settles the first undecided row at least, so it ends; a chain of conflicts in
    the order of ``pos`` takes a round for every two of its rows."""
    left = keys.where("key IS NOT NULL").distinct()
    kept: DataFrame | None = None
    while not left.isEmpty():
        first = left.groupBy("key").agg(F.min("pos").alias("first"))
        now = staged(left.join(first, "key").groupBy("pos").agg(F.bool_and(F.col("pos") == F.col("first")).alias("ok")).where("ok").select("pos"))
        kept = now if kept is None else kept.union(now)
        taken = left.join(now, "pos", "left_semi").select("key").distinct()
        gone = left.join(taken, "key", "left_semi").select("pos").distinct()
        left = staged(left.join(gone.union(now), "pos", "left_anti"))
    return left.select("pos") if kept is None else kept


def keep_first(items: DataFrame, keys: list[Column], pairs: DataFrame | None = None) -> DataFrame:
    """``items`` without those that conflict with an earlier one that stays. A
    null or empty key is none; pairs (a, b): positions in conflict."""
    # each key is computed once: the planner would repeat its expression in the tests below
    made = staged(items.select("pos", *(k.alias(f"k{i}") for i, k in enumerate(keys))))
    named = [F.when(F.coalesce(F.col(f"k{i}"), F.lit("")) != "", F.concat(F.lit(f"{i}:"), F.col(f"k{i}"))) for i in range(len(keys))]
    own = made.select("pos", F.explode(F.array_compact(F.array(F.lit(None).cast("string"), *named))).alias("key"))
    if pairs is not None:
        key = F.concat_ws(":", F.lit("pair"), F.least("a", "b").cast("string"), F.greatest("a", "b").cast("string"))
        own = own.union(pairs.select(F.col("a").alias("pos"), key.alias("key"))).union(pairs.select(F.col("b").alias("pos"), key.alias("key")))
    own = staged(own)
    # a key that one row has conflicts with nothing
    shared = own.groupBy("key").agg(F.count_distinct("pos").alias("n")).where("n > 1").select("key")
    own = staged(own.join(shared, "key", "left_semi"))
    kept = first_wins(own)
    gone = own.select("pos").distinct().join(kept, "pos", "left_anti")
    return items.join(gone, "pos", "left_anti")


def dedup_url_title(items: DataFrame) -> DataFrame:
    return keep_first(items, [F.col("url"), tx.normalize_title(F.col("title"))])


def dedup_all_prefixes(items: DataFrame) -> DataFrame:
    return keep_first(items, [F.col("url"), tx.normalize_title_all(F.col("title"))])


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """``a, b, sim`` (a < b) of all vectors (pos, embedding) whose cosine, as a
    float, is over the threshold."""
    return similarity.pairs_over(vectors, threshold)


def semantic_dedup(items: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """``items`` without those whose url an earlier one that stays has, or that
    are similar to one that stays."""
    own = vectors.where("embedding IS NOT NULL AND size(embedding) > 0").groupBy("id").agg(F.collect_list("embedding").alias("vectors"))
    rows = items.select("id", "pos", F.nullif(F.col("url"), F.lit("")).alias("key")).join(own, "id", "left")
    # a key that one row has conflicts with nothing
    shared = items.groupBy(F.col("url").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("shared"))
    none = F.array().cast(own.schema["vectors"].dataType)
    rows = rows.join(shared, "key", "left").where("shared OR vectors IS NOT NULL").select(F.col("pos").cast("bigint").alias("pos"), F.when(F.col("shared"), F.col("key")).alias("key"), F.coalesce("vectors", none).alias("vectors"))
    kept = similarity.first_wins_near(rows, threshold)
    gone = rows.select("pos").join(kept, "pos", "left_anti")
    return items.join(gone, "pos", "left_anti")


def save_items(new: DataFrame, have: DataFrame) -> DataFrame:
    """The new items that an insert keeps: id and url (empty urls too) must be
    unlike those of ``have`` and of earlier new items that are kept."""
    fresh = new.join(have.select("id"), "id", "left_anti").join(have.select("url").distinct(), "url", "left_anti").select(new.columns)
    return keep_first(fresh, [F.concat(F.lit("i"), "id"), F.concat(F.lit("u"), F.coalesce("url", F.lit("")))])


def first_by_key(items: DataFrame, key: Column) -> DataFrame:
    """The first row of each key; rows with an empty key stay."""
    from pyspark.sql import Window as W

    keyed = items.withColumn("_key", key)
    ranked = keyed.withColumn("_n", F.row_number().over(W.partitionBy("_key").orderBy("pos")))
    return ranked.where((F.col("_n") == 1) | (F.coalesce("_key", F.lit("")) == "")).drop("_key", "_n")


def simhash_groups(items: DataFrame) -> DataFrame:
    """``pos, primary``: an item is a duplicate of the first kept item with equal
    upper 16 bits of its title's hash and at most 3 different bits."""
    hashed = staged(items.select("pos", tx.simhash(F.col("title")).alias("h")))
    distinct = hashed.groupBy("h").agg(F.min("pos").alias("pos")).withColumn("top", F.shiftrightunsigned("h", 48))
    a, b = distinct.alias("a"), distinct.alias("b")
    near = a.join(b, (F.col("a.top") == F.col("b.top")) & (F.col("a.pos") < F.col("b.pos")) & (scores_hamming("a.h", "b.h") <= 3)).select(F.col("a.pos").alias("a"), F.col("b.pos").alias("b"))
    near = staged(near)
    kept = keep_first(distinct.select("pos"), [], near).select("pos")
    links = near.join(kept.withColumnRenamed("pos", "a"), "a").join(kept.withColumnRenamed("pos", "b"), "b", "left_anti").groupBy("b").agg(F.min("a").alias("primary"))
    firsts = distinct.join(links, distinct.pos == links.b, "left").select("h", F.coalesce("primary", "pos").alias("primary"))
    return hashed.join(firsts, "h").select("pos", "primary")


def scores_hamming(a: str, b: str) -> Column:
    return tx.hamming(F.col(a), F.col(b))


def chained_groups(vectors: DataFrame, threshold: float, near: int = 5) -> DataFrame:
    """``pos, root``: each vector joins its most similar earlier one if
    (1 + cosine) / 2 reaches the threshold, and with it that one's group. What was
    staged or shuffled leaves the disk when the next table is written from it."""
    from pyspark.sql import Window as W

    spark = vectors.sparkSession
    found, path = folder(spark), folder(spark)
    pairs = similarity.nearest(vectors, 1, 2 * threshold - 1 - 1e-6, write=found).where((1 + F.col("sim")) / 2 >= threshold)
    best = pairs.withColumn("n", F.row_number().over(W.partitionBy("b").orderBy(F.desc("sim"), "a"))).where("n = 1")
    label = written(vectors.select("pos").join(best.select(F.col("b").alias("pos"), F.col("a").alias("up")), "pos", "left").select("pos", F.coalesce("up", "pos").alias("root")), path)
    drop(spark, found)
    while True:
        up = label.select(F.col("pos").alias("root"), F.col("root").alias("next"))
        old, path = path, folder(spark)
        new = written(label.join(up, "root").select("pos", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), path)
        drop(spark, old)
        label = new.select("pos", "root")
        if new.where("moved").isEmpty():
            return label


def nearest_earlier(vectors: DataFrame, n: int = 5, threshold: float = -1.01, digits: int | None = None) -> DataFrame:
    """``pos, near, place, sim``: the n most similar earlier vectors of each (pos,
    embedding); ties, after rounding to ``digits`` if given: the earlier one."""
    from pyspark.sql import Window as W

    found = similarity.nearest(vectors, n, threshold, digits)
    ranked = found.withColumn("place", F.row_number().over(W.partitionBy("b").orderBy(F.desc("rank"), "a")))
    return ranked.where(F.col("place") <= n).select(F.col("b").alias("pos"), F.col("a").alias("near"), "place", "sim")


def of_one_size(vectors: DataFrame) -> DataFrame:
    """The vectors with the size of the first (by ``pos``) that isn't empty."""
    full = vectors.where("size(embedding) > 0")
    first = full.agg(F.min_by(F.size("embedding"), "pos").alias("dims"))
    return full.join(F.broadcast(first), F.size("embedding") == F.col("dims"), "left_semi")


def group_stats(groups: DataFrame, root: str = "root") -> DataFrame:
    """``indexed, groups, duplicates``: rows, groups of two or more, and rows that
    aren't the first of theirs."""
    sizes = groups.groupBy(root).agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("indexed"), F.count_if(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def primaries(items: DataFrame, groups: DataFrame) -> DataFrame:
    """``items`` without those of ``groups`` (pos, root) that aren't the first of
    theirs; items of no group stay."""
    return items.join(groups.where("pos <> root").select("pos"), "pos", "left_anti").select(items.columns)


def group_sizes(items: DataFrame, groups: DataFrame, alone: int) -> DataFrame:
    """``pos, size`` of each item's group (pos, root), ``alone`` for items of none."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    own = items.select("pos").join(groups, "pos", "left").join(sizes, "root", "left")
    return own.select("pos", F.coalesce("n", F.lit(alone).cast("bigint")).alias("size"))


def hash_links(items: DataFrame) -> DataFrame:
    """``a, b`` (a < b): hashes of titles with equal upper 16 bits and at most 3
    different bits. Equal titles have one hash and meet as one."""
    own = items.select(tx.simhash(F.col("title")).alias("h")).distinct().withColumn("top", F.shiftrightunsigned("h", 48))
    a, b = own.alias("a"), own.alias("b")
    return a.join(b, (F.col("a.top") == F.col("b.top")) & (F.col("a.h") < F.col("b.h")) & (scores_hamming("a.h", "b.h") <= 3)).select(F.col("a.h").alias("a"), F.col("b.h").alias("b"))
