"""Top stories: model text into rows, their order and labels, the changing list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsmill.functions import scores
from newsmill.functions.text import blank

NEW, EMERGING, NOTED = "● NEW", "◐ EMERGING", "◦ NOTED"
# Words for each label, whole and as a part.
LABELS = {NEW: ("BREAKING", "BREAKING NEWS", "BREAK"), EMERGING: ("DEVELOPING", "DEV", "ONGOING"), NOTED: ("TOP", "TOP STORY", "TOP NEWS", "IMPORTANT", "MAJOR", "SIGNIFICANT")}
PARTS = {NEW: ("BREAKING",), EMERGING: ("DEVELOPING", "ONGOING"), NOTED: ("TOP", "IMPORTANT", "MAJOR")}
BAD_STARTS = ("according to", "reports say", "the ", "a ", "an ")


def map_label(label: Column) -> Column:
    """A model's label as one of three; empty where it is none."""
    up = F.trim(F.upper(blank(label)))
    up = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(up, r"^\*\*", ""), r"\*\*$", ""), "^- ", ""), r"^\* ", ""))
    out = F.lit("")
    for name, parts in reversed(PARTS.items()):
        out = F.when(up.rlike("|".join(parts)), name).otherwise(out)
    for name, words in LABELS.items():
        out = F.when(up.isin(*words), name).otherwise(out)
    return out


def clean_reason(reason: Column, names: Column) -> Column:
    """A reason, or empty where it looks like a headline: it holds one of
    ``names`` (an array of lower-case sources and starts of titles), markdown,
    over 80 bytes, or a headline's start with over 40."""
    reason = blank(reason)
    low = F.lower(reason)
    size = F.octet_length(reason)
    start = F.lit(False)
    for s in BAD_STARTS:
        start = start | low.startswith(s)
    bad = F.exists(names, lambda n: F.contains(low, n)) | reason.contains("*") | (size > 80) | (start & (size > 40))
    return F.when(bad, "").otherwise(reason)


def parse(replies: DataFrame, items: DataFrame, most: int = 50) -> DataFrame:
    """``reply_id, place, item_id, label, reason`` of model texts (reply_id,
    content) about numbered items (number from 1, id, title, source_name): lines
    ``label|number|reason``; where a reply has none, list lines that hold a title's
    first 40 characters (3 at most); else the numbers that it names (6 at most).

    The items are the numbered headlines of a prompt, ``most`` at most."""
    own = items.where(F.col("number").between(1, most)).select("number", F.col("id").alias("item_id"), F.lower("title").alias("title"), F.lower("source_name").alias("source"))
    heads = F.when(F.length("title") > 20, F.substring("title", 1, 20))
    names = own.agg(F.array_distinct(F.concat(F.collect_list("source"), F.collect_list(heads))).alias("names"))
    lines = replies.select("reply_id", F.posexplode(F.split("content", "\n")).alias("at", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    cut = F.split("line", r"\|", 3)
    piped = lines.where(F.size(cut) == 3).select("reply_id", "at", map_label(cut[0]).alias("label"), F.regexp_extract(F.trim(cut[1]), r"^([0-9]{1,9})", 1).try_cast("int").alias("number"), F.trim(cut[2]).alias("reason"))
    piped = piped.where("label <> ''").join(F.broadcast(own.select("number", "item_id")), "number").crossJoin(F.broadcast(names))
    piped = piped.select("reply_id", "at", "item_id", "label", clean_reason(F.col("reason"), F.col("names")).alias("reason"))

    listed = lines.where(F.col("line").rlike(r"^([123]\.|-|\*)") | F.col("line").contains("**")).join(piped.select("reply_id").distinct(), "reply_id", "left_anti")
    bare = F.lower(F.regexp_replace(F.replace("line", F.lit("*"), F.lit("")), r"^[0-9.\-) ]+", ""))
    listed = listed.withColumn("bare", bare).join(F.broadcast(own), F.expr("contains(bare, substr(title, 1, 40)) OR contains(title, substr(bare, 1, 40)) OR (contains(bare, source) AND octet_length(bare) > 20)"))
    listed = listed.groupBy("reply_id", "at").agg(F.min("number").alias("number"), F.first("line").alias("line")).groupBy("reply_id", "number").agg(F.min_by("line", "at").alias("line"), F.min("at").alias("at"))
    listed = listed.withColumn("n", F.row_number().over(W.partitionBy("reply_id").orderBy("at"))).where("n <= 3").join(F.broadcast(own.select("number", "item_id")), "number").crossJoin(F.broadcast(names))
    reason = F.trim(F.coalesce(*[F.nullif(F.regexp_extract("line", f"(?s)^.+?{sep}(..+)$", 1), F.lit("")) for sep in (": ", " - ", "– ")], F.lit("")))
    listed = listed.select("reply_id", "at", "item_id", F.when(F.col("n") == 1, NEW).when(F.col("n") == 2, EMERGING).otherwise(NOTED).alias("label"), clean_reason(reason, F.col("names")).alias("reason"))

    rest = replies.join(piped.select("reply_id").union(listed.select("reply_id")).distinct(), "reply_id", "left_anti")
    word = rest.select("reply_id", F.posexplode(F.split(F.trim("content"), r"\s+")).alias("at", "word")).select("reply_id", "at", F.regexp_extract("word", r"^#?\(?\+?([0-9]{1,9})", 1).try_cast("int").alias("number"))
    word = word.groupBy("reply_id", "number").agg(F.min("at").alias("at")).join(F.broadcast(own.select("number", "item_id")), "number")
    word = word.withColumn("n", F.row_number().over(W.partitionBy("reply_id").orderBy("at"))).where("n <= 6").select("reply_id", "at", "item_id", F.lit(NOTED).alias("label"), F.lit("").alias("reason"))
    place = F.row_number().over(W.partitionBy("reply_id").orderBy("at"))
    return piped.unionByName(listed).unionByName(word).select("reply_id", place.alias("place"), "item_id", "label", "reason")


def ordered(stories: DataFrame) -> DataFrame:
    """Stories (status, hit, first_seen) in the order they are shown, with labels."""
    out = stories.withColumn("label", scores.story_label(F.col("status"), F.col("hit")))
    return out.orderBy(scores.status_order(F.col("status")), F.desc("hit"), F.desc("first_seen"), "item_id")


def breathing(current: DataFrame, cache: DataFrame, least: int = 3, most: int = 8) -> DataFrame:
    """The list of top stories: the current ones (item_id, title, hit, miss), then
    cached ones with 3 hits and 2 misses at most, of unlike ids and starts of
    titles; up to ``least`` it is filled with cached ones of a hit and 3 misses at
    most; ``most`` in all, by status, hits and first_seen."""
    start = lambda: F.lower(F.substring("title", 1, 40))
    now = current.withColumn("tier", F.lit(0))
    kept = cache.where("hit >= 3 AND miss <= 2").withColumn("tier", F.lit(1))
    more = cache.where("hit >= 1 AND miss <= 3").withColumn("tier", F.lit(2))
    every = now.unionByName(kept).unionByName(more).withColumn("start", start())
    first = F.row_number().over(W.partitionBy("item_id").orderBy("tier"))
    every = every.withColumn("n", first).where("n = 1")
    alike = F.row_number().over(W.partitionBy("start").orderBy("tier", F.desc("hit"), "item_id"))
    every = every.withColumn("n", F.when(F.col("start") == "", 1).otherwise(alike)).where("n = 1")
    placed = every.withColumn("place", F.row_number().over(W.orderBy("tier", F.desc("hit"), "item_id")))
    listed = placed.where((F.col("tier") < 2) | (F.col("place") <= least)).withColumn("status", scores.story_status(F.col("hit"), F.col("miss")))
    return ordered(listed.drop("tier", "start", "n", "place")).limit(most)


def context(cache: DataFrame, most: int = 5) -> DataFrame:
    """One row ``text``: the titled stories that aren't fading, by hits, for a
    prompt; empty where there are none."""
    live = cache.withColumn("status", scores.story_status(F.col("hit"), F.col("miss"))).where((F.col("status") != "fading") & (blank(F.col("title")) != ""))
    top = live.orderBy(F.desc("hit"), "item_id").limit(most).withColumn("n", F.row_number().over(W.orderBy(F.desc("hit"), "item_id")))
    line = F.format_string("%d. [%s] %s\n", F.col("n"), scores.story_label(F.col("status"), F.col("hit")), F.col("title"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x.line), "")
    return top.agg(text.alias("text")).select(F.when(F.col("text") == "", "").otherwise(F.concat(F.lit("CURRENT TOP STORIES:\n"), "text")).alias("text"))


def prompt(items: DataFrame, most: int = 50) -> DataFrame:
    """One row ``text``: the first headlines, numbered, for a model."""
    top = items.orderBy("pos").limit(most).withColumn("n", F.row_number().over(W.orderBy("pos")))
    line = F.format_string("%d. [%s] %s", F.col("n"), F.col("source_name"), F.col("title"))
    return top.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x.line), "\n").alias("text"))
