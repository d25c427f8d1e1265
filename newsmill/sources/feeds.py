"""Feeds of other services as items: JSON answers and a catalogue of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmill.functions import text as tx
from newsmill.functions.scores import whole
from newsmill.functions.text import blank

HN_SCHEMA = "id bigint, title string, url string, text string, `by` string, time bigint"
MANIFOLD_SCHEMA = "id string, question string, isResolved boolean, probability double, uniqueBettorCount bigint, volume24Hours double, textDescription string, createdTime bigint, url string, creatorUsername string, creatorName string, slug string"
POLYMARKET_SCHEMA = "id string, question string, outcomePrices string, volume24hr string, description string, slug string, createdAt timestamp"


def _some(test: Column, text: Column) -> Column:
    return F.when(test, text).otherwise(F.lit(""))


def _percent(p: Column) -> Column:
    return F.concat(whole(p * 100), F.lit("% YES"))


def _described(c: Column) -> Column:
    return _some(blank(c) != "", F.concat(F.lit("\n"), tx.truncate_bytes(c, 150, room=False)))


def hackernews(stories: DataFrame, most: int = 50) -> DataFrame:
    """Stories (``pos`` and HN_SCHEMA), the first ``most``, as items; without a
    title they are left out, without a URL they link to their page."""
    page = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("id").cast("string"))
    own = stories.orderBy("pos").limit(most).where(blank(F.col("title")) != "")
    return own.select(F.concat(F.lit("hn-"), F.col("id").cast("string")).alias("id"), "title", tx.truncate_bytes(F.col("text"), 200).alias("summary"), F.when(blank(F.col("url")) == "", page).otherwise(F.col("url")).alias("url"), blank(F.col("by")).alias("author"), F.timestamp_seconds("time").alias("published"))


def manifold(markets: DataFrame, most: int = 50) -> DataFrame:
    """Open markets (``pos`` and MANIFOLD_SCHEMA) as items."""
    own = markets.orderBy("pos").limit(most).where((blank(F.col("question")) != "") & ~F.coalesce("isResolved", F.lit(False)))
    summary = F.concat(
        _percent(F.coalesce("probability", F.lit(0.0))),
        _some(F.col("uniqueBettorCount") > 0, F.format_string(" · %d traders", F.col("uniqueBettorCount"))),
        _some(F.col("volume24Hours") > 0, F.concat(F.lit(" · M$"), whole(F.col("volume24Hours")), F.lit(" 24h"))),
        _described(F.col("textDescription")),
    )
    url = F.when(blank(F.col("url")) != "", F.col("url")).otherwise(F.concat(F.lit("https://manifold.markets/"), blank(F.col("creatorUsername")), F.lit("/"), blank(F.col("slug"))))
    return own.select(F.concat(F.lit("manifold-"), "id").alias("id"), F.concat(F.lit("\U0001f4c8 "), "question").alias("title"), summary.alias("summary"), url.alias("url"), blank(F.col("creatorName")).alias("author"), F.timestamp_millis("createdTime").alias("published"))


def polymarket(markets: DataFrame, most: int = 50) -> DataFrame:
    """Markets (``pos`` and POLYMARKET_SCHEMA) as items, the day's largest volume
    first; a volume is a number or a text of one."""
    volume = F.coalesce(F.col("volume24hr").try_cast("double"), F.lit(0.0))
    own = markets.orderBy("pos").limit(most).where(blank(F.col("question")) != "").withColumn("_volume", volume)
    summary = F.concat(_percent(tx.parse_first_price(F.col("outcomePrices"))), _some(F.col("_volume") > 0, F.concat(F.lit(" · $"), whole(F.col("_volume") / 1000), F.lit("K 24h volume"))), _described(F.col("description")))
    out = own.orderBy(F.desc("_volume"), "pos")
    return out.select(F.concat(F.lit("poly-"), "id").alias("id"), F.concat(F.lit("\U0001f4ca "), "question").alias("title"), summary.alias("summary"), F.concat(F.lit("https://polymarket.com/event/"), blank(F.col("slug"))).alias("url"), F.lit("").alias("author"), F.col("createdAt").alias("published"))


def answers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of JSON answers (arrays of objects, a file each), with ``pos``
    inside the answer."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{schema_of(schema)}>>").alias("l"))
    return raw.select(F.posexplode("l").alias("pos", "x")).select("pos", "x.*")


def schema_of(ddl: str) -> str:
    """A column list as the fields of a struct type."""
    return ", ".join(":".join(part.strip().split(" ", 1)) for part in ddl.split(","))


CATALOG_SCHEMA = "name string, url string, category string, refresh_minutes int, weight double, enabled boolean"


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue of sources from a CSV file with a header; the list itself is
    the user's. Without weight and refresh time: 1 and 5 minutes."""
    rows = spark.read.option("header", True).schema(CATALOG_SCHEMA).csv(path)
    return rows.withColumns({"refresh_minutes": F.coalesce("refresh_minutes", F.lit(5)), "weight": F.coalesce("weight", F.lit(1.0)), "enabled": F.coalesce("enabled", F.lit(True))})


def categories(sources: DataFrame) -> DataFrame:
    return sources.where("enabled").groupBy("category").agg(F.count("*").alias("n")).orderBy("category")
