"""The items, embeddings and events that the news operators work on, as views
over the generic tables, and readers of feeds and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmill.functions import text as tx
from newsmill.functions.scores import tenths

#: The time all windows look back from; operators take it as a parameter.
AS_OF = "2024-01-30 23:57:12"

ITEMS_SQL = f"""items AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang AS source_type, source AS source_name,
  split_part(text, chr(10), 1) AS title, text AS summary, '' AS author, 'doc://' || CAST(doc_id % 700 AS VARCHAR) AS url,
  TIMESTAMP '{AS_OF}' - to_minutes(doc_id * 7) AS published, TIMESTAMP '{AS_OF}' - to_minutes(doc_id * 7) + INTERVAL 5 MINUTE AS fetched,
  doc_id % 3 = 0 AS read, doc_id % 10 = 0 AS saved, doc_id AS pos FROM documents)"""

EVENTS_SQL = """log AS (SELECT event_id AS seq, ts AS t, event_type AS kind, value AS dur_ms, CAST(user_id AS VARCHAR) AS qid,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'click' THEN 'debug' ELSE 'info' END AS level FROM events)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items; ``pos`` is their order, newest first."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    published = F.timestamp_micros(F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.col("doc_id") * 420_000_000)
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("lang").alias("source_type"),
        F.col("source").alias("source_name"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("summary"),
        F.lit("").alias("author"),
        F.concat(F.lit("doc://"), (F.col("doc_id") % 700).cast("string")).alias("url"),
        published.alias("published"),
        (published + F.expr("INTERVAL 5 MINUTES")).alias("fetched"),
        (F.col("doc_id") % 3 == 0).alias("read"),
        (F.col("doc_id") % 10 == 0).alias("saved"),
        F.col("doc_id").alias("pos"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), "embedding")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warn").when(F.col("event_type") == "click", "debug").otherwise("info")
    return e.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("t"), F.col("event_type").alias("kind"), F.col("value").alias("dur_ms"), F.col("user_id").cast("string").alias("qid"), level.alias("level"))


def from_records(records: DataFrame, now: str = AS_OF) -> DataFrame:
    """Feed records (id, source, title, summary, content, url, author, authors,
    published, fetched) as items: missing values come from the next best field."""
    blank = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    key = F.coalesce(blank("id"), blank("url"), blank("title"), F.lit(""))
    fetched = F.coalesce(F.col("fetched"), F.lit(now).cast("timestamp"))
    return records.select(
        tx.item_id(key).alias("id"),
        F.col("source").alias("source_name"),
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        F.coalesce(blank("summary"), tx.truncate(F.coalesce(F.col("content"), F.lit("")), 500)).alias("summary"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        F.coalesce(blank("author"), F.try_element_at("authors", F.lit(1)), F.lit("")).alias("author"),
        F.coalesce(F.col("published"), fetched).alias("published"),
        fetched.alias("fetched"),
    )


EVENT_SCHEMA = "t timestamp, level string, kind string, comp string, session_id string, qid string, dur_ms double, count int, source string, query string, dims int, err string, msg string, extra map<string,string>"


def event_lines(lines: DataFrame) -> DataFrame:
    """The events of (value), a JSON text a line; blank and malformed ones, and
    those with a value of another type, are left out."""
    read = F.from_json("value", EVENT_SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    own = lines.where(F.trim("value") != "").select(read.alias("e")).where("e IS NOT NULL AND e._bad IS NULL")
    return own.select("e.*").drop("_bad")


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines event log; blank and malformed lines are left out."""
    return event_lines(spark.read.text(path))


def emit(events: DataFrame, session_id: str) -> DataFrame:
    """Events as JSON lines (value), stamped with the session; fields that are
    null stay out."""
    own = [c for c in events.columns if c != "session_id"]
    return events.select(F.to_json(F.struct(*own, F.lit(session_id).alias("session_id")), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value"))


RSS_SCHEMA = "title string, link string, description string, content string, encoded string, author string, creator string, pubDate string, updated string"
ATOM_SCHEMA = "title string, link array<struct<_href:string,_rel:string>>, summary string, content string, author struct<name:string>, published string, updated string"


def _fields(ddl: str) -> str:
    return ", ".join(":".join(part.split(" ", 1)) for part in ddl.split(", "))


def _moment(c: str) -> Column:
    """A time as feeds write it, in RFC 822 or ISO form; null if it is neither."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(c, r"^\s*[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.col(c).try_cast("timestamp"))


def feed_items(bodies: DataFrame, now: str = AS_OF) -> DataFrame:
    """The items of (source_name, body), whole RSS or Atom documents: the id is
    from the link, the summary from the description or 200 characters of the
    content, the time that of publication, of the update, or ``now``. A document
    that can't be parsed gives none; the others stay."""
    schema = f"channel struct<item:array<struct<{_fields(RSS_SCHEMA)}>>>, entry array<struct<{_fields(ATOM_SCHEMA)}>>"
    read = bodies.select("source_name", F.from_xml("body", schema, {"ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_text", "mode": "PERMISSIVE"}).alias("d"))
    rss_rows = read.select("source_name", F.explode("d.channel.item").alias("x")).select("source_name", "x.*")
    rss_rows = rss_rows.select("source_name", "title", "link", F.col("description").alias("summary"), F.coalesce("encoded", "content").alias("content"), F.coalesce("author", "creator").alias("author"), F.col("pubDate").alias("published"), "updated")
    atom = read.select("source_name", F.explode("d.entry").alias("x")).select("source_name", "x.*")
    links = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    atom = atom.select("source_name", "title", F.try_element_at(links, F.lit(1))["_href"].alias("link"), "summary", "content", F.col("author.name").alias("author"), "published", "updated")
    summary = F.coalesce(F.nullif(F.col("summary"), F.lit("")), tx.truncate(F.col("content"), 200), F.lit(""))
    time = F.coalesce(_moment("published"), _moment("updated"), F.lit(now).cast("timestamp"))
    link = F.coalesce("link", F.lit(""))
    return rss_rows.unionByName(atom).select(tx.item_id(link).alias("id"), "source_name", F.coalesce("title", F.lit("")).alias("title"), summary.alias("summary"), link.alias("url"), F.coalesce("author", F.lit("")).alias("author"), time.alias("published"))


def rss(spark: SparkSession, path: str, now: str = AS_OF) -> DataFrame:
    """The items of the RSS and Atom documents under ``path``, a file each."""
    files = spark.read.text(path, wholetext=True)
    return feed_items(files.select(F.col("_metadata.file_name").alias("source_name"), F.col("value").alias("body")), now)


def all_feeds(bodies: DataFrame, now: str = AS_OF) -> DataFrame:
    """``feed_items`` of many sources: a source without a document that can be
    parsed is left out; that no source gives an item is an error."""
    found = feed_items(bodies, now)
    if found.isEmpty() and not bodies.isEmpty():
        raise ValueError("no source could be read")
    return found


USGS_SCHEMA = "features array<struct<id:string,properties:struct<mag:double,place:string,time:bigint,url:string,title:string,type:string,sig:int,alert:string,tsunami:int>,geometry:struct<coordinates:array<double>>>>"


def earthquakes(bodies: DataFrame) -> DataFrame:
    """The features of (body), GeoJSON documents, as items; kinds other than
    earthquakes of under 100 significance go. Magnitude, place, alert, tsunami and
    depth (0 if unknown) are in the summary."""
    f = bodies.select(F.explode(F.from_json("body", USGS_SCHEMA)["features"]).alias("f")).select("f.id", "f.properties.*", F.get("f.geometry.coordinates", F.lit(2)).alias("depth"))
    kept = f.where((F.col("type") == "earthquake") | (F.coalesce("sig", F.lit(0)) >= 100))
    number = lambda c: F.when(F.col(c) < 0, F.concat(F.lit("-"), tenths(-F.col(c)))).otherwise(tenths(F.coalesce(F.col(c), F.lit(0.0))))
    some = lambda test, text: F.when(test, text).otherwise(F.lit(""))
    alert = F.coalesce("alert", F.lit(""))
    summary = F.concat(F.lit("Magnitude "), number("mag"), F.lit(" earthquake "), F.coalesce("place", F.lit("")), some(alert != "", F.concat(F.lit(" [ALERT: "), alert, F.lit("]"))), some(F.col("tsunami") == 1, F.lit(" [TSUNAMI WARNING]")), F.lit(" Depth: "), number("depth"), F.lit("km"))
    return kept.select(F.concat(F.lit("usgs-"), F.coalesce("id", F.lit(""))).alias("id"), F.coalesce("title", F.lit("")).alias("title"), summary.alias("summary"), F.coalesce("url", F.lit("")).alias("url"), F.timestamp_millis(F.coalesce("time", F.lit(0))).alias("published"))


def usgs(spark: SparkSession, path: str) -> DataFrame:
    """``earthquakes`` of the GeoJSON files under ``path``."""
    return earthquakes(spark.read.text(path, wholetext=True).select(F.col("value").alias("body")))
