"""All registered queries of the news operators, with the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsmill.functions import models
from newsmill.functions import scores as sc
from newsmill.functions import text as tx
from newsmill.operators import dedup, entities, lexical, rules, sampling, stories
from newsmill.sources import items as src

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The functions of items behind the queries of ``on_items``.
OF_ITEMS: dict = {}
c = F.col


def now():
    return F.lit(src.AS_OF).cast("timestamp")


def age():
    """Seconds since an item was published."""
    return sc.seconds(now(), c("published"))


T = f"TIMESTAMP '{src.AS_OF}'"
AGE_SQL = f"(epoch({T}) - epoch(published))"
WITH = "WITH RECURSIVE " + src.ITEMS_SQL
WITH_LOG = "WITH " + src.EVENTS_SQL


def on_items(name: str, sql: str | None = None, more: str = ""):
    """Register a function of the items."""

    def add(f):
        OF_ITEMS[name] = f
        QUERIES[name] = lambda spark, d: f(src.items(spark, d))
        if sql:
            SQL[name] = WITH + more + " " + sql
        return f

    return add


def on_log(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, d: f(src.events(spark, d))
        SQL[name] = WITH_LOG + " " + sql
        return f

    return add


def on_both(name: str, sql: str | None, more: str = ""):
    """Register a function of items and embeddings."""

    def add(f):
        QUERIES[name] = lambda spark, d: f(src.items(spark, d), src.embeddings(spark, d))
        if sql:
            SQL[name] = WITH + VEC + more + " " + sql
        return f

    return add


def on_table(name: str, tables: tuple[str, ...], sql: str):
    def add(f):
        QUERIES[name] = lambda spark, d: f(*(spark.read.parquet(f"{d}/{t}.parquet") for t in tables))
        SQL[name] = sql
        return f

    return add


def on_rows(name: str, schema: str, rows: str, sql: str):
    """Register a function of a literal table, given as SQL VALUES."""
    names = ", ".join(x.strip().split(" ")[0] for x in schema.split(","))

    def add(f):
        QUERIES[name] = lambda spark, d: f(spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})"))
        SQL[name] = f"WITH t AS (SELECT * FROM (VALUES {rows}) AS t({names})) {sql}"
        return f

    return add


VEC = ", vec AS (SELECT CAST(vec_id AS VARCHAR) AS vid, embedding FROM embeddings)"
ids = lambda df, *more: df.select("id", *more)

# scans
on_items("scan_items", "SELECT id FROM items WHERE NOT read ORDER BY published DESC, pos LIMIT 100")(lambda i: ids(i.where(~c("read")).orderBy(F.desc("published"), "pos").limit(100)))
on_items("scan_since", f"SELECT id FROM items WHERE published > {T} - INTERVAL 6 HOUR")(lambda i: ids(i.where(c("published") > now() - F.expr("INTERVAL 6 HOURS"))))
on_both("scan_needing_embedding", "SELECT id FROM items ANTI JOIN vec ON vid = id ORDER BY fetched, pos LIMIT 100")(lambda i, v: ids(i.join(v, "id", "left_anti").orderBy("fetched", "pos").limit(100)))
on_both("lookup_embedding", "SELECT vid AS id, len(embedding) AS n FROM vec WHERE vid = '17'")(lambda i, v: v.where("id = '17'").select("id", F.size("embedding").cast("bigint").alias("n")))
on_both("lookup_embeddings", "SELECT vid AS id, len(embedding) AS n FROM vec SEMI JOIN (SELECT id FROM items WHERE saved) s ON s.id = vid")(lambda i, v: v.join(i.where("saved").select("id"), "id", "left_semi").select("id", F.size("embedding").cast("bigint").alias("n")))
on_both("scan_with_embeddings", f"SELECT id FROM items SEMI JOIN vec ON vid = id WHERE published > {T} - INTERVAL 1 DAY ORDER BY published DESC, pos LIMIT 500")(lambda i, v: ids(i.join(v.select("id"), "id", "left_semi").where(c("published") > now() - F.expr("INTERVAL 1 DAY")).orderBy(F.desc("published"), "pos").limit(500)))
on_both("search_pool", "SELECT id, vid IS NOT NULL AS has_embedding FROM (SELECT * FROM items ORDER BY published DESC, pos LIMIT 10000) LEFT JOIN vec ON vid = id")(lambda i, v: i.orderBy(F.desc("published"), "pos").limit(10000).join(v, "id", "left").select("id", c("embedding").isNotNull().alias("has_embedding")))

# filters
on_items("filter_by_age", f"SELECT id FROM items WHERE published > {T} - INTERVAL 24 HOUR")(lambda i: ids(i.where(c("published") > now() - F.expr("INTERVAL 24 HOURS"))))
on_items("filter_by_source", "SELECT id FROM items WHERE source_name IN ('src1', 'src7')")(lambda i: ids(i.where(c("source_name").isin("src1", "src7"))))
on_items("filter_unread", f"SELECT id FROM items WHERE published > {T} - INTERVAL 1 HOUR AND NOT read")(lambda i: ids(i.where((c("published") > now() - F.expr("INTERVAL 1 HOUR")) & ~c("read"))))
on_items("select_time", f"SELECT id FROM items WHERE {AGE_SQL} BETWEEN 3600 AND 86400")(lambda i: ids(i.where((age() >= 3600) & (age() <= 86400))))
PRESETS = {"just_now": (0, 900), "past_hour": (0, 3600), "today": (0, 86400), "yesterday": (86400, 172800), "this_week": (0, 604800)}
on_items("select_time_presets", " UNION ALL ".join(f"SELECT '{k}' AS preset, count(*) AS n FROM items WHERE {AGE_SQL} BETWEEN {a} AND {b}" for k, (a, b) in PRESETS.items()))(
    lambda i: i.agg(*(F.count_if((age() >= a) & (age() <= b)).alias(k) for k, (a, b) in PRESETS.items())).unpivot([], list(PRESETS), "preset", "n")
)
on_items("select_and", f"SELECT id FROM items WHERE source_name = 'src3' AND {AGE_SQL} <= 86400")(lambda i: ids(i.where((c("source_name") == "src3") & (age() <= 86400))))
on_items("select_or", f"SELECT id FROM items WHERE source_name = 'src3' OR {AGE_SQL} <= 3600")(lambda i: ids(i.where((c("source_name") == "src3") | (age() <= 3600))))
on_items("select_not", "SELECT id FROM items WHERE NOT (source_name = 'src3')")(lambda i: ids(i.where(~(c("source_name") == "src3"))))
on_items("recent_items", f"SELECT id FROM items WHERE published > {T} - INTERVAL 3 HOUR")(lambda i: ids(i.where(c("published") > now() - F.expr("INTERVAL 3 HOURS"))))
on_items("exclude_item", "SELECT id FROM items WHERE id <> '5'")(lambda i: ids(i.where("id <> '5'")))
RULES = "(1, 'tions', 'highlight', '(?i)tion', true), (2, 'wide', 'hide', 'ciónm', true), (3, 'off', 'hide', 't', false)"
on_items(
    "curation_filter",
    "SELECT pos, CASE WHEN two THEN 'hide' ELSE 'highlight' END AS action, concat_ws(',', CASE WHEN one THEN 'tions' END, CASE WHEN two THEN 'wide' END) AS filters FROM (SELECT pos, regexp_matches(url, '(?i)tion') OR regexp_matches(title, '(?i)tion') OR regexp_matches(summary, '(?i)tion') AS one, contains(url, 'ciónm') OR contains(title, 'ciónm') OR contains(summary, 'ciónm') AS two FROM items) WHERE one OR two",
)(lambda i: rules.curate(i, i.sparkSession.sql(f"SELECT * FROM VALUES {RULES} AS t(rule_id, name, action, pattern, enabled)")))
# projections and scalar functions
on_items("project_item", "SELECT pos, substr(sha256(id), 1, 16) AS id, CASE WHEN length(summary) > 500 THEN substr(summary, 1, 497) || '...' ELSE summary END AS summary, 'a' AS author FROM items")(
    lambda i: src.from_records(i.select("pos", "id", c("source_name").alias("source"), "title", F.lit("").alias("summary"), c("summary").alias("content"), "url", F.lit("").alias("author"), F.array(F.lit("a"), F.lit("b")).alias("authors"), "published", "fetched")).select(c("id"), "summary", "author").join(i.select(tx.item_id(c("id")).alias("id"), "pos"), "id").select("pos", "id", "summary", "author")
)
SPACE = r"'[\t\n\f\r ]+', ' ', 'g'"
on_items("project_embed_text", f"SELECT pos, CASE WHEN rest = '' THEN title ELSE title || ' ' || rest END AS t FROM (SELECT pos, title, CASE WHEN 2000 - length(title) - 1 > 0 THEN substr(trim(regexp_replace(regexp_replace(summary, '<[^>]*>', ' ', 'g'), {SPACE})), 1, 2000 - length(title) - 1) ELSE '' END AS rest FROM items)")(lambda i: i.select("pos", tx.embed_text(c("title"), c("summary")).alias("t")))
on_items("project_doc_text", "SELECT pos, md5(title || ' - ' || summary) AS h FROM items WHERE summary <> ''")(lambda i: i.where("summary <> ''").select("pos", F.md5(tx.document_text(c("title"), c("summary"))).alias("h")))
on_table("sanitize_text", ("pages",), f"SELECT page_id, substr(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), {SPACE})), 1, 300) AS t FROM pages")(lambda p: p.select("page_id", tx.sanitize_text(c("html"), 300).alias("t")))
_clean = "regexp_replace(html, '<[^>]*>', '', 'g')"
for _a, _b in tx.ENTITIES:
    _clean = "replace({}, '{}', '{}')".format(_clean, _a, _b.replace("'", "''"))
on_table("clean_summary", ("pages",), f"SELECT page_id, md5(trim(regexp_replace(trim(regexp_replace({_clean}, {SPACE})), '^Comments', ''))) AS h FROM pages")(lambda p: p.select("page_id", F.md5(tx.clean_summary(c("html"))).alias("h")))
on_table("extract_domain", ("pages",), r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^.*?://', ''), '/.*$', ''), '^www\.', '') AS domain FROM pages")(lambda p: p.select("page_id", tx.extract_domain(c("url")).alias("domain")))
_pre = "|".join(tx.PREFIXES)
on_items("normalize_title", f"SELECT pos, trim(regexp_replace(lower(trim(t)), '^({_pre})', '')) AS t FROM (SELECT pos, CASE pos % 3 WHEN 0 THEN 'BREAKING: ' || title WHEN 1 THEN ' Update: Live: ' || title ELSE title END AS t FROM items)")(
    lambda i: i.select("pos", tx.normalize_title(F.when(c("pos") % 3 == 0, F.concat(F.lit("BREAKING: "), "title")).when(c("pos") % 3 == 1, F.concat(F.lit(" Update: Live: "), "title")).otherwise(c("title"))).alias("t"))
)
_all = "trim(lower(t))"
for _a in tx.PREFIXES_ALL:
    _all = f"trim(regexp_replace({_all}, '^{_a}', ''))"
on_items("normalize_title_v5", f"SELECT pos, trim(regexp_replace({_all}, {SPACE})) AS t FROM (SELECT pos, CASE pos % 2 WHEN 0 THEN 'Breaking: Live:  ' || title ELSE title END AS t FROM items)")(lambda i: i.select("pos", tx.normalize_title_all(F.when(c("pos") % 2 == 0, F.concat(F.lit("Breaking: Live:  "), "title")).otherwise(c("title"))).alias("t")))
on_items("truncate_runes", "SELECT pos, CASE WHEN length(title) > 20 THEN substr(title, 1, 17) || '...' ELSE title END AS t FROM items")(lambda i: i.select("pos", tx.truncate(c("title"), 20).alias("t")))
on_rows("source_abbrev", "name string", "('Reuters'), ('Hacker News Daily'), ('Verylongsinglename'), ('ALongerFirst Word')", "SELECT name, CASE WHEN length(name) > 12 THEN CASE WHEN strpos(name, ' ') BETWEEN 2 AND 10 THEN split_part(name, ' ', 1) ELSE substr(name, 1, 10) || '..' END ELSE name END AS short FROM t")(lambda t: t.select("name", tx.source_abbrev(c("name")).alias("short")))
on_rows("derive_category", "name string, kind string", "('r/golang', 'rss'), ('arXiv cs', 'rss'), ('SEC EDGAR', 'rss'), ('USGS', 'api'), ('Techmeme', 'rss'), ('Mashable', 'rss'), ('Front', 'hn'), ('Paper', 'rss')", "SELECT name, CASE WHEN kind = 'hn' THEN 'tech' ELSE map {'r/golang': 'reddit', 'arXiv cs': 'arxiv', 'SEC EDGAR': 'sec', 'USGS': 'events', 'Techmeme': 'aggregator', 'Mashable': 'viral', 'Paper': 'rss'}[name] END AS category FROM t")(lambda t: t.select("name", tx.derive_category(c("name"), c("kind")).alias("category")))
on_rows("extract_probability", "s string", "('about 67% now'), ('150% or 20%'), ('none'), ('5 percent'), ('0%')", "SELECT s, coalesce(list_filter([x::BIGINT FOR x IN regexp_extract_all(s, '([0-9]+)%', 1)], lambda x: x <= 100)[1], -1)::INT AS p FROM t")(lambda t: t.select("s", tx.extract_probability(c("s")).alias("p")))
on_rows("parse_first_price", "s string", "('[0.25, 0.75]'), ('[\"0.4\",\"0.6\"]'), ('bad'), ('[]')", r"""SELECT s, coalesce(TRY_CAST(regexp_extract(s, '^\s*\[\s*"?(-?[0-9]+(\.[0-9]+)?)"?', 1) AS DOUBLE), 0.5) AS p FROM t""")(lambda t: t.select("s", tx.parse_first_price(c("s")).alias("p")))
on_items("is_breaking", f"SELECT pos, {AGE_SQL} / 60 <= 30 AND (source_type = 'de' OR regexp_matches(lower(title), 'breaking|just in|urgent|alert|developing')) AS b FROM items")(lambda i: i.select("pos", tx.is_breaking(c("title"), F.when(c("source_type") == "de", "wire").otherwise("x"), age() / 60).alias("b")))
on_items("contains_word", "SELECT pos, regexp_matches(summary, '(^|[^A-Za-z0-9])the([^A-Za-z0-9]|$)') AS b FROM items")(lambda i: i.select("pos", tx.contains_word(c("summary"), "the").alias("b")))
on_items("slug_id", "SELECT pos, replace(lower(title), ' ', '-') AS t FROM items")(lambda i: i.select("pos", tx.slug_id(c("title")).alias("t")))
on_items("item_id", "SELECT pos, substr(sha256(url), 1, 16) AS t FROM items")(lambda i: i.select("pos", tx.item_id(c("url")).alias("t")))
BAND = f"CASE WHEN {AGE_SQL} < 900 THEN 'Just Now' WHEN {AGE_SQL} < 3600 THEN 'Past Hour' WHEN {AGE_SQL} < 86400 THEN 'Today' WHEN {AGE_SQL} < 172800 THEN 'Yesterday' ELSE 'Older' END"
on_items("time_band", f"SELECT pos, {BAND} AS band FROM items")(lambda i: i.select("pos", sc.time_band(age()).alias("band")))
_w = lambda n, u: f"CAST(CAST(floor({AGE_SQL} / {n}) AS BIGINT) AS VARCHAR) || '{u}'"
on_items("age_short", f"SELECT pos, CASE WHEN {AGE_SQL} < 60 THEN 'just now' WHEN {AGE_SQL} < 3600 THEN {_w(60, 'm ago')} WHEN {AGE_SQL} < 86400 THEN {_w(3600, 'h ago')} ELSE {_w(86400, 'd ago')} END AS t FROM items")(lambda i: i.select("pos", sc.age_short(age()).alias("t")))
on_items("age_weeks", f"SELECT pos, CASE WHEN {AGE_SQL} < 60 THEN 'now' WHEN {AGE_SQL} < 3600 THEN {_w(60, 'm')} WHEN {AGE_SQL} < 86400 THEN {_w(3600, 'h')} WHEN {AGE_SQL} < 604800 THEN {_w(86400, 'd')} ELSE {_w(604800, 'w')} END AS t FROM items")(lambda i: i.select("pos", sc.age_weeks(age()).alias("t")))
on_log("dur_precision", "SELECT seq, CASE WHEN dur_ms >= 100 THEN 0 WHEN dur_ms >= 1 THEN 1 ELSE 2 END AS p FROM log")(lambda e: e.select("seq", sc.dur_precision(c("dur_ms")).alias("p")))
on_log("clamp", "SELECT seq, least(greatest(dur_ms / 50, 0.0), 1.0) AS v FROM log")(lambda e: e.select("seq", sc.clamp(c("dur_ms") / 50).alias("v")))
on_items("activity_bars", "SELECT source_name, CASE WHEN n >= 10 THEN 4 WHEN n >= 5 THEN 3 WHEN n >= 2 THEN 2 WHEN n >= 1 THEN 1 ELSE 0 END AS bars FROM (SELECT source_name, count(*) AS n FROM items GROUP BY 1)")(lambda i: i.groupBy("source_name").agg(sc.activity_bars(F.count("*")).alias("bars")))
on_log("event_to_json", """SELECT seq, '{"kind":"' || kind || '","level":"' || level || '"}' AS j FROM log""")(lambda e: e.select("seq", F.to_json(F.struct("kind", "level", F.nullif(F.lit(""), F.lit("")).alias("err"))).alias("j")))
on_items("embed_mock", "SELECT pos, [CAST(b + 0.1 AS FLOAT), CAST(b + 0.2 AS FLOAT), CAST(b + 0.3 AS FLOAT)][2] AS v FROM (SELECT pos, (list_sum([ascii(x) FOR x IN string_split(url, '')]) % 97) / 97.0 AS b FROM items)")(lambda i: i.select("pos", models.byte_sum_vector(c("url"))[1].alias("v")))

# aggregations
on_items("count_all", "SELECT count(*) AS n FROM items")(lambda i: i.agg(F.count("*").alias("n")))
on_both("count_needing_embedding", "SELECT count(*) AS n FROM items ANTI JOIN vec ON vid = id")(lambda i, v: i.join(v, "id", "left_anti").agg(F.count("*").alias("n")))
on_both("embedding_coverage", "SELECT round(100.0 * count(vid) / count(*), 1) AS pct FROM items LEFT JOIN vec ON vid = id")(lambda i, v: i.join(v, "id", "left").agg(F.round(F.try_divide(100.0 * F.count("embedding"), F.count("*")), 1).alias("pct")))
on_items("source_histogram", "SELECT source_name, count(*) AS n FROM items GROUP BY 1")(lambda i: i.groupBy("source_name").agg(F.count("*").alias("n")))
HOURS = {"h1": 1, "h6": 6, "h24": 24, "d7": 168, "d30": 720}
on_items("age_histogram", "SELECT " + ", ".join(f"count_if({AGE_SQL} < {h * 3600}) AS {k}" for k, h in HOURS.items()) + " FROM items")(lambda i: i.agg(*(F.count_if(age() < h * 3600).alias(k) for k, h in HOURS.items())))
on_items("newest_oldest", f"SELECT CAST(min({AGE_SQL}) AS BIGINT) AS newest, CAST(max({AGE_SQL}) AS BIGINT) AS oldest FROM items")(lambda i: i.agg(F.min(age()).cast("bigint").alias("newest"), F.max(age()).cast("bigint").alias("oldest")))
on_items("bogus_dates", f"SELECT count_if(year(published) < 2020) AS old, count_if(published > {T} - INTERVAL 100 MINUTE) AS future FROM items")(lambda i: i.agg(F.count_if(F.year("published") < 2020).alias("old"), F.count_if(c("published") > now() - F.expr("INTERVAL 100 MINUTES")).alias("future")))
on_items("source_count_distinct", "SELECT count(DISTINCT source_name) AS n FROM items")(lambda i: i.agg(F.count_distinct("source_name").alias("n")))
on_items("unread_count", "SELECT count(*) AS n FROM items WHERE NOT read")(lambda i: i.where(~c("read")).agg(F.count("*").alias("n")))
on_items("category_stats", "SELECT source_type AS category, sum(n) AS items FROM (SELECT source_type, source_name, count(*) AS n FROM items GROUP BY ALL) GROUP BY 1")(lambda i: i.groupBy("source_type", "source_name").agg(F.count("*").alias("n")).groupBy(c("source_type").alias("category")).agg(F.sum("n").cast("decimal(38,0)").alias("items")))
on_items("source_activity", f"SELECT source_name, count_if({AGE_SQL} < 3600) AS recent, CAST(min({AGE_SQL}) AS BIGINT) AS last FROM items GROUP BY 1")(lambda i: i.groupBy("source_name").agg(F.count_if(age() < 3600).alias("recent"), F.min(age()).cast("bigint").alias("last")))
on_log("event_kind_counts", "SELECT kind, count(*) AS n FROM (SELECT * FROM log ORDER BY seq DESC LIMIT 1024) GROUP BY 1")(lambda e: e.orderBy(F.desc("seq")).limit(1024).groupBy("kind").agg(F.count("*").alias("n")))
on_log("pipeline_overlay_stats", "SELECT count_if(kind = 'click') AS clicks, count_if(kind = 'error') AS errors, count_if(kind = 'signup') AS signups, count(*) AS events FROM log")(lambda e: e.agg(F.count_if(c("kind") == "click").alias("clicks"), F.count_if(c("kind") == "error").alias("errors"), F.count_if(c("kind") == "signup").alias("signups"), F.count("*").alias("events")))
# windows, order and limits
on_items("limit_per_source", "SELECT id FROM items QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY published DESC, pos) <= 5")(lambda i: ids(sampling.limit_per_source(i, 5)))
on_items("source_balance", "SELECT id FROM items QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY pos) <= 10")(lambda i: ids(sampling.first_per_group(i, c("source_name"), 10, ["pos"])))
on_items("interleave_by_source", "SELECT id, round, turn FROM (SELECT id, row_number() OVER (PARTITION BY source_name ORDER BY pos) AS round, min(pos) OVER (PARTITION BY source_name) AS turn FROM items) WHERE round <= 7")(lambda i: ids(sampling.interleave(i, 7), c("round").cast("bigint").alias("round"), "turn"))
SLOTS = {"Just Now": 10, "Past Hour": 20, "Today": 15, "Yesterday": 10, "Older": 5}
slots = lambda: F.create_map(*[F.lit(x) for kv in SLOTS.items() for x in kv])
on_items("allocate_by_band", f"SELECT id FROM (SELECT *, {BAND} AS band FROM items) QUALIFY row_number() OVER (PARTITION BY band ORDER BY pos) <= map {SLOTS}[band]")(lambda i: ids(sampling.first_per_group(i, sc.time_band(age()), F.try_element_at(slots(), c("_g")), ["pos"])))
on_log("tail_n", "SELECT seq, kind FROM log WHERE kind = 'click' ORDER BY seq DESC LIMIT 50")(lambda e: e.where("kind = 'click'").orderBy(F.desc("seq")).limit(50).select("seq", "kind"))
on_log("ring_snapshot", "SELECT seq FROM log ORDER BY seq DESC LIMIT 1024")(lambda e: e.orderBy(F.desc("seq")).limit(1024).select("seq"))
on_log("event_filter", "SELECT seq FROM log WHERE starts_with(kind, 'si') AND level IN ('warn', 'error')")(lambda e: e.where(c("kind").startswith("si") & (F.when(c("level") == "debug", 0).when(c("level") == "info", 1).when(c("level") == "warn", 2).when(c("level") == "error", 3).otherwise(0) >= 2)).select("seq"))
_V = "count(*) OVER (PARTITION BY kind ORDER BY epoch(date_trunc('second', t)) RANGE BETWEEN {} PRECEDING AND {})"
on_log("velocity_rates", f"SELECT seq, round({_V.format(900, 'CURRENT ROW')} / 0.25, 6) AS r15, round({_V.format(3600, 'CURRENT ROW')} / 1.0, 6) AS r1, round({_V.format(21600, 'CURRENT ROW')} / 6.0, 6) AS r6 FROM log")(lambda e: stories.rates(e.select("seq", c("kind").alias("cluster"), c("t").alias("ts"))).select("seq", sc.round6(c("rate15m")).alias("r15"), sc.round6(c("rate1h")).alias("r1"), sc.round6(c("rate6h")).alias("r6")))
on_log("velocity_baseline", f"SELECT seq, round(CASE WHEN n > 0 THEN n / 23.0 ELSE 1.0 END, 6) AS b FROM (SELECT seq, {_V.format(86400, '3601 PRECEDING')} AS n FROM log)")(lambda e: stories.velocity(e.select("seq", c("kind").alias("cluster"), c("t").alias("ts"))).select("seq", sc.round6(c("baseline")).alias("b")))
on_log("consecutive_errors", "SELECT qid AS source, count_if(kind = 'error' AND (good IS NULL OR seq > good)) AS errors FROM (SELECT *, max(CASE WHEN kind <> 'error' THEN seq END) OVER (PARTITION BY qid) AS good FROM log) GROUP BY 1")(lambda e: stories.error_streaks(e.select(c("qid").alias("source"), c("seq").alias("at"), (c("kind") != "error").alias("ok"))))
on_items("sort_chronological", "SELECT id FROM items ORDER BY published DESC, pos")(lambda i: ids(i.orderBy(F.desc("published"), "pos")))
on_items("evict_oldest", "SELECT id FROM items ORDER BY coalesce(published, fetched) DESC, pos LIMIT 400")(lambda i: ids(i.orderBy(F.desc(F.coalesce("published", "fetched")), "pos").limit(400)))
on_items("prune_old", f"SELECT id FROM items WHERE published > {T} - INTERVAL 48 HOUR")(lambda i: ids(i.where(c("published") > now() - F.expr("INTERVAL 48 HOURS"))))
on_log("priority_queue", "SELECT seq FROM log ORDER BY dur_ms DESC, seq LIMIT 64")(lambda e: e.orderBy(F.desc("dur_ms"), "seq").limit(64).select("seq"))
on_log("top_n_scores", "SELECT seq, dur_ms AS score FROM log ORDER BY dur_ms DESC, seq LIMIT 10")(lambda e: e.orderBy(F.desc("dur_ms"), "seq").limit(10).select("seq", c("dur_ms").alias("score")))

# joins and mutations
on_both("join_item_embedding", "SELECT id, coalesce(len(embedding), 0) > 0 AS has_embed FROM items LEFT JOIN vec ON vid = id")(lambda i, v: i.join(v, "id", "left").select("id", F.coalesce(F.size("embedding") > 0, F.lit(False)).alias("has_embed")))
on_both("semi_embedding_restrict", "SELECT vid AS id FROM vec SEMI JOIN (SELECT id FROM items WHERE NOT read) i ON i.id = vid")(lambda i, v: v.join(i.where(~c("read")).select("id"), "id", "left_semi").select("id"))
on_items("anti_merge_by_url", "SELECT id FROM items n WHERE pos >= 500 AND NOT EXISTS (SELECT 1 FROM items o WHERE o.pos < 500 AND o.url = n.url) QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1")(lambda i: ids(dedup.first_by_key(i.where("pos >= 500").join(i.where("pos < 500").select("url"), "url", "left_anti"), c("url"))))
on_items("anti_new_ids", "SELECT id FROM items WHERE pos >= 500")(lambda i: ids(i.join(i.where("pos < 500").select("id"), "id", "left_anti")))
on_items("union_sources", "SELECT id FROM items WHERE source_name = 'src1' UNION ALL SELECT id FROM items WHERE source_name = 'src2'")(lambda i: ids(i.where("source_name = 'src1'").unionByName(i.where("source_name = 'src2'"))))
on_items("upsert_items_v4", "SELECT id, CASE WHEN pos < 300 THEN 'new' ELSE title END AS title, read FROM items")(
    lambda i: i.join(i.where("pos < 300").select("id", F.lit("new").alias("t2")), "id", "full_outer").select("id", F.coalesce("t2", "title").alias("title"), "read")
)
on_items("mark_read", "SELECT id, read OR pos % 7 = 0 AS read FROM items")(lambda i: i.join(i.where("pos % 7 = 0").select("id", F.lit(True).alias("flag")), "id", "left").select("id", F.coalesce("flag", "read").alias("read")))
on_items("mark_saved", "SELECT id, CASE WHEN pos % 11 = 0 THEN false ELSE saved END AS saved FROM items")(lambda i: i.join(i.where("pos % 11 = 0").select("id", F.lit(False).alias("flag")), "id", "left").select("id", F.coalesce("flag", "saved").alias("saved")))
# rankers
R6 = lambda x: F.round(x, 6)
on_items("rank_freshness", f"SELECT pos, round(pow(0.5, greatest({AGE_SQL}, 0) / 3600), 6) AS s FROM items")(lambda i: i.select("pos", R6(sc.freshness(age())).alias("s")))
on_items("rank_source_weight", "SELECT pos, least(coalesce(CASE source_name WHEN 'src1' THEN 3.0 WHEN 'src2' THEN 0.5 END, 1.0) / 2, 1.0)::DOUBLE AS s FROM items")(lambda i: i.select("pos", sc.source_weight(F.when(c("source_name") == "src1", 3.0).when(c("source_name") == "src2", 0.5)).alias("s")))
on_items("rank_diversity", "SELECT pos, round(CASE WHEN n < 3 THEN 1.0 ELSE pow(0.7, n - 3) END, 6) AS s FROM (SELECT pos, row_number() OVER (PARTITION BY source_name ORDER BY pos) - 1 AS n FROM items)")(lambda i: i.select("pos", (F.row_number().over(W.partitionBy("source_name").orderBy("pos")) - 1).alias("n")).select("pos", R6(sc.diversity(c("n"))).alias("s")))
on_items("rank_read_state", "SELECT pos, CASE WHEN read THEN 0.7 ELSE 1.0 END::DOUBLE AS s FROM items")(lambda i: i.select("pos", sc.read_score(c("read")).alias("s")))
default = lambda: [(sc.freshness(age()), 3.0), (sc.source_weight(F.lit(1.0)), 1.5), (sc.breaking_score(c("title"), age()), 2.0), (sc.read_score(c("read")), 0.5)]
_dsql = f"(3 * pow(0.5, {AGE_SQL} / 3600) + 1.5 * 0.5 + 2 * 0.5 + 0.5 * CASE WHEN read THEN 0.7 ELSE 1.0 END) / 7.0"
on_items("rank_composite", f"SELECT pos, round({_dsql}, 6) AS s FROM items")(lambda i: i.select("pos", R6(sc.composite(default())).alias("s")))
on_items("rank_v4", f"SELECT pos, round({_dsql}, 6) AS s FROM items ORDER BY s DESC, pos LIMIT 50")(lambda i: i.select("pos", R6(sc.composite(default())).alias("s")).orderBy(F.desc("s"), "pos").limit(50))
on_items("media_score", f"SELECT pos, round((0.3 * 0.5 + 0.2 * 0.4 + 0.6 * 0.5 + 0.1 * 0.3 + 0.2 * 0.4) * (1 - (1 - 1 / (1 + {AGE_SQL} / 86400)) * 0.8), 6) AS s FROM items")(lambda i: i.select("pos", R6(sc.media_score(age(), F.lit(0.5), F.lit(0.4), F.lit(0.6), F.lit(0.1), F.lit(0.2))).alias("s")))
on_log("glitch_intensity", "SELECT seq, round(CASE WHEN v < 0.4 THEN 0.0 ELSE (v - 0.4) / 0.6 END, 6) AS g FROM (SELECT seq, least(dur_ms / 100, 1.0) AS v FROM log)")(lambda e: e.select("seq", R6(sc.glitch(F.least(c("dur_ms") / 100, F.lit(1.0)), 0.4)).alias("g")))
on_log("velocity_trend", "SELECT qid, CASE WHEN n > 5 THEN 'spiking' WHEN n > 1 THEN 'steady' ELSE 'fading' END AS trend FROM (SELECT qid, count(*) AS n FROM log GROUP BY 1)")(lambda e: e.groupBy("qid").agg(sc.trend(F.count("*")).alias("trend")))
on_rows("story_status", "hit int, miss int", "(1, 0), (2, 0), (4, 0), (4, 1), (9, 2), (1, 3)", "SELECT hit, miss, CASE WHEN miss >= 2 THEN 'fading' WHEN hit >= 4 AND miss = 1 THEN 'sustained' WHEN hit >= 4 THEN 'persistent' WHEN hit >= 2 THEN 'developing' ELSE 'breaking' END AS status FROM t")(lambda t: t.select("hit", "miss", sc.story_status(c("hit"), c("miss")).alias("status")))

# vectors
DOT = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({1} AS DOUBLE[]), CAST({1} AS DOUBLE[]))))"
_seed = ", seed AS (SELECT embedding AS q FROM vec WHERE vid = '3')"
on_both("cosine", f"SELECT vid AS id, round({DOT.format('embedding', 'q')}, 5) AS s FROM vec, seed", _seed)(lambda i, v: v.crossJoin(F.broadcast(v.where("id = '3'").select(c("embedding").alias("q")))).select("id", F.round(sc.cosine_double(c("embedding"), c("q")), 5).alias("s")))
on_both("rank_by_query", f"SELECT id, s IS NOT NULL AS has_embed, coalesce(row_number() OVER (ORDER BY s DESC NULLS LAST, pos), 0) AS place FROM (SELECT id, pos, {DOT.format('embedding', 'q')} AS s FROM items LEFT JOIN (SELECT * FROM vec, seed) ON vid = id) ORDER BY place LIMIT 100", _seed)(
    lambda i, v: ranked_by_query(i, v, "3").orderBy(F.desc_nulls_last("s"), "pos").limit(100).withColumn("place", F.row_number().over(W.orderBy(F.desc_nulls_last("s"), "pos")).cast("bigint")).select("id", c("s").isNotNull().alias("has_embed"), "place")
)
on_both("more_like_this", f"SELECT id FROM items JOIN vec ON vid = id, seed WHERE id <> '3' ORDER BY {DOT.format('embedding', 'q')} DESC, pos LIMIT 20", _seed)(lambda i, v: ids(ranked_by_query(i, v, "3").where("s IS NOT NULL AND id <> '3'").orderBy(F.desc("s"), "pos").limit(20)))
on_both("theta_similarity_join", f"SELECT a.vid::BIGINT AS a, b.vid::BIGINT AS b FROM vec a JOIN vec b ON a.vid::BIGINT < b.vid::BIGINT WHERE CAST({DOT.format('a.embedding', 'b.embedding')} AS FLOAT) > 0.35::FLOAT")(lambda i, v: dedup.similar_pairs(v.select(c("id").cast("bigint").alias("pos"), "embedding"), 0.35).select("a", "b"))


def ranked_by_query(i: DataFrame, v: DataFrame, seed: str) -> DataFrame:
    query = v.where(c("id") == seed).select(c("embedding").alias("q"))
    near = v.crossJoin(F.broadcast(query)).select("id", sc.cosine_double(c("embedding"), c("q")).alias("s"))
    return i.select("id", "pos").join(near, "id", "left")


# duplicates
GREEDY = ", r AS (SELECT -1::BIGINT AS pos, []::VARCHAR[] AS have, true AS kept UNION ALL SELECT k.pos, CASE WHEN list_has_any(r.have, k.keys) THEN r.have ELSE list_concat(r.have, k.keys) END, NOT list_has_any(r.have, k.keys) FROM r JOIN k ON k.pos = r.pos + 1)"
on_items("dedup_url_title", "SELECT pos FROM r WHERE kept AND pos >= 0", f", k AS MATERIALIZED (SELECT pos, list_filter(['u' || url, CASE WHEN title <> '' THEN 't' || trim(regexp_replace(lower(trim(title)), '^({_pre})', '')) END], lambda x: x IS NOT NULL AND x <> 't') AS keys FROM items)" + GREEDY)(lambda i: dedup.dedup_url_title(i).select("pos"))
_all_title = "trim(lower(title))"
for _a in tx.PREFIXES_ALL:
    _all_title = f"trim(regexp_replace({_all_title}, '^{_a}', ''))"
on_items("dedup_v5", "SELECT pos FROM r WHERE kept AND pos >= 0", f", k AS MATERIALIZED (SELECT pos, list_filter(['u' || url, 't' || trim(regexp_replace({_all_title}, {SPACE}))], lambda x: x <> 't') AS keys FROM items)" + GREEDY)(lambda i: dedup.dedup_all_prefixes(i).select("pos"))
on_both(
    "semantic_dedup",
    "SELECT pos FROM r WHERE kept AND pos >= 0",
    f", p AS (SELECT a.vid::BIGINT AS a, b.vid::BIGINT AS b FROM vec a JOIN vec b ON a.vid::BIGINT < b.vid::BIGINT WHERE CAST({DOT.format('a.embedding', 'b.embedding')} AS FLOAT) > 0.35::FLOAT AND a.vid IN (SELECT id FROM items) AND b.vid IN (SELECT id FROM items)), e AS (SELECT a AS pos, 'p' || a || '-' || b AS key FROM p UNION ALL SELECT b, 'p' || a || '-' || b FROM p UNION ALL SELECT pos, 'u' || url FROM items), k AS MATERIALIZED (SELECT pos, list(key) AS keys FROM e GROUP BY 1)" + GREEDY,
)(lambda i, v: dedup.semantic_dedup(i, v, 0.35).select("pos"))
on_items("save_items", "SELECT pos FROM r WHERE kept AND pos >= 0", ", k AS MATERIALIZED (SELECT pos - 300 AS pos, ['i' || id, 'u' || url] AS keys FROM items WHERE pos >= 300), h AS (SELECT list('i' || id) || list('u' || url) AS have FROM items WHERE pos < 300), r AS (SELECT -1::BIGINT AS pos, (SELECT have FROM h) AS have, true AS kept UNION ALL SELECT k.pos, CASE WHEN list_has_any(r.have, k.keys) THEN r.have ELSE list_concat(r.have, k.keys) END, NOT list_has_any(r.have, k.keys) FROM r JOIN k ON k.pos = r.pos + 1)")(lambda i: dedup.save_items(i.where("pos >= 300"), i.where("pos < 300")).select((c("pos") - 300).alias("pos")))
on_items("title_prefix_dedup", "SELECT id FROM items QUALIFY row_number() OVER (PARTITION BY substr(lower(title), 1, 40) ORDER BY pos) = 1 OR title = ''")(lambda i: ids(dedup.first_by_key(i, F.substring(F.lower("title"), 1, 40))))
on_items("simhash_groups")(lambda i: dedup.simhash_groups(i).groupBy("primary").agg(F.count("*").alias("n")))
on_both("ann_groups", None)(lambda i, v: dedup.chained_groups(v.select(c("id").cast("bigint").alias("pos"), "embedding"), 0.68))
on_log("hamming", "SELECT seq, bit_count(xor(seq, seq * 7))::INT AS d FROM log")(lambda e: e.select("seq", tx.hamming(c("seq"), c("seq") * 7).cast("int").alias("d")))
# samplers
on_items("sample_round_robin", "SELECT id FROM (SELECT id, source_name, row_number() OVER (PARTITION BY source_name ORDER BY pos) AS rn FROM items) ORDER BY rn, source_name LIMIT 45")(lambda i: ids(sampling.round_robin(i, 45)))
on_items("sample_recency", "SELECT id FROM items ORDER BY published DESC, pos LIMIT 60")(lambda i: ids(i.orderBy(F.desc("published"), "pos").limit(60)))
on_items("sample_fair_recent", f"SELECT id FROM (SELECT * FROM items WHERE published > {T} - INTERVAL 24 HOUR QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY pos) <= 4) ORDER BY published DESC, pos LIMIT 40")(lambda i: ids(sampling.fair_recent(i, now(), 40, 4)))
on_items("sample_throttled", "SELECT id FROM (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY published DESC, pos) <= 3) ORDER BY published DESC, pos LIMIT 40")(lambda i: ids(sampling.throttled(i, 40)))
on_items("sample_deficit_rr")(lambda i: ids(sampling.scheduled(i, {"src1": 2.0, "src2": 0.5}, 60), "place"))
on_items("sample_weighted_rr")(lambda i: ids(sampling.scheduled(i, {"src1": 2.0, "src2": 0.5}, 60, "weighted"), "place"))
on_log("due_sources_backoff", f"SELECT qid FROM log GROUP BY 1 HAVING epoch({T}) - epoch(max(t)) >= 60 * (5 + least(count_if(kind = 'error') * count_if(kind = 'error'), 30))")(lambda e: e.groupBy("qid").agg(F.max("t").alias("last"), F.count_if(c("kind") == "error").alias("n")).where(sc.seconds(now(), c("last")) >= 60 * (5 + F.least(c("n") * c("n"), F.lit(30)))).select("qid"))

# lexical search
TOK = f"regexp_extract_all(translate(lower({{}}), '{lexical.ACCENTS}', '{lexical.PLAIN}'), '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"


def _bm25(words: list[str], both: bool) -> str:
    tok = ", tok AS (SELECT id, " + ", ".join(TOK.format(x).replace("{{", "{").replace("}}", "}") + f" AS {x}" for x in lexical.WEIGHTS) + " FROM items)"
    count = lambda x, w: f"len(list_filter({x}, lambda y: y = '{w}'))"
    cnt = ", cnt AS (SELECT id, " + " + ".join(f"len({x})" for x in lexical.WEIGHTS) + " AS d, " + ", ".join(f"{' + '.join(f'{v} * {count(x, w)}' for x, v in lexical.WEIGHTS.items())} AS f{k}, {' + '.join(count(x, w) for x in lexical.WEIGHTS)} AS n{k}" for k, w in enumerate(words)) + " FROM tok)"
    st = ", st AS (SELECT count(*) AS n, avg(d) AS mean, " + ", ".join(f"count_if(n{k} > 0) AS df{k}" for k in range(len(words))) + " FROM cnt)"
    score = " + ".join(f"greatest(ln((n - df{k} + 0.5) / (df{k} + 0.5)), 1e-6) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * d / mean))" for k in range(len(words)))
    where = (" AND " if both else " OR ").join(f"n{k} > 0" for k in range(len(words)))
    return f"{tok}{cnt}{st} SELECT id, round(-({score}), 6) AS score FROM cnt, st WHERE {where} ORDER BY -({score}), id LIMIT 50"


SQL["fts_search"] = WITH + _bm25(["tion", "with"], True)
QUERIES["fts_search"] = lambda spark, d: lexical.search(src.items(spark, d), "tion with").select("id", R6(c("score")).alias("score"))
SQL["fts_query_language"] = WITH + _bm25(["los", "und"], False)
QUERIES["fts_query_language"] = lambda spark, d: lexical.search(src.items(spark, d), "los OR und").select("id", R6(c("score")).alias("score"))

# entities, claims, alerts
# the extractors over whole titles and summaries
TEXT = "concat_ws(' ', title, summary)"
whole_text = lambda: F.concat_ws(" ", "title", "summary")
_lit = lambda p: p.replace("'", "''")
_TICKERS = r"(SELECT list_filter(l, lambda x, i: list_position(l, x) = i) FROM (SELECT regexp_extract_all(%s, '\$([A-Z]{1,5}(?:\.[A-Z])?)', 1) AS l))" % TEXT
_COUNTRIES = "list_sort(list_filter([" + ", ".join("CASE WHEN regexp_matches(lower({}), '(^|[^a-z0-9])({})([^a-z0-9]|$)') THEN '{}' END".format(TEXT, "|".join(w.replace(".", r"\.") for w in words), key) for key, words in entities.COUNTRIES.items()) + "], lambda x: x IS NOT NULL))::VARCHAR[]"
_CITED = "coalesce(" + ", ".join(f"nullif(regexp_extract({TEXT}, '{_lit(p)}', 1), '')" for p in entities.ATTRIBUTIONS) + ")"
on_items("items_tickers", f"SELECT pos, {_TICKERS} AS t FROM items")(lambda i: i.select("pos", entities.tickers(whole_text()).alias("t")))
on_items("items_countries", f"SELECT pos, {_COUNTRIES} AS t FROM items")(lambda i: i.select("pos", entities.countries(whole_text()).alias("t")))
on_items("items_attribution", f"SELECT pos, {_CITED} AS a FROM items")(lambda i: i.select("pos", entities.attribution(whole_text()).alias("a")))
on_items("items_entities", f"SELECT pos, 'ticker:' || unnest({_TICKERS}) AS entity_id, 0.9::DOUBLE AS salience FROM items UNION ALL SELECT pos, 'country:' || unnest({_COUNTRIES}), 0.7 FROM items UNION ALL SELECT pos, 'source:' || {_CITED}, 0.5 FROM items WHERE {_CITED} IS NOT NULL")(lambda i: entities.entities(i).select("pos", "entity_id", c("salience").cast("double").alias("salience")))
on_items("items_with_entity", f"SELECT id FROM items WHERE list_contains({_TICKERS}, 'AAPL')")(lambda i: ids(i.join(entities.entities(i).where("entity_id = 'ticker:AAPL'").select("pos"), "pos", "left_semi")))
_ad = lambda field, patterns, flags="": f"regexp_matches(coalesce({field}, ''), '{flags}{_lit('|'.join(f'(?:{p})' for p in patterns))}')"
_ad_words = lambda field: "(" + " OR ".join(f"contains(lower(coalesce({field}, '')), '{_lit(w)}')" for w in rules.AD_WORDS) + ")"
on_items("items_ads", f"SELECT id, trim(coalesce(title, '')) = '' OR {_ad('url', rules.AD_URLS)} OR {_ad('title', rules.AD_TITLES, '(?i)')} OR {_ad_words('title')} OR {_ad_words('summary')} OR " + " OR ".join(f"(coalesce(source_name, '') = '{k}' AND {_ad('url', v)})" for k, v in rules.AD_SOURCES.items()) + " AS blocked FROM items")(lambda i: i.select("id", rules.is_ad(c("title"), c("summary"), c("url"), c("source_name")).alias("blocked")))
_found = lambda kind, k: "regexp_extract_all({}, '{}', {})".format(TEXT, _lit(entities.CLAIMS[kind]).replace("(?id)", "(?i)").replace(r"(?:(?<![\w\s])|\G)", ""), k)
_part = lambda kind, *ks: "(SELECT pos, " + ", ".join(f"unnest({_found(kind, k)}) AS g{k}" for k in ks) + " FROM items)"
_SPEAKER = r"regexp_replace(g1, '^\s+|\s+$', '', 'g')"
on_items("items_claims", f"SELECT pos, 'number' AS kind, g0 AS text, g1 || ' ' || g2 AS value, '' AS speaker FROM {_part('number', 0, 1, 2)} UNION ALL SELECT pos, 'quote', g0, g1, '' FROM {_part('quote', 0, 1)} UNION ALL SELECT pos, 'attribution', g0, g3, {_SPEAKER} FROM {_part('attribution', 0, 1, 2, 3)} UNION ALL SELECT pos, 'denial', g0, g3, {_SPEAKER} FROM {_part('attribution', 0, 1, 2, 3)} WHERE lower(g2) = 'denied' UNION ALL SELECT pos, 'prediction', g0, g2, '' FROM {_part('prediction', 0, 2)}")(lambda i: entities.extract_claims(i).drop("confidence"))
on_rows("extract_number", "s string", "('$1.5 billion'), ('2,500'), ('3 million'), ('none'), ('7 thousand')", "SELECT s, map {'$1.5 billion': 1.5e9, '2,500': 2500.0, '3 million': 3e6, 'none': 0.0, '7 thousand': 7000.0}[s]::DOUBLE AS v FROM t")(lambda t: t.select("s", entities.extract_number(c("s")).alias("v")))
on_rows("detect_conflicts", "grp int, side int, kind string, text string, value string, speaker string", "(1, 1, 'number', 'a', '10 million', ''), (1, 2, 'number', 'b', '20 million', ''), (1, 2, 'number', 'c', '10.5 million', ''), (2, 1, 'attribution', 'd', 'x', 'P'), (2, 2, 'attribution', 'e', 'y', 'P'), (3, 1, 'denial', 'f', 'x', ''), (3, 2, 'quote', 'g', 'y', '')", "SELECT * FROM (VALUES (1, 'factual', 'a', 'b'), (2, 'framing', 'd', 'e'), (3, 'denial', 'f', 'g')) AS v(grp, kind, claim_a, claim_b)")(lambda t: entities.conflicts(t.withColumnRenamed("grp", "group")).withColumnRenamed("group", "grp"))
on_rows("parse_magnitude", "title string", "('M 6.2 - 10 km N of X'), ('M -0.5 - Y'), ('Big one')", "SELECT title, CASE title WHEN 'M 6.2 - 10 km N of X' THEN 6.2 WHEN 'M -0.5 - Y' THEN -0.5 ELSE 0.0 END::DOUBLE AS m FROM t")(lambda t: t.select("title", rules.parse_magnitude(c("title")).alias("m")))
_ALERTS = "(1, 'pattern', 'THE TION', '', 0.0D, true), (2, 'threshold', '', '>=', 6.0D, true), (3, 'pattern', 'e', '', 0.0D, false)"
on_items("alert_check", "SELECT 1 AS alert_id, pos FROM items WHERE contains(lower(CASE WHEN pos % 10 = 0 THEN 'M 6.5 - Z' ELSE title END || ' ' || summary), 'the tion') UNION ALL SELECT 2, pos FROM items WHERE pos % 10 = 0")(
    lambda i: rules.alerts(i.withColumns({"title": F.when(c("pos") % 10 == 0, "M 6.5 - Z").otherwise(c("title")), "source_type": F.when(c("pos") % 10 == 0, "usgs").otherwise("rss")}), i.sparkSession.sql(f"SELECT * FROM VALUES {_ALERTS} AS t(alert_id, kind, pattern, op, value, enabled)"))
)
on_log("top_stories_update", "SELECT qid AS item_id, hit, 29 - last AS miss FROM (SELECT qid, count(DISTINCT dayofmonth(t)) AS hit, max(dayofmonth(t)) - 1 AS last FROM log GROUP BY 1)")(
    lambda e: stories.lifecycle(e.select(c("qid").alias("item_id"), (F.dayofmonth("t") - 1).alias("run")), e.sparkSession.range(30).select(c("id").cast("int").alias("run"), F.timestamp_seconds(c("id") * 86400).alias("at"))).select("item_id", "hit", c("miss").cast("bigint").alias("miss"))
)
item_clusters = lambda i: stories.assign_clusters(i.select("pos", F.unix_seconds("published").alias("at")).join(entities.entities(i).select("pos", "entity_id"), "pos", "left"))
on_items("cluster_assign")(item_clusters)
on_items("items_conflicts")(lambda i: entities.item_conflicts(i, item_clusters(i)))

# composed views
on_items("feed_stats", f"SELECT source_name, count(*) AS n FROM (SELECT source_name FROM items WHERE NOT read AND published > {T} - INTERVAL 24 HOUR QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY published DESC, pos) <= 50) GROUP BY 1")(lambda i: sampling.limit_per_source(i.where(~c("read") & (c("published") > now() - F.expr("INTERVAL 24 HOURS"))), 50).groupBy("source_name").agg(F.count("*").alias("n")))