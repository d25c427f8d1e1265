"""Further queries of the news operators with their SQL; ``catalog`` has the rest."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsmill.functions import models
from newsmill.functions import scores as sc
from newsmill.functions import text as tx
from newsmill.operators import dedup, entities, lexical, rules, sampling, store, stories, top_stories, views
from newsmill.plans import catalog
from newsmill.plans.catalog import AGE_SQL, BAND, DOT, GREEDY, QUERIES, SPACE, SQL, TEXT, VEC, WITH, WITH_LOG, T, age, c, ids, now, on_both, on_items, on_log, on_rows, whole_text
from newsmill.sources import feeds
from newsmill.sources import items as src

R6 = lambda x: F.round(x, 6)
hidden = lambda: c("pos") % 13 == 0
ago = lambda hours: now() - F.expr(f"INTERVAL {hours} HOURS")
AGO = f"{T} - INTERVAL {{}} HOUR"
numbers = lambda n: ", ".join(f"{x:.2f}" for x in n)
#: A query vector of 64 numbers, and its SQL.
QUERY = [round(((k * 37) % 101) / 101 - 0.5, 2) for k in range(64)]
QUERY_SQL = "[" + ", ".join(f"{x}::FLOAT" for x in QUERY) + "]"
SIM = f"CAST({DOT.format('embedding', QUERY_SQL)} AS FLOAT)"

# reads of the older store: hidden items are left out
on_items("scan_items_v4", "SELECT id FROM items WHERE pos % 13 <> 0 ORDER BY published DESC, pos LIMIT 100")(lambda i: ids(store.newest(i, 0, hidden=hidden())))
on_items("scan_since_v4", f"SELECT id FROM items WHERE pos % 13 <> 0 AND published > {AGO.format(9)}")(lambda i: ids(store.since(i, ago(9), hidden())))
on_both("scan_without_embedding_v4", "SELECT id FROM items ANTI JOIN vec ON vid = id WHERE pos % 13 <> 0 ORDER BY published DESC, pos LIMIT 70")(lambda i, v: ids(store.without_vectors(i, v, 70, True, hidden())))
on_both("scan_with_embeddings_v4", f"SELECT id, len(embedding) AS n FROM items JOIN vec ON vid = id WHERE published > {AGO.format(30)} ORDER BY published DESC, pos LIMIT 500")(lambda i, v: store.with_vectors(i, v, ago(30), 0).select("id", F.size("embedding").cast("bigint").alias("n")))
on_both("flags_v4", "SELECT count(*) AS without FROM items ANTI JOIN vec ON vid = id WHERE pos % 13 <> 0")(lambda i, v: store.without_vectors(i, v, 2**31 - 1, hidden=hidden()).agg(F.count("*").alias("without")))

# embeddings: new ones are those of every fifth vector, turned round, and of ids that are no items
NEW_VEC = ", nv AS (SELECT vec_id AS w, CASE WHEN vec_id % 10 = 0 THEN 'x' || vec_id ELSE CAST(vec_id % 400 AS VARCHAR) END AS id, list_reverse(embedding) AS embedding FROM embeddings WHERE vec_id % 5 = 0), last AS (SELECT id, arg_max(embedding, w) AS embedding FROM nv WHERE id IN (SELECT id FROM items) GROUP BY 1)"
new_vectors = lambda v: v.select(c("id").cast("bigint").alias("at"), "embedding").where("at % 5 = 0").select("at", F.when(c("at") % 10 == 0, F.concat(F.lit("x"), c("at").cast("string"))).otherwise((c("at") % 400).cast("string")).alias("id"), F.reverse("embedding").alias("embedding"))
head = lambda df: df.select("id", F.round(c("embedding")[0].cast("double"), 5).alias("first"), F.size("embedding").cast("bigint").alias("n"))
on_both("save_embedding", "SELECT id, round(embedding[1]::DOUBLE, 5) AS first, len(embedding) AS n FROM (SELECT * FROM last UNION ALL SELECT vid, embedding FROM vec WHERE vid NOT IN (SELECT id FROM last))", NEW_VEC)(lambda i, v: head(store.save_vectors(v, new_vectors(v), i)))
on_both("save_embeddings_v4", "SELECT id, round(embedding[1]::DOUBLE, 5) AS first, len(embedding) AS n FROM (SELECT * FROM last UNION ALL SELECT vid, embedding FROM vec WHERE vid NOT IN (SELECT id FROM last))", NEW_VEC)(lambda i, v: head(store.save_vectors(v, new_vectors(v).join(i.select("id"), "id", "left_semi"), i, strict=True)))
on_both("clear_embeddings", "SELECT count(*) AS cleared, 0 AS kept FROM vec")(lambda i, v: (lambda left, n: left.agg(F.lit(n).cast("bigint").alias("cleared"), F.count("*").cast("int").alias("kept")))(*store.clear_vectors(v)))
on_both("embed_backfill", "SELECT id, round([b + 0.1, b + 0.2, b + 0.3][2], 5) AS v FROM (SELECT id, (list_sum([ord(x) FOR x IN string_split(url, '')]) % 97) / 97.0::DOUBLE AS b FROM items ANTI JOIN vec ON vid = id ORDER BY fetched, pos LIMIT 100)")(lambda i, v: store.without_vectors(i, v, 100).select("id", F.round(models.byte_sum_vector(c("url"))[1].cast("double"), 5).alias("v")))
on_both("encode_embedding", "SELECT vid AS id, 4 * len(embedding) AS bytes, round(embedding[3]::DOUBLE, 5) AS third FROM vec")(lambda i, v: v.select("id", tx.encode_vector(c("embedding")).alias("raw")).select("id", F.length("raw").cast("bigint").alias("bytes"), F.round(tx.decode_vector(c("raw"))[2].cast("double"), 5).alias("third")))

# full-text index
TOKENS = " UNION ALL ".join(f"SELECT id, unnest({catalog.TOK.format(k).replace('{{', '{').replace('}}', '}')}) AS term, {w} AS w FROM items@" for k, w in lexical.WEIGHTS.items())
POSTINGS = "SELECT term, id, count(*) AS n, sum(w)::DOUBLE AS weight FROM (" + TOKENS + ") GROUP BY ALL"
some_terms = lambda df: df.where(F.length("term") == 7).groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"), F.sum("weight").alias("weight"))
_TERMS = "SELECT term, sum(n)::BIGINT AS n, count(*) AS docs, sum(weight) AS weight FROM ({}) WHERE length(term) = 7 GROUP BY 1"
on_items("fts_rebuild", _TERMS.replace("{}", POSTINGS.replace("@", "")))(lambda i: some_terms(lexical.rebuilt(lexical.postings(i.limit(0)), i)))
on_items("fts_sync", _TERMS.replace("{}", POSTINGS.replace("@", " WHERE pos % 5 <> 1")))(lambda i: some_terms(lexical.sync_postings(lexical.postings(i.where("pos % 3 <> 0 OR pos % 5 = 1")), i.where("pos % 3 = 0 AND pos % 5 <> 1"), i.where("pos % 5 = 1").select("id"))))
on_items("join_fts_items", "SELECT i.id, n FROM items i JOIN (" + POSTINGS.replace("@", "") + ") p ON p.id = i.id WHERE term = 'tion'")(lambda i: ids(i.join(lexical.postings(i).where("term = 'tion'"), "id"), "n"))

# flags, inserts, status, sessions, analyses
on_items("persist_entities", "SELECT pos % 50 AS item, url FROM items GROUP BY ALL")(lambda i: store.add_new(i.where("pos < 200").select((c("pos") % 50).alias("item"), "url").distinct(), i.select((c("pos") % 50).alias("item"), "url"), ["item", "url"]))
LOGS = ", s AS (SELECT qid AS source, seq AS w, kind <> 'error' AS ok, floor(dur_ms)::BIGINT AS n, CASE WHEN kind = 'error' THEN 'e' || seq ELSE '' END AS err FROM log), good AS (SELECT source, max(CASE WHEN ok THEN w END) AS good FROM s GROUP BY 1), st AS (SELECT s.source, count(*) AS fetches, max(w) AS last_fetch, arg_max(n, w) AS last_items, arg_max(err, w) AS last_error, count_if(NOT ok AND (good IS NULL OR w > good)) AS error_count FROM s JOIN good USING (source) GROUP BY 1)"
fetches = lambda e: e.select(c("qid").alias("source"), c("seq").alias("at"), (c("kind") != "error").alias("ok"), F.floor("dur_ms").alias("n"), F.when(c("kind") == "error", F.concat(F.lit("e"), c("seq").cast("string"))).otherwise("").alias("err"))
QUERIES["update_source_status"] = lambda spark, d: store.source_status(fetches(src.events(spark, d)))
SQL["update_source_status"] = WITH_LOG + LOGS + " SELECT * FROM st"
QUERIES["source_health"] = lambda spark, d: store.source_health(store.source_status(fetches(src.events(spark, d))))
SQL["source_health"] = WITH_LOG + LOGS + " SELECT count(*) AS total, count_if(error_count = 0) AS healthy, count_if(error_count BETWEEN 1 AND 2) AS warning, count_if(error_count >= 3) AS failing FROM st"
QUERIES["source_status"] = lambda spark, d: store.source_status(fetches(src.events(spark, d))).select("source", "last_fetch")
SQL["source_status"] = WITH_LOG + LOGS + " SELECT source, last_fetch FROM st"
# sources by their last event; every ninth was never fetched
TIMED = ", st AS (SELECT qid AS source, CASE WHEN CAST(qid AS BIGINT) % 9 = 0 THEN NULL ELSE max(t) END AS last_fetch, count_if(kind = 'error') AS error_count, CAST(qid AS BIGINT) % 50 * 30 AS refresh FROM log GROUP BY 1)"
timed = lambda e: e.groupBy(c("qid").alias("source")).agg(F.max("t").alias("last"), F.count_if(c("kind") == "error").alias("error_count")).select("source", F.when(c("source").cast("bigint") % 9 == 0, None).otherwise(c("last")).alias("last_fetch"), "error_count", (c("source").cast("bigint") % 50 * 30).alias("refresh"))
MINUTES = f"(epoch({T}) - epoch(last_fetch)) / 60"
for _name, _wait, _backoff in (("due_sources", "900", False), ("source_due_v5", "refresh", False), ("sources_due_aggregator", "refresh", True)):
    QUERIES[_name] = lambda spark, d, w=_wait, b=_backoff: store.due(timed(src.events(spark, d)), now(), F.expr(w), b).select("source")
    SQL[_name] = WITH_LOG + TIMED + f" SELECT source FROM st WHERE last_fetch IS NULL OR {MINUTES} >= {_wait}" + (" + least(error_count * error_count, 30)" if _backoff else "")
on_log("sessions", "SELECT qid AS session_id, max(t) AS ended FROM log WHERE kind <> 'view' GROUP BY 1 ORDER BY ended DESC, session_id LIMIT 1")(lambda e: store.last_session(e.where("kind <> 'view'").groupBy(c("qid").alias("session_id")).agg(F.max("t").alias("ended"))))
QUERIES["save_session_end"] = lambda spark, d: store.end_session(src.events(spark, d).groupBy(c("qid").alias("session_id")).agg(F.min("t").alias("started"), F.max(F.when(c("kind") == "purchase", c("t"))).alias("ended")), "7", now()).agg(F.count_if(c("ended").isNull()).alias("open"))
SQL["save_session_end"] = WITH_LOG + " SELECT count_if(e IS NULL AND qid <> '7') AS open FROM (SELECT qid, max(CASE WHEN kind = 'purchase' THEN t END) AS e FROM log GROUP BY 1)"
ANALYSES = ", a AS (SELECT qid AS item_id, t AS w, seq, CASE WHEN kind = 'view' THEN '' ELSE kind || seq END AS content FROM log)"
analyses = lambda e: e.select(c("qid").alias("item_id"), c("t").alias("at"), "seq", F.when(c("kind") == "view", "").otherwise(F.concat("kind", c("seq").cast("string"))).alias("content"))
for _name, _f, _sql in (
    ("analysis_history", lambda a: store.history(a, "3").select("seq", "content"), "SELECT seq, content FROM a WHERE item_id = '3'"),
    ("analysis_latest", lambda a: store.latest(a).drop("at"), "SELECT item_id, seq, content FROM a QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY w DESC, seq DESC) = 1"),
    ("analysis_content", lambda a: store.latest(a, True).select("item_id", "content"), "SELECT item_id, content FROM a WHERE content <> '' QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY w DESC, seq DESC) = 1"),
    ("analysis_count", lambda a: a.agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("items")), "SELECT count(*) AS n, count(DISTINCT item_id) AS items FROM a"),
    ("save_analysis", lambda a: a.where("seq % 2 = 0").unionByName(a.where("seq % 2 = 1")).groupBy("item_id").agg(F.count("*").alias("n")), "SELECT item_id, count(*) AS n FROM a GROUP BY 1"),
):
    QUERIES[_name] = lambda spark, d, f=_f: f(analyses(src.events(spark, d)))
    SQL[_name] = WITH_LOG + ANALYSES + " " + _sql

# top stories: a cache made of the items
CACHE = ", cache AS (SELECT id AS item_id, title, pos % 7 AS hit, pos % 4 AS miss, published AS first_seen, fetched AS last_seen FROM items)"
cache = lambda i: i.select(c("id").alias("item_id"), "title", (c("pos") % 7).alias("hit"), (c("pos") % 4).alias("miss"), c("published").alias("first_seen"), c("fetched").alias("last_seen"))
on_items("load_top_stories", f"SELECT item_id, hit FROM cache WHERE last_seen > {AGO.format(48)}", CACHE)(lambda i: store.load_top_stories(cache(i), now()).select("item_id", "hit"))
_NEWER = ", fresh AS (SELECT item_id || CASE WHEN hit = 3 THEN 'n' ELSE '' END AS item_id, title, 9 AS hit, 0 AS miss, last_seen AS first_seen, last_seen FROM cache WHERE miss = 1), kept AS (SELECT * FROM cache WHERE last_seen >= " + AGO.format(48) + ")"
newer = lambda k: k.where("miss = 1").select(F.concat("item_id", F.when(c("hit") == 3, "n").otherwise("")).alias("item_id"), "title", F.lit(9).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("miss"), c("last_seen").alias("first_seen"), "last_seen")
on_items("save_top_stories", "SELECT item_id, hit, miss, first_seen FROM kept WHERE item_id NOT IN (SELECT item_id FROM fresh) UNION ALL SELECT f.item_id, f.hit, f.miss, coalesce(k.first_seen, f.first_seen) FROM fresh f LEFT JOIN kept k ON k.item_id = f.item_id", CACHE + _NEWER)(lambda i: store.save_top_stories(cache(i), newer(cache(i)), now()).select("item_id", "hit", "miss", "first_seen"))
STATUS = "CASE WHEN miss >= 2 THEN 'fading' WHEN hit >= 4 AND miss = 1 THEN 'sustained' WHEN hit >= 4 THEN 'persistent' WHEN hit >= 2 THEN 'developing' ELSE 'breaking' END"
LABEL = "CASE status WHEN 'breaking' THEN '● NEW' WHEN 'developing' THEN '◐ EMERGING' WHEN 'persistent' THEN CASE WHEN hit >= 6 THEN '★ MAJOR' ELSE '◉ ONGOING' END WHEN 'sustained' THEN '◑ SUSTAINED' ELSE '○ FADING' END"
ORDER = "CASE status WHEN 'breaking' THEN 0 WHEN 'persistent' THEN 1 WHEN 'sustained' THEN 2 WHEN 'developing' THEN 3 ELSE 4 END, hit DESC, first_seen DESC, item_id"
with_status = lambda k: k.withColumn("status", sc.story_status(c("hit"), c("miss")))
on_items("story_label", f"SELECT item_id, {LABEL} AS label FROM (SELECT *, {STATUS} AS status FROM cache)", CACHE)(lambda i: top_stories.ordered(with_status(cache(i))).select("item_id", "label"))
on_items("story_order", f"SELECT item_id, status, hit, first_seen FROM (SELECT *, {STATUS} AS status FROM cache) ORDER BY {ORDER}", CACHE)(lambda i: top_stories.ordered(with_status(cache(i))).select("item_id", "status", "hit", "first_seen"))
on_items("story_context", f"SELECT 'CURRENT TOP STORIES:' || chr(10) || string_agg(n || '. [' || {LABEL} || '] ' || title || chr(10), '' ORDER BY n) AS text FROM (SELECT *, row_number() OVER (ORDER BY hit DESC, item_id) AS n FROM (SELECT *, {STATUS} AS status FROM cache) WHERE status <> 'fading' AND title <> '' QUALIFY n <= 5)", CACHE)(lambda i: top_stories.context(cache(i)))
on_items("story_cache_list", "SELECT item_id, hit FROM cache ORDER BY hit DESC, last_seen DESC, item_id LIMIT 100", CACHE)(lambda i: cache(i).orderBy(F.desc("hit"), F.desc("last_seen"), "item_id").limit(100).select("item_id", "hit"))
on_items("story_cache_prune", f"SELECT count(*) AS n FROM cache WHERE last_seen >= {AGO.format(24)}", CACHE)(lambda i: store.save_top_stories(cache(i), cache(i).limit(0), now(), 24).agg(F.count("*").alias("n")))
on_items(
    "breathing_top",
    f"SELECT item_id, {LABEL} AS label FROM (SELECT *, {STATUS} AS status FROM (SELECT *, row_number() OVER (ORDER BY tier, hit DESC, item_id) AS place FROM (SELECT * FROM (SELECT *, lower(substr(title, 1, 40)) AS start FROM (SELECT * FROM (SELECT *, 0 AS tier FROM cache WHERE last_seen > {AGO.format(1)} UNION ALL SELECT *, 1 FROM cache WHERE hit >= 3 AND miss <= 2 UNION ALL SELECT *, 2 FROM cache WHERE hit >= 1 AND miss <= 3) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY tier) = 1)) QUALIFY start = '' OR row_number() OVER (PARTITION BY start ORDER BY tier, hit DESC, item_id) = 1)) WHERE tier < 2 OR place <= 3) ORDER BY {ORDER} LIMIT 8",
    CACHE,
)(lambda i: top_stories.breathing(cache(i).where(c("last_seen") > ago(1)), cache(i)).select("item_id", "label"))
QUERIES["breathing_union"], SQL["breathing_union"] = QUERIES["breathing_top"], SQL["breathing_top"]
on_items("join_top_story_items", "SELECT item_id, url FROM cache JOIN items ON id = item_id WHERE hit = 5", CACHE)(lambda i: cache(i).where("hit = 5").join(i.select(c("id").alias("item_id"), "url"), "item_id").select("item_id", "url"))
on_items("top_stories_prompt", "SELECT string_agg(n || '. [' || source_name || '] ' || title, chr(10) ORDER BY n) AS text FROM (SELECT *, row_number() OVER (ORDER BY pos) AS n FROM items QUALIFY n <= 50)")(lambda i: top_stories.prompt(i))
# model texts made of the items: a label, a number and the start of a line of the text
_WORDS = "['breaking', '**TOP story**', 'Dev', 'nothing', '- major thing', 'ongoing now'][1 + (pos % 6)::INT]"
replies = lambda i: i.select(c("pos").alias("reply_id"), F.concat(F.element_at(F.array(*map(F.lit, ["breaking", "**TOP story**", "Dev", "nothing", "- major thing", "ongoing now"])), (c("pos") % 6 + 1).cast("int")), F.lit(" | "), (c("pos") % 70).cast("string"), F.lit("|"), F.substring(F.split_part("summary", F.lit("."), F.lit(2)), 1, 90)).alias("content"))
MAPPED = "CASE pos % 6 WHEN 0 THEN '● NEW' WHEN 1 THEN '◦ NOTED' WHEN 2 THEN '◐ EMERGING' WHEN 4 THEN '◦ NOTED' WHEN 5 THEN '◐ EMERGING' ELSE '' END"
on_items("map_label", f"SELECT pos, {MAPPED} AS label FROM items")(lambda i: replies(i).select(c("reply_id").alias("pos"), top_stories.map_label(F.split_part("content", F.lit("|"), F.lit(1))).alias("label")))
_REASON = "trim(split_part(substr(split_part(summary, '.', 2), 1, 90), chr(10), 1))"
_CLEANED = "CASE WHEN contains({0}, '*') OR octet_length(encode({0})) > 80 OR (octet_length(encode({0})) > 40 AND regexp_matches(lower({0}), '^(according to|reports say|the |a |an )')) OR {0} = '' THEN '' ELSE {0} END"
on_items("clean_reason", f"SELECT pos, {_CLEANED.format('r')} AS reason FROM (SELECT pos, {_REASON} AS r FROM items)")(lambda i: i.select("pos", F.trim(F.split_part(F.substring(F.split_part("summary", F.lit("."), F.lit(2)), 1, 90), F.lit("\n"), F.lit(1))).alias("r")).select("pos", top_stories.clean_reason(c("r"), F.array().cast("array<string>")).alias("reason")))
on_items("top_stories_parse", f"SELECT i.pos AS reply_id, n.id AS item_id, {MAPPED.replace('pos', 'i.pos')} AS label FROM items i JOIN items n ON n.pos + 1 = i.pos % 70 WHERE n.pos < 50 AND i.pos % 6 <> 3 UNION ALL SELECT i.pos, n.id, '◦ NOTED' FROM items i JOIN items n ON n.pos + 1 = i.pos % 70 WHERE false")(lambda i: top_stories.parse(replies(i).where("reply_id % 6 <> 3 AND reply_id % 70 BETWEEN 1 AND 50"), i.where("pos < 50").select((c("pos") + 1).alias("number"), "id", "title", "source_name")).select("reply_id", "item_id", "label"))

# selectors, projections, joins
on_items("apply_selector", f"SELECT id FROM items WHERE source_name = 'src3' AND {AGE_SQL} BETWEEN 0 AND 604800 AND NOT read")(lambda i: ids(i.where((c("source_name") == "src3") & (age() >= 0) & (age() <= 604800) & ~c("read"))))
on_items("select_source", "SELECT id FROM items WHERE source_name IN ('src0', 'src4', 'SRC1')")(lambda i: ids(i.where(c("source_name").isin("src0", "src4", "SRC1"))))
on_items("pipeline_time", f"SELECT id FROM items WHERE published > {AGO.format(6)}")(lambda i: ids(i.where(c("published") > ago(6))))
on_items("pipeline_source", "SELECT id FROM items WHERE source_name IN ('src2', 'src5')")(lambda i: ids(i.where(c("source_name").isin("src2", "src5"))))
MODES = "('src0', 'off', 0.0), ('src1', 'sample', 0.4), ('src2', 'auto', 0.0), ('src3', 'live', 0.0)"
on_items("source_mode", f"SELECT id FROM items LEFT JOIN (VALUES {MODES}) m(s, mode, exposure) ON s = source_name WHERE mode IS NULL OR mode IN ('live', 'auto')")(lambda i: ids(rules.shown(i, i.sparkSession.sql(f"SELECT source_name, if(mode = 'sample', 'off', mode) AS mode, exposure FROM VALUES {MODES} AS t(source_name, mode, exposure)"))))
on_rows("sources_by_mode", "source_name string, mode string, exposure double", MODES.replace("0.0)", "0.0D)").replace("0.4)", "0.4D)"), "SELECT source_name FROM t WHERE mode = 'sample'")(lambda t: t.where("mode = 'sample'").select("source_name"))
SQL["sources_by_mode"] = SQL["sources_by_mode"].replace("D)", ")")
on_items("curation_defaults", "SELECT pos, 'hide' AS action FROM items WHERE " + " OR ".join(f"regexp_matches(coalesce({k}, ''), '(?i){'|'.join(f'(?:{p})' for p in ps)}')" for ps in rules.DEFAULT_PATTERNS.values() for k in ("url", "title", "summary")))(lambda i: rules.curate(i, rules.default_rules(i.sparkSession)).select("pos", "action"))
_FITS = " OR ".join("regexp_matches(coalesce({0}, ''), '{{0}}')".format(k) for k in ("url", "title", "summary"))
_STATS = {"tions": "(?i)tion", "und": " und ", "never": "zzzqqq"}
on_items("curation_stats", " UNION ALL ".join(f"SELECT '{k}' AS name, count_if({_FITS.format(p)}) AS matches FROM items" for k, p in _STATS.items()))(lambda i: rules.rule_stats(i, i.sparkSession.createDataFrame([(k, p, True) for k, p in _STATS.items()], "name string, pattern string, enabled boolean")))
on_items("project_convert_v4", "SELECT id, source_type, title, url, len(coalesce(summary, '')) AS n FROM items")(lambda i: i.select("id", "source_type", "title", "url", F.length(F.coalesce("summary", F.lit(""))).cast("bigint").alias("n")))
on_both("project_headline", f"SELECT id, round(coalesce(CASE WHEN vid IS NOT NULL THEN {SIM} END, 0.5)::DOUBLE, 5) AS semantic, 0.5::DOUBLE AS arousal FROM items LEFT JOIN vec ON vid = id")(lambda i, v: views.headlines(i, v, QUERY).select("id", F.round("factors.semantic", 5).alias("semantic"), c("factors.arousal").alias("arousal")))
PAIRS = f"SELECT b.vid::BIGINT AS pos, a.vid::BIGINT AS near, CAST({DOT.format('a.embedding', 'b.embedding')} AS FLOAT) AS sim FROM vec a JOIN vec b ON a.vid::BIGINT < b.vid::BIGINT"
placed = lambda v: v.select(c("id").cast("bigint").alias("pos"), "embedding")
on_both("knn_join", f"SELECT pos, near, place FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY round(sim, 5) DESC, near) AS place FROM ({PAIRS})) WHERE place <= 5")(lambda i, v: dedup.nearest_earlier(placed(v), 5, digits=5).select("pos", "near", c("place").cast("bigint").alias("place")))
on_items("join_categories", "SELECT id, CASE source_type WHEN 'en' THEN 'world' WHEN 'de' THEN 'europe' END AS category FROM items")(lambda i: i.join(F.broadcast(i.sparkSession.sql("SELECT * FROM VALUES ('en', 'world'), ('de', 'europe') AS t(source_type, category)")), "source_type", "left").select("id", "category"))
on_items("join_source_patterns", "SELECT id, source_name = 'src1' AND regexp_matches(url, '/1[0-9]*$') AS fits FROM items")(lambda i: i.join(F.broadcast(i.sparkSession.createDataFrame([("src1", "/1[0-9]*$")], "source_name string, pattern string")), "source_name", "left").select("id", F.when(c("source_name").isNull(), None).otherwise(F.coalesce(F.expr("url rlike pattern"), F.lit(False))).alias("fits")))
RANKED = "SELECT id, pos % 40 AS rank FROM items WHERE pos % 3 = 1"
ranked = lambda i, name: i.where("pos % 3 = 1").select("id", (c("pos") % 40).alias(name))
on_items("join_rerank_order", f"SELECT id, rank FROM items LEFT JOIN ({RANKED}) r USING (id) ORDER BY rank NULLS LAST, published DESC, pos")(lambda i: ids(views.by_rank(i, ranked(i, "rank")), "rank"))
QUERIES["sort_by_relevance"], SQL["sort_by_relevance"] = QUERIES["join_rerank_order"], SQL["join_rerank_order"]
on_items("apply_rerank_scores", f"SELECT id, rank AS score FROM items LEFT JOIN ({RANKED}) r USING (id) ORDER BY rank DESC NULLS LAST, pos")(lambda i: ids(views.by_scores(i, ranked(i, "score")), "score"))
on_items("rerank_topn_policy", "SELECT least(greatest(30, 24 + 10), count(*))::INT AS n FROM items")(lambda i: i.sparkSession.createDataFrame([(views.rerank_count(24, i.count()),)], "n int"))
on_items("merge_prepend", "SELECT id, CASE WHEN pos >= 500 THEN pos ELSE pos + (SELECT max(pos) + 1 FROM (SELECT * FROM items n WHERE pos >= 500 AND NOT EXISTS (SELECT 1 FROM items o WHERE o.pos < 500 AND o.url = n.url) QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1)) END AS pos FROM items n WHERE pos < 500 OR (NOT EXISTS (SELECT 1 FROM items o WHERE o.pos < 500 AND o.url = n.url)) QUALIFY pos < 500 OR row_number() OVER (PARTITION BY url ORDER BY pos) = 1")(lambda i: ids(views.prepend(i.where("pos < 500"), i.where("pos >= 500")), "pos"))
SQL["merge_prepend"] = SQL["merge_prepend"].replace("SELECT id, CASE", "SELECT id, coalesce(CASE").replace("END AS pos FROM items n", "END, pos) AS pos FROM items n")
on_items("merge_url_dedup", "SELECT id FROM items QUALIFY url = '' OR row_number() OVER (PARTITION BY url ORDER BY pos) = 1")(lambda i: ids(dedup.first_by_key(i, c("url"))))
on_items("union_queues", "SELECT source_name, count(*) AS n FROM items WHERE source_name IN ('src1', 'src2', 'src3') GROUP BY 1")(lambda i: i.where("source_name = 'src1'").unionByName(i.where("source_name = 'src2'")).unionByName(i.where("source_name = 'src3'")).groupBy("source_name").agg(F.count("*").alias("n")))
on_items("queue_take", "SELECT id FROM items WHERE source_name = 'src2' ORDER BY pos LIMIT 7")(lambda i: ids(i.where("source_name = 'src2'").orderBy("pos").limit(7)))
on_items("balance_top_stories", "SELECT id FROM (SELECT * FROM items ORDER BY pos LIMIT 60) QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY pos) <= 2")(lambda i: ids(sampling.first_per_group(i.orderBy("pos").limit(60), c("source_name"), 2, ["pos"])))
on_items("allocate_ranked", f"SELECT id FROM (SELECT *, {BAND} AS band, round({catalog._dsql}, 6) AS s FROM items) QUALIFY row_number() OVER (PARTITION BY band ORDER BY s DESC, pos) <= map {catalog.SLOTS}[band]")(lambda i: ids(sampling.first_per_group(i.withColumn("s", R6(sc.composite(catalog.default()))), sc.time_band(age()), F.try_element_at(catalog.slots(), c("_g")), [F.desc("s"), "pos"])))
on_items("shuffle", "SELECT count(*) AS n, count(DISTINCT id) AS ids FROM items")(lambda i: i.orderBy(F.xxhash64(F.lit(7), "id")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")))
on_items("stream_view", "SELECT id FROM (SELECT id, published, pos, row_number() OVER (PARTITION BY source_name ORDER BY pos) AS rn, source_name FROM items) ORDER BY rn, source_name LIMIT 500")(lambda i: ids(sampling.round_robin(i, 500).orderBy(F.desc("published"), "pos")))
on_items("queue_manager", "SELECT source_name, count(*) AS n, min(pos) AS first FROM items GROUP BY 1")(lambda i: i.groupBy("source_name").agg(F.count("*").alias("n"), F.min("pos").alias("first")))

# vectors and scores
on_both("cosine_v4", f"SELECT vid AS id, round({DOT.format('embedding', QUERY_SQL)}, 5) AS s FROM vec")(lambda i, v: v.select("id", F.round(sc.cosine_double(c("embedding"), F.array(*map(F.lit, QUERY))), 5).alias("s")))
on_both("score_threshold", f"SELECT id, round(s::DOUBLE, 5) AS s FROM (SELECT id, {SIM} AS s FROM items JOIN vec ON vid = id) WHERE s >= 0.1::FLOAT")(lambda i, v: views.similarity(i, v, QUERY).where(c("sim") >= F.lit(0.1).cast("float")).orderBy(F.desc("sim")).select("id", F.round(c("sim").cast("double"), 5).alias("s")))
on_both("sort_by_score", f"SELECT id, round(s::DOUBLE, 5) AS score FROM (SELECT id, pos, {SIM} AS s FROM items JOIN vec ON vid = id) ORDER BY score DESC, pos")(lambda i, v: views.similarity(i, v, QUERY).where("sim IS NOT NULL").withColumn("score", F.round(c("sim").cast("double"), 5)).orderBy(F.desc("score"), "pos").select("id", "score"))
QUERIES["sorted_results_v4"], SQL["sorted_results_v4"] = QUERIES["sort_by_score"], SQL["sort_by_score"]
on_both("rerank_buckets", f"SELECT count_if(s >= 0.2) AS high, count_if(s <= -0.2) AS low, count_if(s > -0.2 AND s < 0.2) AS mid FROM (SELECT round({SIM}::DOUBLE, 5) AS s FROM vec)")(lambda i, v: v.select(F.round(sc.cosine(c("embedding"), F.array(*map(F.lit, QUERY))).cast("double"), 5).alias("s")).agg(F.count_if(c("s") >= 0.2).alias("high"), F.count_if(c("s") <= -0.2).alias("low"), F.count_if((c("s") > -0.2) & (c("s") < 0.2)).alias("mid")))
on_both("pair_similarity", f"SELECT (1 + ({DOT.format('a.embedding', 'b.embedding')})) / 2 > 0.5 AS alike, a.vid AS a FROM vec a JOIN vec b ON b.vid::BIGINT = a.vid::BIGINT + 1")(lambda i, v: v.alias("a").join(v.alias("b"), c("b.id").cast("bigint") == c("a.id").cast("bigint") + 1).select(((1 + sc.cosine_double(c("a.embedding"), c("b.embedding"))) / 2 > 0.5).alias("alike"), c("a.id").alias("a")))
on_both("ann_batch_guard", "SELECT vid AS id FROM vec WHERE vid::BIGINT % 5 <> 0")(lambda i, v: ids(dedup.of_one_size(v.select("id", c("id").cast("bigint").alias("pos"), F.when(c("id").cast("bigint") % 5 == 0, F.slice("embedding", 1, 7)).otherwise(c("embedding")).alias("embedding")).withColumn("pos", c("pos") + F.when(F.size("embedding") == 7, 10**6).otherwise(0)))))
on_both("rerank_story_label", f"SELECT id, place, CASE WHEN place < 2 AND s >= 0.8 THEN 'MAJOR' WHEN place < 4 AND s >= 0.6 THEN 'TOP' WHEN s >= 0.5 THEN 'RELEVANT' ELSE 'NOTED' END AS label FROM (SELECT id, s, row_number() OVER (ORDER BY s DESC, id) - 1 AS place FROM (SELECT vid AS id, round((1 + {SIM}::DOUBLE) / 2, 4) AS s FROM vec)) ORDER BY place LIMIT 8")(lambda i, v: views.rerank_stories(v.select("id", F.round((1 + sc.cosine(c("embedding"), F.array(*map(F.lit, QUERY))).cast("double")) / 2, 4).alias("score"))).select("id", c("place").cast("bigint").alias("place"), "label"))
GREEDY_FEED = GREEDY.replace("FROM r JOIN k ON k.pos = r.pos + 1", "FROM r JOIN k ON k.n = r.n + 1").replace("-1::BIGINT AS pos", "0::BIGINT AS n, -1::BIGINT AS pos").replace("SELECT k.pos, CASE", "SELECT k.n, k.pos, CASE")
FEED = ", pool AS (SELECT * FROM items WHERE {where}), p AS (SELECT a.vid::BIGINT AS a, b.vid::BIGINT AS b FROM vec a JOIN vec b ON a.vid::BIGINT < b.vid::BIGINT WHERE CAST(" + DOT.format("a.embedding", "b.embedding") + " AS FLOAT) > {t}::FLOAT AND a.vid IN (SELECT id FROM pool) AND b.vid IN (SELECT id FROM pool)), e AS (SELECT a AS pos, 'p' || a || '-' || b AS key FROM p UNION ALL SELECT b, 'p' || a || '-' || b FROM p UNION ALL SELECT pos, 'u' || url FROM pool), k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pos) AS n, pos, list(key) AS keys FROM e GROUP BY pos)" + GREEDY_FEED
FEED_END = "SELECT id FROM items JOIN (SELECT pos FROM r WHERE kept AND n > 0) USING (pos) QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY published DESC, pos) <= 50"
on_both("feed_view", FEED_END, FEED.format(where=f"NOT read AND published > {AGO.format(24)}", t=0.85))(lambda i, v: ids(views.feed(i, v, ago(24), newest=10_000)))
on_both("feed_view_recent", FEED_END, FEED.format(where=f"NOT read AND published > {AGO.format(1)}", t=0.85))(lambda i, v: ids(views.feed(i, v, ago(1))))
on_both("search_cli", f"SELECT id FROM ({FEED_END.replace('SELECT id FROM items', 'SELECT id, pos, published FROM items')}) LEFT JOIN vec ON vid = id ORDER BY {SIM} DESC NULLS LAST, published DESC, pos LIMIT 10", FEED.format(where=f"published > {AGO.format(24)}", t=0.35))(lambda i, v: ids(views.search(i, v, QUERY, ago(24), 0.35)))
_all_title = catalog._all_title
on_items("feed_view_v5", "SELECT id FROM items JOIN (SELECT pos FROM r WHERE kept AND n > 0) USING (pos) QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY pos) <= 10", f", k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pos) AS n, pos, list_filter(['u' || url, 't' || trim(regexp_replace({_all_title}, {SPACE}))], lambda x: x <> 't') AS keys FROM items WHERE published > {AGO.format(6)})" + GREEDY_FEED)(lambda i: ids(views.balanced_feed(i, ago(6))))
_STAGES = f"pool AS (SELECT * FROM items WHERE NOT read ORDER BY published DESC, pos LIMIT 500), aged AS (SELECT * FROM pool WHERE published > {AGO.format(24)})"
on_both(
    "pipeline_stats",
    f"SELECT 'all' AS stage, count(*) AS n FROM items UNION ALL SELECT 'unread', count(*) FROM items WHERE NOT read UNION ALL SELECT 'day', count(*) FROM items WHERE published > {AGO.format(24)} UNION ALL SELECT 'day_unread', count(*) FROM items WHERE published > {AGO.format(24)} AND NOT read UNION ALL SELECT 'pool', least(500, count(*)) FROM items WHERE NOT read UNION ALL SELECT 'aged', count(*) FROM pool UNION ALL SELECT 'embedded', count(*) FROM pool SEMI JOIN vec ON vid = id UNION ALL SELECT 'deduplicated', count(*) FROM r WHERE kept AND n > 0 UNION ALL SELECT 'capped', count(*) FROM ({FEED_END})",
    FEED.format(where=f"pos IN (SELECT pos FROM items WHERE NOT read ORDER BY published DESC, pos LIMIT 500) AND published > {AGO.format(24)}", t=0.85),
)(lambda i, v: views.stage_counts(i, v, now()))
QUERIES["search_hybrid"] = lambda spark, d: (lambda i, v: lexical.search(i, "tion with").join(catalog.ranked_by_query(i, v, "3"), "id").select("id", R6(c("score")).alias("score"), F.round("s", 5).alias("s")))(src.items(spark, d), src.embeddings(spark, d))
_head, _tail = catalog._bm25(["tion", "with"], True).split(" SELECT id, round", 1)
SQL["search_hybrid"] = WITH + VEC + catalog._seed + _head + f", hits AS (SELECT id, round{_tail}) SELECT id, score, CASE WHEN vid IS NOT NULL THEN round({DOT.format('embedding', 'q')}, 5) END AS s FROM hits LEFT JOIN vec ON vid = id, seed"

# scores
on_items("weight_adjust", "SELECT pos, round(least(greatest(w + CASE WHEN read THEN 0.05 ELSE -0.05 END, 0), 1), 6)::DOUBLE AS w FROM (SELECT pos, read, (pos % 21 / 20.0)::DOUBLE AS w FROM items)")(lambda i: i.select("pos", R6(sc.weight_adjust(c("pos") % 21 / 20.0, c("read"))).alias("w")))
on_items("rank_constant", "SELECT pos, 0.75::DOUBLE AS s FROM items")(lambda i: i.select("pos", sc.composite([(F.lit(0.75), 2.0)]).alias("s")))
_FULL = "(3 * fresh + 1.5 * 0.5 + CASE WHEN n < 3 THEN 1.0 ELSE pow(0.7, n - 3) END + 2 * 0.5 + 0.5 * CASE WHEN read THEN 0.7 ELSE 1.0 END) / 8.0"
on_items("rank_default", f"SELECT pos, round({_FULL}, 6) AS s FROM (SELECT pos, read, pow(0.5, greatest({AGE_SQL}, 0) / 3600) AS fresh, row_number() OVER (PARTITION BY source_name ORDER BY pos) - 1 AS n FROM items)")(lambda i: i.withColumn("n", F.row_number().over(W.partitionBy("source_name").orderBy("pos")) - 1).select("pos", R6(sc.composite([(sc.freshness(age()), 3.0), (sc.source_weight(F.lit(1.0)), 1.5), (sc.diversity(c("n")), 1.0), (F.lit(0.5), 2.0), (sc.read_score(c("read")), 0.5)])).alias("s")))
on_items("ranker_set", f"SELECT pos, round(greatest(fresh, CASE WHEN read THEN 0.7 ELSE 1.0 END), 6) AS best, round(least(fresh, CASE WHEN read THEN 0.7 ELSE 1.0 END), 6) AS worst, round(fresh * CASE WHEN read THEN 0.7 ELSE 1.0 END, 6) AS product FROM (SELECT pos, read, pow(0.5, greatest({AGE_SQL}, 0) / 3600) AS fresh FROM items)")(lambda i: (lambda p: i.select("pos", *(R6(sc.composite(p, how)).alias(name) for how, name in (("max", "best"), ("min", "worst"), ("product", "product")))))([(sc.freshness(age()), 1.0), (sc.read_score(c("read")), 1.0)]))
on_items("rank_cluster", "SELECT pos, round(CASE WHEN n < 2 THEN 0.5 ELSE 0.5 + 0.5 * (1 - 1.0 / n) END, 6)::DOUBLE AS s FROM (SELECT pos, count(*) OVER (PARTITION BY url) AS n FROM items)")(lambda i: i.select("pos", F.count("*").over(W.partitionBy("url")).alias("n")).select("pos", R6(sc.cluster_score(c("n"))).alias("s")))
on_items("rank_entity", f"SELECT pos, round(CASE WHEN n = 0 THEN 0.5 ELSE 0.5 + 0.4 * (1 - 1.0 / (n + 1)) END, 6)::DOUBLE AS s FROM (SELECT pos, len({catalog._COUNTRIES}) + len({catalog._TICKERS}) AS n FROM items)")(lambda i: i.select("pos", (F.size(entities.countries(whole_text())) + F.size(entities.tickers(whole_text()))).alias("n")).select("pos", R6(sc.entity_score(c("n"))).alias("s")))
on_items("rank_breaking", f"SELECT pos, round(CASE WHEN {AGE_SQL} > 1800 THEN 0.5 WHEN regexp_matches(upper(summary), 'BREAKING|URGENT|DEVELOPING|JUST IN') THEN 0.7 + 0.3 * (1 - {AGE_SQL} / 1800) ELSE 0.5 END, 6) AS s FROM items")(lambda i: i.select("pos", R6(sc.breaking_score(c("summary"), age())).alias("s")))
on_log("age_compact", "SELECT seq, CASE WHEN s < 0 THEN '0ms' WHEN s < 1 THEN CAST(floor(s * 1000)::BIGINT AS VARCHAR) || 'ms' WHEN s < 60 THEN printf('%.1fs', s) ELSE printf('%.0fm', s / 60) END AS t FROM (SELECT seq, (dur_ms - 20) * (seq % 5 + 0.01)::DOUBLE AS s FROM log)")(lambda e: e.select("seq", sc.age_compact((c("dur_ms") - 20) * (c("seq") % 5 + 0.01)).alias("t")))
# text
on_items("sanitize_text_cli", f"SELECT pos, CASE WHEN octet_length(encode(s)) <= 40 THEN length(s) ELSE -1 END AS n FROM (SELECT pos, trim(regexp_replace(regexp_replace(summary, '<[^>]*>', ' ', 'g'), {SPACE})) AS s FROM items)")(lambda i: i.select("pos", F.trim(F.regexp_replace(F.regexp_replace("summary", "<[^>]*>", " "), r"[\t\n\f\r ]+", " ")).alias("s")).select("pos", F.when(F.length(tx.truncate_bytes(c("s"), 40, "", False)) == F.length("s"), F.length("s")).otherwise(-1).cast("bigint").alias("n")))
on_items("truncate_bytes", "SELECT pos, CASE WHEN octet_length(encode(title)) > 30 AND octet_length(encode(title)) = length(title) THEN substr(title, 1, 27) || '...' WHEN octet_length(encode(title)) <= 30 THEN title END AS t FROM items")(lambda i: i.select("pos", F.when((F.octet_length("title") <= 30) | (F.octet_length("title") == F.length("title")), tx.truncate_bytes(c("title"), 30)).alias("t")))
on_items("country_display", f"SELECT DISTINCT k, CASE k {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {chr(39)}{b}{chr(39)}' for a, b in tx.COUNTRY_NAMES.items())} ELSE upper(k[1]) || substr(k, 2) END AS name FROM (SELECT unnest({catalog._COUNTRIES}) AS k FROM items)")(lambda i: i.select(F.explode(entities.countries(whole_text())).alias("k")).distinct().select("k", tx.country_display(c("k")).alias("name")))
on_items("entity_name_format", "SELECT pos, array_to_string([upper(w[1]) || lower(substr(w, 2)) FOR w IN string_split(trim(regexp_replace(replace(source_name || '_' || regexp_replace(substr(title, 1, 30), '[^ -~]', '', 'g'), '_', ' '), '[\\s]+', ' ', 'g')), ' ')], ' ') AS name FROM items")(lambda i: i.select("pos", tx.entity_display(F.concat("source_name", F.lit("_"), F.regexp_replace(F.substring("title", 1, 30), "[^ -~]", ""))).alias("name")))
on_items("context_snippet", "SELECT pos, CASE WHEN p = 0 THEN '' ELSE trim(substr(summary, greatest(p - 50, 1)::BIGINT, (p + 54 - greatest(p - 50, 1))::BIGINT)) END AS t FROM (SELECT pos, summary, strpos(lower(summary), 'tion') AS p FROM items)")(lambda i: i.select("pos", tx.context_snippet(c("summary"), F.lit("tion")).alias("t")))
on_items("trim_line", "SELECT pos, length(regexp_replace(summary || chr(13) || chr(10), '[\\r\\n]+$', '')) AS n FROM items")(lambda i: i.select("pos", F.length(tx.trim_line(F.concat("summary", F.lit("\r\n")))).cast("bigint").alias("n")))
on_log("format_event", "SELECT seq, strftime(t, '%H:%M:%S.%g') || ' ' || rpad(upper(level), 5, ' ') || ' [' || rpad('', 6, ' ') || '] ' || rpad(kind, 22, ' ') || CASE WHEN dur_ms > 0 THEN ' (' || CASE WHEN dur_ms >= 100 THEN printf('%.0f', dur_ms) WHEN dur_ms >= 1 THEN printf('%.1f', dur_ms) ELSE printf('%.2f', dur_ms) END || 'ms)' ELSE '' END || ' src=' || qid AS line FROM log")(lambda e: e.select("seq", tx.format_event(c("t"), c("level"), F.lit(""), c("kind"), F.lit(""), c("dur_ms"), F.lit(0), c("qid"), F.lit(""), F.lit("")).alias("line")))
_SCORES = "('Yes.'), ('no way'), ('no-one knows'), ('score7'), ('y-axis 0.2'), ('1e-1'), ('<think>a</think> no <b></think> yes'), ('maybe'), ('0.73 or so'), ('score 7'), ('<think>no</think>yes'), ('nothing'), (''), ('-3 below'), ('TRUE!'), ('about .5')"
_NUMBER = "[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?"
on_rows("parse_score_text", "s string", _SCORES, f"SELECT s, CASE WHEN w IN ('yes', 'y', 'true') THEN 1.0 WHEN w IN ('no', 'n', 'false') THEN 0.0 WHEN w IN ('maybe', 'unclear', 'uncertain') THEN 0.5 WHEN x IS NULL THEN 0.5 ELSE least(greatest(x, 0), 1) END::DOUBLE AS v FROM (SELECT s, rtrim(lower(string_split_regex(r, '\\s+')[1]), '.,!?') AS w, TRY_CAST(nullif(trim(regexp_extract(' ' || r, '\\s({_NUMBER})', 1)), '') AS DOUBLE) AS x FROM (SELECT s, ltrim(CASE WHEN contains(s, '</think>') THEN substr(s, strpos(s, '</think>') + 8) ELSE s END) AS r FROM t))")(lambda t: t.select("s", tx.parse_score(c("s")).cast("double").alias("v")))
on_rows("parse_score_v4", "s string", "('7'), ('Score: 8/10'), ('0.4'), ('about 9, maybe'), ('none'), ('-2'), ('15'), ('')", "SELECT s, greatest(least(CASE WHEN x > 1 THEN x / 10 ELSE x END, 1), 0)::DOUBLE AS v FROM (SELECT s, coalesce(list_filter([TRY_CAST(regexp_replace(regexp_replace(w, '/10$', ''), '[.,]$', '') AS DOUBLE) FOR w IN string_split_regex(trim(s), '\\s+')], lambda y: y IS NOT NULL)[1], 0) AS x FROM t)")(lambda t: t.select("s", tx.parse_score_tenths(c("s")).alias("v")))
on_items("are_duplicates", "SELECT pos, (64 - bit_count(xor(pos * 7919, pos * 7927))) / 64.0 >= 0.8 AS dup FROM items")(lambda i: i.select("pos", ((64 - tx.hamming(c("pos") * 7919, c("pos") * 7927)) / 64.0 >= 0.8).alias("dup")))
FNV = "list_reduce(list_prepend(2166136261::BIGINT, [ord(x)::BIGINT FOR x IN string_split(url, '')]), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"
on_items("fnv32a", f"SELECT pos, {FNV} AS h FROM items")(lambda i: i.select("pos", tx.fnv32a(c("url")).alias("h")))
GRAMS = "[list_reduce(list_prepend(5::BIGINT, [ord(x)::BIGINT FOR x IN string_split(w[k] || ' ' || w[k + 1] || ' ' || w[k + 2], '')]), lambda h, b: (h * 33 + b) % 64) FOR k IN range(1, greatest(len(w) - 1, 1))]"
HASHED = f", hashed AS MATERIALIZED (SELECT pos, coalesce(list_sum([(1::HUGEINT << b::INT) FOR b IN list_distinct({GRAMS})]), 0)::HUGEINT AS u FROM (SELECT pos, list_filter(string_split_regex(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), ' +'), lambda x: x <> '') AS w FROM items))"
SIGNED = "(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT"
on_items("simhash_stats", f"SELECT count(*) AS hashes, count(DISTINCT u) AS groups FROM hashed", HASHED)(lambda i: i.select(tx.simhash(c("title")).alias("h")).agg(F.count("*").alias("hashes"), F.count_distinct("h").alias("groups")))
on_items("simhash", f"SELECT pos, {SIGNED} AS h FROM hashed", HASHED)(lambda i: i.select("pos", tx.simhash(c("title")).alias("h")))

# polls, jobs, velocity
POLLS = "SELECT source_name, 60.0 + pos % 30 AS interval, pos AS w, pos % 4 AS fresh FROM items WHERE pos % 2 = 0"
polls = lambda i: i.where("pos % 2 = 0").select("source_name", (c("pos") % 30 + 60.0).alias("interval"), c("pos").alias("at"), (c("pos") % 4).alias("fresh"))
on_items("queue_stats", f"SELECT source_name, n, interval::DOUBLE AS interval, last_poll, last_new FROM (SELECT source_name, count(*) AS n FROM items GROUP BY 1) LEFT JOIN (SELECT source_name, arg_max(interval, w) AS interval, max(w) AS last_poll, arg_max(fresh, w) AS last_new FROM ({POLLS}) GROUP BY 1) p USING (source_name) UNION ALL SELECT NULL, count(*), NULL, NULL, NULL FROM items")(lambda i: store.queue_stats(i, polls(i)))
on_items("adaptive_poll", f"SELECT source_name, round(list_reduce(list_prepend(120.0::DOUBLE, list(fresh::DOUBLE ORDER BY w)), lambda a, x: CASE WHEN x > 0 THEN greatest(a * 0.7, 30.0) ELSE least(a * 1.5, 900.0) END), 5) AS interval FROM ({POLLS}) GROUP BY 1")(lambda i: store.poll_intervals(polls(i)).select("source_name", F.round("interval", 5).alias("interval")))
JOBS = "SELECT seq, t AS w, CASE kind WHEN 'error' THEN 'failed' WHEN 'click' THEN 'active' WHEN 'signup' THEN 'pending' ELSE 'completed' END AS state FROM log"
jobs = lambda e: e.select("seq", c("t").alias("at"), F.when(c("kind") == "error", "failed").when(c("kind") == "click", "active").when(c("kind") == "signup", "pending").otherwise("completed").alias("state"))
on_log("work_stats", f"SELECT count(*) AS created, count_if(state = 'pending') AS pending, count_if(state = 'active') AS active, count_if(state = 'completed') AS completed, count_if(state = 'failed') AS failed FROM ({JOBS})")(lambda e: store.job_stats(jobs(e)))
on_log("work_history", f"SELECT seq FROM (SELECT * FROM ({JOBS}) WHERE state IN ('completed', 'failed') ORDER BY w DESC, seq DESC LIMIT 100) WHERE state = 'failed'")(lambda e: store.job_history(jobs(e), 100, c("state") == "failed").select("seq"))
on_log("recent_activity", "SELECT seq, kind FROM log ORDER BY t DESC, seq DESC LIMIT 50")(lambda e: store.recent_activity(e.withColumn("at", c("t"))).select("seq", "kind"))
RATES = "SELECT kind AS cluster, t AS ts, seq, (seq % 17)::DOUBLE AS rate1h FROM log"
rates = lambda e: e.select(c("kind").alias("cluster"), c("t").alias("ts"), "seq", (c("seq") % 17).cast("double").alias("rate1h"))
on_log("sparkline", f"SELECT cluster, [round(x / list_max(l), 6) FOR x IN l] AS line FROM (SELECT cluster, list(rate1h ORDER BY ts, seq) AS l FROM (SELECT * FROM ({RATES}) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY ts DESC, seq DESC) <= 24) GROUP BY 1)")(lambda e: store.sparkline(rates(e), 24).select("cluster", F.transform("line", lambda x: F.round(x, 6)).alias("line")))
on_log("current_velocity", f"SELECT cluster, arg_max(rate1h, (ts, seq)) AS rate FROM ({RATES}) GROUP BY 1")(lambda e: rates(e).groupBy("cluster").agg(F.max(F.struct("ts", "seq", "rate1h"))["rate1h"].alias("rate")))
on_log("velocity_range_scan", f"SELECT seq FROM log WHERE kind = 'click' AND t > {T} - INTERVAL 72 HOUR AND t < {T} - INTERVAL 24 HOUR")(lambda e: e.where((c("kind") == "click") & (c("t") > ago(72)) & (c("t") < ago(24))).orderBy("t").select("seq"))
on_log("trace_events", "SELECT qid, count_if(kind = 'click') AS received, count_if(kind = 'purchase') AS handled FROM log GROUP BY 1")(lambda e: e.groupBy("qid").agg(F.count_if(c("kind") == "click").alias("received"), F.count_if(c("kind") == "purchase").alias("handled")))
on_log("velocity_record", f"SELECT seq, (r15 > 2 * b)::INT + (r1 > 2 * b)::INT + (r6 > 2 * b)::INT >= 2 AS spike FROM (SELECT seq, {catalog._V.format(900, 'CURRENT ROW')} / 0.25 AS r15, {catalog._V.format(3600, 'CURRENT ROW')} AS r1, {catalog._V.format(21600, 'CURRENT ROW')} / 6.0 AS r6, CASE WHEN {catalog._V.format(86400, '3601 PRECEDING')} > 0 THEN {catalog._V.format(86400, '3601 PRECEDING')} / 23.0 ELSE 1.0 END AS b FROM log)")(lambda e: stories.velocity(e.select("seq", c("kind").alias("cluster"), c("t").alias("ts"))).select("seq", "spike"))

# entities, clusters, briefings: a cluster is what has one URL, an entity a country or ticker
ENT = f"SELECT pos, unnest(list_concat({catalog._COUNTRIES}, {catalog._TICKERS})) AS entity_id FROM items"
ents = lambda i: i.select("pos", F.explode(F.concat(entities.countries(whole_text()), entities.tickers(whole_text()))).alias("entity_id"))
on_items("top_entities", f"SELECT entity_id, count(*) AS mentions FROM ({ENT}) GROUP BY 1 ORDER BY mentions DESC, entity_id LIMIT 20")(lambda i: views.top_entities(ents(i)))
on_items("extract_entities_ctx", f"SELECT pos, entity_id, strpos(lower({TEXT}), lower(replace(entity_id, '_', ' '))) > 0 AS found FROM items JOIN ({ENT}) USING (pos)")(lambda i: i.join(ents(i), "pos").select("pos", "entity_id", (tx.context_snippet(whole_text(), F.replace(c("entity_id"), F.lit("_"), F.lit(" "))) != "").alias("found")))
assigned = lambda i: i.select("pos", F.min("pos").over(W.partitionBy("url")).alias("cluster"))
CL = f"SELECT cluster, count(*) AS size, min(published) AS first_at, max(published) AS last_at, count_if(published > {AGO.format(1)} AND published <= {T})::DOUBLE AS rate1h FROM (SELECT min(pos) OVER (PARTITION BY url) AS cluster, published FROM items) GROUP BY 1"
on_items("active_clusters", f"SELECT cluster, size, rate1h, CASE WHEN rate1h > 5 THEN 'spiking' WHEN rate1h > 1 THEN 'steady' ELSE 'fading' END AS trend FROM ({CL}) WHERE size >= 2 ORDER BY rate1h DESC, size DESC, cluster LIMIT 10")(lambda i: views.active_clusters(views.clusters_of(assigned(i), i, now())).select("cluster", "size", "rate1h", "trend"))
on_items("cluster_lookup", "SELECT pos, min(pos) OVER (PARTITION BY url) AS cluster, min(pos) OVER (PARTITION BY url) = pos AS is_primary, count(*) OVER (PARTITION BY url) AS size FROM items")(lambda i: assigned(i).join(views.clusters_of(assigned(i), i, now()).select("cluster", "size"), "cluster").select("pos", "cluster", (c("pos") == c("cluster")).alias("is_primary"), "size"))
on_items("briefing", f"SELECT 'cluster' AS kind, CAST(cluster AS VARCHAR) AS name, CASE WHEN rate1h > 5 THEN 5 WHEN rate1h > 2 THEN 4 ELSE 3 END AS importance, size AS n FROM ({CL}) WHERE first_at > {AGO.format(30)} OR size > 3 UNION ALL SELECT 'entity', entity_id, 2, count(*) FROM ({ENT}) SEMI JOIN (SELECT pos FROM items WHERE published > {AGO.format(30)}) r USING (pos) GROUP BY entity_id HAVING count(*) >= 3")(lambda i: views.briefing(views.clusters_of(assigned(i), i, now()), ents(i), i, ago(30), now()))
on_items("radar", f"SELECT * FROM (SELECT 'cluster' AS kind, CAST(cluster AS VARCHAR) AS name, size AS n FROM ({CL}) WHERE size >= 2 ORDER BY rate1h DESC, size DESC, cluster LIMIT 10) UNION ALL SELECT * FROM (SELECT 'entity', entity_id, count(*) AS n FROM ({ENT}) SEMI JOIN (SELECT pos FROM items WHERE published > {AGO.format(60)}) r USING (pos) GROUP BY entity_id ORDER BY n DESC, entity_id LIMIT 20)")(lambda i: views.radar(views.clusters_of(assigned(i), i, now()), ents(i), i, now(), hours=60))
on_items("engine_accessors", "SELECT pos, count(*) OVER (PARTITION BY url) - 1 AS duplicates, min(pos) OVER (PARTITION BY url) = pos AS is_primary FROM items")(lambda i: i.select("pos", (F.count("*").over(W.partitionBy("url")) - 1).alias("duplicates"), (F.min("pos").over(W.partitionBy("url")) == c("pos")).alias("is_primary")))
on_items("dedup_stats", "SELECT count(*) AS indexed, (SELECT count(*) FROM (SELECT url FROM items GROUP BY 1 HAVING count(*) > 1)) AS groups, count(*) - count(DISTINCT url) AS duplicates FROM items")(lambda i: dedup.group_stats(i, "url"))
on_items("alert_pattern", "SELECT pos FROM items WHERE contains(lower(coalesce(title, '') || ' ' || coalesce(summary, '')), 'tion')")(lambda i: rules.alerts(i, i.sparkSession.sql("SELECT 1 AS alert_id, 'pattern' AS kind, 'TION' AS pattern, '' AS op, 0.0D AS value, true AS enabled")).select("pos"))
_QUAKE = lambda i: i.withColumns({"title": F.concat(F.lit("M "), F.format_string("%.1f", (c("pos") % 90) / 10.0 - 1), F.lit(" - x")), "source_type": F.lit("usgs")})
on_items("alert_threshold", "SELECT alert_id, pos FROM (SELECT pos, round((pos % 90) / 10.0 - 1, 1) AS m FROM items) JOIN (VALUES (1, '>', 6.0), (2, '>=', 6.0), (3, '<', 2.0), (4, '<=', 2.0), (5, '==', 4.5), (6, '=', 4.5)) a(alert_id, op, v) ON m > 0 AND CASE op WHEN '>' THEN m > v WHEN '>=' THEN m >= v WHEN '<' THEN m < v WHEN '<=' THEN m <= v ELSE m = v END")(lambda i: rules.alerts(_QUAKE(i), i.sparkSession.sql("SELECT alert_id, 'threshold' AS kind, '' AS pattern, op, cast(v AS double) AS value, true AS enabled FROM VALUES (1, '>', 6.0), (2, '>=', 6.0), (3, '<', 2.0), (4, '<=', 2.0), (5, '==', 4.5), (6, '=', 4.5) AS t(alert_id, op, v)")))
on_items("intake_result", "SELECT count(*) AS total, count_if(title <> '') AS embedded, count(DISTINCT url) AS unique_items, count(*) - count(DISTINCT url) AS duplicates FROM items")(lambda i: i.agg(F.count("*").alias("total"), F.count_if(c("title") != "").alias("embedded"), F.count_distinct("url").alias("unique_items"), (F.count("*") - F.count_distinct("url")).alias("duplicates")))
on_items("aggregator_counters", "SELECT count(*) AS items, least(count(*), 400) AS kept, greatest(count(*) - 400, 0) AS evicted FROM items")(lambda i: i.agg(F.count("*").alias("items")).select("items", F.least(c("items"), F.lit(400).cast("bigint")).alias("kept"), F.greatest(c("items") - 400, F.lit(0).cast("bigint")).alias("evicted")))

# feeds of other services, made of the items
on_items("source_hackernews", "SELECT 'hn-' || pos AS id, title, CASE WHEN pos % 4 = 0 THEN 'https://news.ycombinator.com/item?id=' || pos ELSE url END AS url, source_name AS author FROM (SELECT * FROM items ORDER BY pos LIMIT 50) WHERE title <> ''")(lambda i: feeds.hackernews(i.select("pos", c("pos").alias("id"), "title", F.when(c("pos") % 4 == 0, None).otherwise(c("url")).alias("url"), c("summary").alias("text"), c("source_name").alias("by"), F.unix_seconds("published").alias("time"))).select("id", "title", "url", "author"))
on_items("source_manifold", "SELECT 'manifold-' || id AS id, '\U0001f4c8 ' || title AS title, printf('%.0f%% YES', (pos % 100 + 0.25)::DOUBLE) || CASE WHEN pos % 3 > 0 THEN ' · ' || pos % 3 || ' traders' ELSE '' END || CASE WHEN pos % 5 > 0 THEN ' · M$' || pos % 5 * 10 || ' 24h' ELSE '' END AS summary, 'https://manifold.markets/' || source_name || '/s' || pos AS url FROM (SELECT * FROM items ORDER BY pos LIMIT 50) WHERE title <> '' AND pos % 7 <> 0")(lambda i: feeds.manifold(i.select("pos", "id", c("title").alias("question"), (c("pos") % 7 == 0).alias("isResolved"), ((c("pos") % 100 + 0.25) / 100).alias("probability"), (c("pos") % 3).alias("uniqueBettorCount"), (c("pos") % 5 * 10.0).alias("volume24Hours"), F.lit("").alias("textDescription"), F.unix_millis("published").alias("createdTime"), F.lit(None).cast("string").alias("url"), c("source_name").alias("creatorUsername"), c("source_name").alias("creatorName"), F.concat(F.lit("s"), c("pos").cast("string")).alias("slug"))).select("id", "title", "summary", "url"))
on_items("source_polymarket", "SELECT 'poly-' || id AS id, '\U0001f4ca ' || title AS title, printf('%.0f%% YES', (pos % 100 + 0.25)::DOUBLE) || CASE WHEN pos % 5 > 0 THEN printf(' · $%.0fK 24h volume', (pos % 5)::DOUBLE * 7) ELSE '' END AS summary FROM (SELECT * FROM items ORDER BY pos LIMIT 50) WHERE title <> ''")(lambda i: feeds.polymarket(i.select("pos", "id", c("title").alias("question"), F.concat(F.lit('["'), ((c("pos") % 100 + 0.25) / 100).cast("string"), F.lit('", "0"]')).alias("outcomePrices"), (c("pos") % 5 * 7000).cast("string").alias("volume24hr"), F.lit("").alias("description"), F.lit("x").alias("slug"), c("published").alias("createdAt"))).select("id", "title", "summary"))

# names of the survey for operators that are registered over whole texts
for _old, _new in (("items_tickers", "extract_tickers"), ("items_countries", "extract_countries"), ("items_attribution", "extract_attribution"), ("items_entities", "extract_entities"), ("items_with_entity", "filter_entity"), ("items_ads", "ad_filter"), ("items_claims", "extract_claims")):
    for _names in (QUERIES, SQL, catalog.OF_ITEMS):
        _names[_new] = _names.pop(_old)

# the documents name no country, ticker, speaker or advertiser: every item gets one of the lists' words after its title
MARKS = [a for names in entities.COUNTRIES.values() for a in names] + ["$AAPL rises", "($BRK.B)", "$TSLA$XOM", "US$5", "according to Reuters", "citing The Paper", "officials said", "50% off today", "/deals/", "[ad]"] + list(rules.AD_WORDS)
MARKED = ", marked AS (SELECT * REPLACE (title || ' ' || [" + ", ".join("'" + m.replace("'", "''") + "'" for m in MARKS) + f"][1 + (pos % {len(MARKS)})::INT] AS title) FROM items)"
marked = lambda i: i.withColumn("title", F.concat("title", F.lit(" "), F.element_at(F.array(*map(F.lit, MARKS)), (c("pos") % len(MARKS) + 1).cast("int"))))
for _name in ("extract_tickers", "extract_countries", "extract_attribution", "extract_entities", "filter_entity", "ad_filter", "extract_claims", "country_display", "top_entities", "extract_entities_ctx", "rank_entity", "briefing", "radar", "curation_defaults"):
    QUERIES[_name] = lambda spark, d, f=catalog.OF_ITEMS[_name]: f(marked(src.items(spark, d)))
    SQL[_name] = WITH + MARKED + SQL[_name].removeprefix(WITH).replace("FROM items", "FROM marked")
QUERIES["ad_filter_count"] = lambda spark, d: QUERIES["ad_filter"](spark, d).agg(F.count_if("blocked").alias("blocked"), F.count_if(~c("blocked")).alias("kept"))
SQL["ad_filter_count"] = SQL["ad_filter"].replace(" SELECT id, trim(", ", f AS (SELECT id, trim(", 1) + ") SELECT count_if(blocked) AS blocked, count_if(NOT blocked) AS kept FROM f"
