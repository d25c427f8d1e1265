"""Queries of feeds, rule tables, duplicate groups and claims with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmill.functions import models
from newsmill.operators import admin, dedup, entities, views
from newsmill.operators.staging import folder
from newsmill.plans.catalog import DOT, QUERIES, SQL, T, VEC, WITH, c, item_clusters, now, on_both, on_items, on_log, on_rows
from newsmill.plans.more import HASHED, MARKED, SIGNED, marked
from newsmill.sources import items as src

# feeds: every item is a document of its source, one of three an Atom entry, one of eleven cut off
_XML = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
_TITLE = "'T ' || regexp_replace(title, '[^a-zA-Z0-9<>& ]', '', 'g') || ' end'"
_tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))


def _bodies(i):
    title = _XML(F.concat(F.lit("T "), F.regexp_replace("title", "[^a-zA-Z0-9<>& ]", ""), F.lit(" end")))
    rss = F.concat(_tag("title", title), _tag("link", c("url")), F.when(c("pos") % 2 == 0, _tag("description", F.concat(F.lit("about "), c("id")))).otherwise(_tag("content", F.lit("long " * 60))), F.when(c("pos") % 5 != 0, _tag("pubDate", F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss Z"))).otherwise(F.lit("")))
    atom = F.concat(_tag("title", title), F.lit('<link rel="self" href="x"/><link href="'), c("url"), F.lit('"/>'), _tag("summary", F.concat(F.lit("sum "), c("id"))), F.lit("<author><name>A B</name></author>"), _tag("updated", F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    whole = F.when(c("pos") % 3 == 0, F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry>'), atom, F.lit("</entry></feed>"))).otherwise(F.concat(F.lit("<rss><channel><title>S</title><item>"), rss, F.lit("</item></channel></rss>")))
    return i.select("source_name", F.when(c("pos") % 11 == 0, F.expr("'<rss><channel><item>'")).otherwise(whole).alias("body"))


_RSS = f"SELECT substr(sha256(url), 1, 16) AS id, {_TITLE} AS title, CASE WHEN pos % 3 = 0 THEN 'sum ' || id WHEN pos % 2 = 0 THEN 'about ' || id ELSE @ END AS summary, url, CASE WHEN pos % 3 = 0 THEN 'A B' ELSE '' END AS author, CASE WHEN pos % 3 <> 0 AND pos % 5 = 0 THEN {T} ELSE published END AS published FROM items WHERE pos % 11 <> 0"
_parsed = lambda i: src.feed_items(_bodies(i)).drop("source_name")
_LONG = "left(repeat('long ', 60), 197) || '...'"
on_items("source_rss", _RSS.replace("@", _LONG))(_parsed)
QUERIES["source_rss_v5"], SQL["source_rss_v5"] = QUERIES["source_rss"], SQL["source_rss"]
on_items("source_feeds", f"SELECT source_name, count(*) AS n FROM items WHERE pos % 11 <> 0 GROUP BY 1")(lambda i: src.all_feeds(_bodies(i)).groupBy("source_name").agg(F.count("*").alias("n")))

on_items(
    "source_usgs",
    f"SELECT 'usgs-' || id AS id, title, 'Magnitude ' || printf('%.1f', pos % 90 / 10.0 + 0.05) || ' earthquake near ' || url || CASE WHEN pos % 4 = 0 THEN ' [ALERT: green]' ELSE '' END || CASE WHEN pos % 5 = 1 THEN ' [TSUNAMI WARNING]' ELSE '' END || ' Depth: ' || CASE WHEN pos % 6 = 0 THEN '0.0' ELSE printf('%.1f', pos % 70 / 7.0) END || 'km' AS summary, url, published FROM items WHERE pos % 7 <> 0 OR pos % 200 >= 100",
)(
    lambda i: src.earthquakes(
        i.select(
            F.to_json(
                F.struct(
                    F.array(
                        F.struct(
                            "id",
                            F.struct((c("pos") % 90 / 10.0 + 0.05).alias("mag"), F.concat(F.lit("near "), "url").alias("place"), F.unix_millis("published").alias("time"), "url", "title", F.when(c("pos") % 7 == 0, "quarry blast").otherwise("earthquake").alias("type"), (c("pos") % 200).alias("sig"), F.when(c("pos") % 4 == 0, "green").alias("alert"), (c("pos") % 5).alias("tsunami")).alias("properties"),
                            F.struct(F.when(c("pos") % 6 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0), c("pos") % 70 / 7.0)).alias("coordinates")).alias("geometry"),
                        )
                    ).alias("features")
                )
            ).alias("body")
        )
    )
)

# event log: written as lines and read back, with blank and broken lines between
_sent = lambda e: e.select("t", "level", "kind", "qid", "dur_ms")
_EVENT = "SELECT t, level, kind, qid, dur_ms, 's1' AS session_id FROM log"
_read = lambda lines: src.event_lines(lines).select("t", "level", "kind", "qid", "dur_ms", "session_id")
on_log("emit_event", _EVENT)(lambda e: _read(src.emit(_sent(e), "s1")))


@on_log("source_events_jsonl", _EVENT)
def _lines(e):
    path, n = folder(e.sparkSession), c("seq") % 3
    bad = e.where("seq % 2 = 0").select(F.when(n == 0, "").when(n == 1, '{"kind": "x"').otherwise('{"kind": "x", "count": "many"}').alias("value"))
    src.emit(_sent(e), "s1").union(bad).write.text(path)
    return src.event_log(e.sparkSession, path).select("t", "level", "kind", "qid", "dur_ms", "session_id")


@on_items("source_prefs", "SELECT source_name, CASE WHEN n % 2 = 0 THEN 'sample' ELSE 'live' END AS mode, n % 10 / 10.0::DOUBLE AS exposure FROM (SELECT source_name, count(*) AS n FROM items GROUP BY 1)")
def _prefs(i):
    path = folder(i.sparkSession)
    admin.save_prefs(i.groupBy("source_name").agg(F.count("*").alias("n")).select("source_name", F.when(c("n") % 2 == 0, "sample").otherwise("live").alias("mode"), (c("n") % 10 / 10.0).alias("exposure")), path)
    return admin.load_prefs(i.sparkSession, path)


# rule tables: rules named after items; some names come twice


def _rules(i):
    new = i.select(F.concat(F.lit("Rule "), (c("pos") % 900).cast("string")).alias("name"), F.lit("hide").alias("action"), c("url").alias("criteria"), F.timestamp_seconds(c("pos")).alias("created_at"), F.when(c("pos") % 4 == 0, "s1").alias("session"))
    return admin.created(new.limit(0).select(F.lit("").alias("id"), "name", "action", "criteria", "created_at", F.lit(True).alias("enabled"), F.lit(True).alias("shared"), "session"), new)


def _administered(i):
    rules = _rules(i)
    by = lambda n: rules.where(f"unix_seconds(created_at) % {n} = 0").select("id")
    out = admin.switched(admin.switched(rules, "enabled", by(3)), "shared", by(5), True)
    out = admin.switched(out, "shared", by(8), False)
    return admin.listed(admin.imported(out, admin.shared_in(out, "s1"))).select("id", "enabled", "shared", "criteria")


_RULE_ROWS = "SELECT id, pos % 3 <> 0 AS enabled, (pos % 4 = 0 OR pos % 5 = 0) AND pos % 8 <> 0 AS shared, url AS criteria, pos FROM r JOIN items USING (pos)"
on_items("curation_admin", "SELECT id, enabled, shared, criteria FROM a UNION ALL SELECT id || '-imported', enabled, false, criteria FROM a WHERE shared AND pos % 4 = 0", f", r AS (SELECT 'rule-' || pos % 900 AS id, max(pos) AS pos FROM items GROUP BY 1), a AS ({_RULE_ROWS.replace('SELECT id,', 'SELECT r.id,')})")(_administered)


def _matches(i):
    m = i.where("pos % 3 = 0").select(F.concat(F.lit("a"), (c("pos") % 7).cast("string")).alias("alert_id"), c("id").alias("item_id"), c("published").alias("at"), F.lit(False).alias("dismissed"))
    left = admin.dismissed(m, i.where("saved").select(c("id").alias("item_id")))
    return left.where("NOT dismissed").groupBy("alert_id").agg(F.count("*").alias("undismissed"))


on_items("alert_admin", "SELECT 'a' || pos % 7 AS alert_id, count_if(NOT saved) AS undismissed FROM items WHERE pos % 3 = 0 GROUP BY 1 HAVING count_if(NOT saved) > 0")(_matches)

# duplicate groups
_placed = lambda v: v.select(c("id").cast("bigint").alias("pos"), "embedding")
_NEAR = f", near AS (SELECT a.vid::BIGINT AS up, b.vid::BIGINT AS pos, CAST({DOT.format('a.embedding', 'b.embedding')} AS FLOAT) AS sim FROM vec a JOIN vec b ON a.vid::BIGINT < b.vid::BIGINT), best AS (SELECT pos, up FROM near WHERE (1 + sim) / 2 >= 0.68 QUALIFY row_number() OVER (PARTITION BY pos ORDER BY sim DESC, up) = 1), chain AS (SELECT vid::BIGINT AS pos, vid::BIGINT AS root FROM vec WHERE vid::BIGINT NOT IN (SELECT pos FROM best) UNION ALL SELECT best.pos, chain.root FROM best JOIN chain ON chain.pos = best.up)"
on_both("ann_dedup", "SELECT pos, root FROM chain", _NEAR)(lambda i, v: dedup.chained_groups(_placed(v), 0.68))
QUERIES["ann_groups"], SQL["ann_groups"] = QUERIES["ann_dedup"], SQL["ann_dedup"]
on_both("ann_primary", "SELECT id FROM items JOIN chain USING (pos) WHERE root = pos UNION ALL SELECT id FROM items WHERE id NOT IN (SELECT vid FROM vec)", _NEAR)(lambda i, v: dedup.primaries(i, dedup.chained_groups(_placed(v), 0.68)).select("id"))
on_both("dup_group_size", "SELECT pos, coalesce(n, 1) AS size FROM items LEFT JOIN chain USING (pos) LEFT JOIN (SELECT root, count(*) AS n FROM chain GROUP BY 1) USING (root)", _NEAR)(lambda i, v: dedup.group_sizes(i, dedup.chained_groups(_placed(v), 0.68), 1))
QUERIES["ann_model_twins"], SQL["ann_model_twins"] = QUERIES["ann_primary"], SQL["ann_primary"]
# rows without SQL: the greedy pass over hashes is compared with a loop in the tests
on_items("simhash_dedup")(lambda i: dedup.simhash_groups(i).select("pos", "primary", (c("pos") != c("primary")).alias("duplicate")))
on_items("lsh_bucket_join", f"SELECT DISTINCT a.h AS a, b.h AS b FROM (SELECT DISTINCT u, {SIGNED} AS h FROM hashed) a JOIN (SELECT DISTINCT u, {SIGNED} AS h FROM hashed) b ON a.u >> 48 = b.u >> 48 AND a.h < b.h AND bit_count(xor(a.h, b.h)) <= 3", HASHED)(lambda i: dedup.hash_links(i).select("a", "b"))

# joins of entities and claims
_ENTITIES = f"e AS ({SQL['extract_entities']})"
on_items("entity_overlap_join")(lambda i: entities.overlaps(entities.entities(marked(i)), i.select("pos", (c("pos") % 50).alias("cluster"))))
SQL["entity_overlap_join"] = f"WITH {_ENTITIES}, d AS (SELECT DISTINCT pos, entity_id FROM e) SELECT a.pos, x.cluster, count(*) AS overlap FROM d a JOIN (SELECT DISTINCT entity_id, pos % 50 AS cluster FROM d) x USING (entity_id) GROUP BY 1, 2"
# the documents claim little: every title gets a claim, the even and the odd items of ten are the two sides
_SAID = ", marked AS (SELECT * REPLACE (title || '. The mayor ' || CASE WHEN pos % 7 = 0 THEN 'denied' ELSE 'said' END || ' that ' || pos % 4 || ' million people came' AS title) FROM items)"
_said = lambda i: i.withColumn("title", F.concat("title", F.lit(". The mayor "), F.when(c("pos") % 7 == 0, "denied").otherwise("said"), F.lit(" that "), (c("pos") % 4).cast("string"), F.lit(" million people came")))
_sides = lambda i: entities.extract_claims(i).select(F.floor(c("pos") / 10).alias("group"), (c("pos") % 2 + 1).alias("side"), "kind", "text", "value", "speaker")
_NUMBER = "(coalesce(try_cast(nullif(regexp_extract(regexp_replace({0}, '[$,]', '', 'g'), '^\\s*(-?[0-9]*\\.?[0-9]+)', 1), '') AS DOUBLE), 0) * CASE WHEN contains(lower({0}), 'billion') THEN 1e9 WHEN contains(lower({0}), 'million') THEN 1e6 WHEN contains(lower({0}), 'thousand') THEN 1e3 ELSE 1 END)"
on_items("claims_cross_join")(lambda i: entities.conflicts(_sides(_said(i))))
SQL["claims_cross_join"] = f"""WITH k AS ({SQL['extract_claims'].replace(MARKED, _SAID)}), n AS (SELECT *, CASE WHEN kind = 'number' THEN {_NUMBER.format('value')} ELSE 0 END AS x FROM k)
SELECT a.pos // 10 AS "group", CASE WHEN a.kind = 'number' AND b.kind = 'number' AND a.x <> 0 AND b.x <> 0 AND abs(a.x - b.x) / ((a.x + b.x) / 2) > 0.2 THEN 'factual' WHEN a.kind = 'denial' OR b.kind = 'denial' THEN 'denial' WHEN a.kind = 'attribution' AND b.kind = 'attribution' AND a.speaker = b.speaker AND a.value <> b.value THEN 'framing' END AS kind, a.text AS claim_a, b.text AS claim_b
FROM n a JOIN n b ON b.pos // 10 = a.pos // 10 AND a.pos % 2 = 0 AND b.pos % 2 = 1"""
SQL["claims_cross_join"] = f"SELECT * FROM ({SQL['claims_cross_join']}) WHERE kind IS NOT NULL"

# pairs of items of a cluster, ten items each
on_items("cluster_conflicts")(lambda i: entities.item_conflicts(_said(i), i.select("pos", F.floor(c("pos") / 10).alias("cluster"))))
SQL["cluster_conflicts"] = SQL["claims_cross_join"].replace('AS "group"', "AS cluster, a.pos AS pos_a, b.pos AS pos_b").replace("a.pos % 2 = 0 AND b.pos % 2 = 1", "a.pos < b.pos")

# composed
on_items("correlation_pipeline")(lambda i: views.correlated(marked(i), now()))
on_both("rerank_top_stories", f"SELECT id FROM (SELECT * FROM items WHERE published > {T} - INTERVAL 6 HOUR ORDER BY published DESC, pos LIMIT 200) LEFT JOIN chain USING (pos) WHERE root IS NULL OR root = pos", _NEAR)(lambda i, v: views.story_candidates(i, v, now(), 0.68).select("id"))
on_rows("rubrics", "name string", "('topstories'), ('tech'), ('none')", "SELECT name, CASE name WHEN 'tech' THEN 'Significant technology news' ELSE 'Most important breaking news' END AS starts FROM t")(lambda t: t.select("name", F.regexp_extract(models.rubric(c("name")), "^(Significant technology news|Most important breaking news)", 1).alias("starts")))
