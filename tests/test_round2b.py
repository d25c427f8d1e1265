"""Feeds, rule tables and duplicate groups on small fixtures."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsmill.functions import models
from newsmill.operators import admin, dedup, entities, top_stories, views
from newsmill.plans import catalog, wider  # noqa: F401
from newsmill.sources import items as src

SMALL = "/root/testdata/sf0.001"
NOW = "2024-05-01 00:00:00"

RSS = """<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>S</title>
<item><title>One &amp; two</title><link>http://a/1</link><description>d1</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0100</pubDate><dc:creator>C D</dc:creator></item>
<item><title>No date</title><link>http://a/2</link><description></description><content:encoded>%s</content:encoded></item></channel></rss>""" % ("x" * 300)
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Three</title><link rel="self" href="http://b/self"/><link href="http://b/3"/><summary>s3</summary><updated>2024-02-03T04:05:06Z</updated><author><name>E F</name></author></entry></feed>"""


def test_rss_and_atom(spark, tmp_path):
    for name, body in {"a.xml": RSS, "b.xml": ATOM, "broken.xml": "<rss><channel><item>", "empty.xml": ""}.items():
        (tmp_path / name).write_text(body)
    got = {r.title: r for r in src.rss(spark, str(tmp_path), NOW).collect()}
    assert set(got) == {"One & two", "No date", "Three"}
    one, none, three = got["One & two"], got["No date"], got["Three"]
    assert (one.source_name, one.url, one.summary, one.author, one.published) == ("a.xml", "http://a/1", "d1", "C D", datetime(2024, 1, 1, 9))
    assert (none.summary, none.author, none.published) == ("x" * 197 + "...", "", datetime(2024, 5, 1))
    assert (three.url, three.summary, three.author, three.published) == ("http://b/3", "s3", "E F", datetime(2024, 2, 3, 4, 5, 6))
    assert one.id == spark.range(1).select(F.substring(F.sha2(F.lit("http://a/1"), 256), 1, 16)).first()[0]


def test_sources_fail_only_together(spark):
    schema = "source_name string, body string"
    bad = [("x", "<rss><chan"), ("y", None), ("z", "")]
    assert src.all_feeds(spark.createDataFrame([*bad, ("b", ATOM)], schema)).count() == 1
    assert src.all_feeds(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError, match="no source"):
        src.all_feeds(spark.createDataFrame(bad, schema))


def test_earthquakes(spark, tmp_path):
    feature = lambda i, kind, sig, **more: {"id": i, "properties": {"mag": 6.25, "place": "near X", "time": 1000, "url": "u", "title": "M 6.3", "type": kind, "sig": sig, **more}, "geometry": {"coordinates": [1, 2, 10.05]}}
    features = [feature("a", "earthquake", 5, alert="red", tsunami=1), feature("b", "quarry blast", 99), feature("c", "explosion", 100, mag=-0.4), {"id": "d", "properties": {"type": "earthquake"}}]
    (tmp_path / "q.json").write_text(json.dumps({"features": features}, indent=1))
    got = {r.id: r for r in src.usgs(spark, str(tmp_path)).collect()}
    assert set(got) == {"usgs-a", "usgs-c", "usgs-d"}
    assert got["usgs-a"].summary == f"Magnitude {6.25:.1f} earthquake near X [ALERT: red] [TSUNAMI WARNING] Depth: {10.05:.1f}km"
    assert got["usgs-c"].summary == "Magnitude -0.4 earthquake near X Depth: 10.1km".replace("10.1", f"{10.05:.1f}")
    assert got["usgs-d"].summary == "Magnitude 0.0 earthquake  Depth: 0.0km" and got["usgs-a"].published == datetime(1970, 1, 1, 0, 0, 1)


def test_event_lines(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"kind": "a", "count": 3, "extra": {"k": "v"}}\n\n   \n{"kind": \n{"kind": "b", "count": "many"}\n{"kind": "c", "unknown": 1}\n')
    got = src.event_log(spark, str(tmp_path)).orderBy("kind").collect()
    assert [(r.kind, r["count"], r.extra) for r in got] == [("a", 3, {"k": "v"}), ("c", None, None)]


def rules_of(spark, rows):
    return spark.createDataFrame(rows, "id string, name string, action string, criteria string, created_at timestamp, enabled boolean, shared boolean, session string")


def test_rules(spark):
    at = lambda d: datetime(2024, 1, d)
    new = spark.createDataFrame([("My Rule", "hide", "c1", at(2), None), ("my rule", "dim", "c2", at(3), "s"), ("Other", "tag", "", at(1), None), ("", "tag", "x", at(1), None), (None, "tag", "y", at(4), None)], "name string, action string, criteria string, created_at timestamp, session string")
    rules = admin.created(rules_of(spark, [("other", "Old", "hide", "z", at(1), False, False, None), ("kept", "Kept", "hide", "z", at(1), False, False, None)]), new)
    assert {(r.id, r.action, r.enabled, r.shared) for r in rules.collect()} == {("my-rule", "dim", True, True), ("other", "tag", True, False), ("", "tag", True, False), ("kept", "hide", False, False)}
    ids = spark.createDataFrame([("kept",), ("kept",), ("nobody",), (None,)], "id string")
    on = admin.switched(rules, "enabled", ids)
    assert [r.enabled for r in on.where("id = 'kept'").collect()] == [True] and on.count() == 4
    assert [r.enabled for r in admin.switched(on, "enabled", ids).where("id = 'kept'").collect()] == [False]
    assert admin.switched(rules, "shared", ids, True).where("shared").count() == 2
    assert [r.id for r in admin.shared_in(rules, "s").collect()] == ["my-rule"] and admin.shared_in(rules, "t").count() == 0
    more = admin.imported(rules, admin.shared_in(rules))
    assert [(r.id, r.shared) for r in more.where("id LIKE '%imported'").collect()] == [("my-rule-imported", False)]
    assert admin.imported(more, admin.shared_in(rules)).count() == 5
    assert [r.id for r in admin.listed(on, True).collect()] == ["kept", "other", "my-rule", ""]


def test_alerts_that_are_there(spark):
    got = admin.default_alerts(spark).collect()
    assert len(got) == 7 and [r.id for r in got if r.enabled] == ["major-earthquake"]
    matches = spark.createDataFrame([("a", "1", datetime(2024, 1, 1), False), ("b", "1", datetime(2024, 1, 2), False), ("a", "2", datetime(2024, 1, 3), False)], "alert_id string, item_id string, at timestamp, dismissed boolean")
    left = admin.dismissed(matches, spark.createDataFrame([("1",), ("1",), ("9",)], "item_id string"))
    assert sorted((r.alert_id, r.item_id, r.dismissed) for r in left.collect()) == [("a", "1", True), ("a", "2", False), ("b", "1", True)]
    assert [r.item_id for r in admin.recent_matches(matches, 2).collect()] == ["2", "1"]


def test_modes_are_kept(spark, tmp_path):
    rows = [("a", "live", 1.0), ("b", "sample", 0.25), ("c", None, None)]
    admin.save_prefs(spark.createDataFrame(rows, admin.PREFS_SCHEMA), f"{tmp_path}/p")
    assert sorted(map(tuple, admin.load_prefs(spark, f"{tmp_path}/p").collect())) == rows


def test_simhash_groups_against_a_loop(spark):
    from newsmill.functions import text as tx

    items = src.items(spark, SMALL)
    hashes = sorted((r.pos, r.h & (2**64 - 1)) for r in items.select("pos", tx.simhash(F.col("title")).alias("h")).collect())
    kept: list[tuple[int, int]] = []
    want = {}
    for pos, h in hashes:
        first = next((p for p, k in kept if k >> 48 == h >> 48 and (k ^ h).bit_count() <= 3), None)
        want[pos] = pos if first is None else first
        if first is None:
            kept.append((pos, h))
    assert {r.pos: r.primary for r in dedup.simhash_groups(items).collect()} == want


def test_groups_and_overlaps(spark):
    items = spark.createDataFrame([(k,) for k in range(5)], "pos bigint")
    groups = spark.createDataFrame([(0, 0), (2, 0), (3, 3)], "pos bigint, root bigint")
    assert sorted(r.pos for r in dedup.primaries(items, groups).collect()) == [0, 1, 3, 4]
    assert {r.pos: r.size for r in dedup.group_sizes(items, groups, 0).collect()} == {0: 2, 1: 0, 2: 2, 3: 1, 4: 0}
    own = spark.createDataFrame([(0, "a"), (0, "a"), (0, "b"), (1, "a"), (2, "c"), (3, None)], "pos bigint, entity_id string")
    got = entities.overlaps(own, items.select("pos", (F.col("pos") % 2).alias("cluster")))
    assert sorted(map(tuple, got.collect())) == [(0, 0, 2), (0, 1, 1), (1, 0, 1), (1, 1, 1), (2, 0, 1)]


def test_story_candidates(spark):
    at = datetime(2024, 1, 1, 12)
    items = spark.createDataFrame([("a", 0, "T", "s" * 400, at), ("b", 1, "T2", "", at), ("c", 2, "T3", None, datetime(2024, 1, 1, 1))], "id string, pos bigint, title string, summary string, published timestamp")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.01])], "id string, embedding array<float>")
    later = lambda text: F.lit(text).cast("timestamp")
    assert [(r.id, r.doc) for r in views.story_candidates(items, vectors, later("2024-01-01 13:00:00")).collect()] == [("a", "T - " + "s" * 296)]
    assert {r.id for r in views.story_candidates(items, vectors.limit(0), later("2024-01-09 13:00:00")).collect()} == {"a", "b", "c"}


def test_rubrics(spark):
    got = spark.createDataFrame([(n,) for n in [*models.RUBRICS, "no such", None]], "n string").select(models.rubric(F.col("n")).alias("t")).collect()
    assert [r.t for r in got] == [*models.RUBRICS.values(), models.RUBRICS["topstories"], models.RUBRICS["topstories"]]


def test_orders(spark):
    items = spark.createDataFrame([("a", 0, datetime(2024, 1, 1)), ("b", 1, datetime(2024, 1, 3)), ("c", 2, datetime(2024, 1, 2)), ("d", 3, datetime(2024, 1, 2))], "id string, pos bigint, published timestamp")
    ranked = spark.createDataFrame([("d", 2), ("a", 1), ("d", 5), ("z", 0)], "id string, rank int")
    assert [r.id for r in views.by_rank(items, ranked).collect()] == ["a", "d", "b", "c"]
    scored = spark.createDataFrame([("c", 0.5), ("d", 0.5), ("b", -1.0)], "id string, score double")
    assert [r.id for r in views.by_scores(items, scored).collect()] == ["c", "d", "b", "a"]
    stories = spark.createDataFrame([("x", "fading", 9, 5), ("y", "breaking", 1, 5), ("z", "persistent", 4, 5), ("w", "persistent", 4, 6), ("v", "developing", 3, 5), ("u", "sustained", 4, 5)], "item_id string, status string, hit bigint, first_seen int")
    assert [r.item_id for r in top_stories.ordered(stories).collect()] == ["y", "w", "z", "u", "v", "x"]
