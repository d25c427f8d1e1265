"""Store writes, top stories, feeds and scores on small fixtures."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsmill.functions import scores
from newsmill.functions import text as tx
from newsmill.operators import dedup, lexical, store, top_stories
from newsmill.plans import catalog, more  # noqa: F401
from newsmill.sources import feeds

SMALL = "/root/testdata/sf0.001"


def values(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", f(F.col("s")).alias("v")).collect()
    return [r.v for r in sorted(rows)]


def test_scores_of_model_text(spark):
    cases = {"Yes.": 1.0, "no way": 0.0, "maybe": 0.5, "0.73 or so": 0.73, "score 7": 1.0, "nothing": 0.5, "": 0.5, "no-one knows": 0.5, "score7": 0.5, "y-axis 0.2": 0.2, "1e-1": 0.1, "<think>a</think> no <b></think> yes": 0.0, "-4": 0.0, "TRUE!": 1.0}
    assert [round(v, 6) for v in values(spark, tx.parse_score, cases)] == list(cases.values())
    tenths = {"7": 0.7, "Score: 8/10": 0.8, "0.4": 0.4, "about 9, maybe": 0.9, "none": 0.0, "-2": 0.0, "150": 1.0}
    assert [round(v, 6) for v in values(spark, tx.parse_score_tenths, tenths)] == list(tenths.values())


def test_bytes_are_cut_between_code_points(spark):
    texts = ["", "abc", "abcdefghijkl", "ééééééé", "日本語日本語", "😀😀😀"]
    for n in (6, 7, 8, 9):
        for got, t in zip(values(spark, lambda c: tx.truncate_bytes(c, n, "..", False), texts), texts):  # noqa: B023
            raw = t.encode()
            assert got == (t if len(raw) <= n else raw[:n].decode(errors="ignore") + "..")


def test_names_and_snippets(spark):
    assert values(spark, tx.country_display, ["united_states", "japan", ""]) == ["United States", "Japan", ""]
    assert values(spark, tx.entity_display, ["new_york times", "  x "]) == ["New York Times", "X"]
    got = values(spark, lambda c: tx.context_snippet(c, F.lit("gold"), 5), ["far away GOLD is found", "none", "gold"])
    assert got == ["away GOLD is f", "", "gold"]
    assert values(spark, lambda c: scores.age_compact(c.cast("double")), ["-1", "0.25", "12.34", "160"]) == ["0ms", "250ms", "12.3s", "3m"]


def test_tenths_are_rounded_by_the_exact_value(spark):
    rows = [0.0, 0.05, 0.25, 0.35, 1.0, 6.55, 42.55, 9.95, 9.96, 2.25, 99.949999, 0.15, 7.45]
    got = spark.createDataFrame([(x,) for x in rows], "x double").select("x", scores.tenths(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in got} == {x: f"{x:.1f}" for x in rows}


def test_vectors_as_bytes(spark):
    df = spark.createDataFrame([(0, [1.5, -2.0]), (1, [])], "i int, v array<float>").select("i", tx.encode_vector(F.col("v")).alias("raw"))
    back = df.select("i", tx.decode_vector(F.concat("raw", F.lit(b"xyz"))).alias("v")).collect()
    assert {r.i: r.v for r in back} == {0: [1.5, -2.0], 1: []}


REPLIES = {
    0: "BREAKING | 2 | markets fell\n\nTOP NEWS|1|**bold**\nwhat|3|no label\nDEV|99|no such item",
    1: "Here they are:\n1. **Quake hits the northern coast of the island** - many homes lost\n2. Minister resigns after long talks over budget: a row over money\nplain line",
    2: "Headlines: 3, 1 and (2). Also 77",
    3: "nothing useful",
    4: "developing|3|according to several people who were there at that time",
    5: "major|1|wire one says so",
}


def test_top_stories_are_parsed_three_ways(spark):
    items = spark.createDataFrame([(1, "a", "Quake hits the northern coast of the island", "Wire One"), (2, "b", "Minister resigns after long talks over budget", "Daily"), (3, "c", "Short title", "Blog")], "number int, id string, title string, source_name string")
    replies = spark.createDataFrame(list(REPLIES.items()), "reply_id int, content string")
    got: dict = {}
    for r in sorted(top_stories.parse(replies, items).collect()):
        got.setdefault(r.reply_id, []).append((r.item_id, r.label, r.reason))
    new, emerging, noted = top_stories.NEW, top_stories.EMERGING, top_stories.NOTED
    assert got == {
        0: [("b", new, "markets fell"), ("a", noted, "")],
        1: [("a", new, "many homes lost"), ("b", emerging, "a row over money")],
        2: [("c", noted, ""), ("a", noted, ""), ("b", noted, "")],
        4: [("c", emerging, "")],
        5: [("a", noted, "")],
    }
    assert top_stories.parse(replies.limit(0), items).count() == 0


def test_the_list_of_top_stories_breathes(spark):
    day = datetime(2024, 1, 1)
    schema = "item_id string, title string, hit bigint, miss bigint, first_seen timestamp, last_seen timestamp"
    row = lambda id, title, hit, miss: (id, title, hit, miss, day, day)
    cache = spark.createDataFrame([row("a", "Same title", 5, 0), row("b", "B", 3, 2), row("c", "C", 2, 3), row("d", "D", 1, 4), row("e", "E", 1, 0)], schema)
    now = spark.createDataFrame([row("x", "same TITLE", 1, 0)], schema)
    assert [r.item_id for r in top_stories.breathing(now, cache).collect()] == ["x", "b", "c"]
    assert top_stories.context(cache).first().text.startswith("CURRENT TOP STORIES:\n1. [◉ ONGOING] Same title\n")
    assert top_stories.context(cache.limit(0)).first().text == ""


def test_store_writes(spark):
    items = spark.createDataFrame([("a", "t", False), ("b", "u", True)], "id string, title string, read boolean")
    have = spark.createDataFrame([("a", [1.0])], "id string, embedding array<float>")
    new = spark.createDataFrame([("b", [2.0], 1), ("b", [3.0], 2), ("z", [9.0], 1)], "id string, embedding array<float>, at int")
    assert {r.id: r.embedding for r in store.save_vectors(have, new, items).collect()} == {"a": [1.0], "b": [3.0]}
    with pytest.raises(ValueError, match="unknown"):
        store.save_vectors(have, new, items, strict=True)
    up = store.upsert(items, spark.createDataFrame([("b", "new"), ("c", "add")], "id string, title string"), ["title"])
    assert sorted((r.id, r.title, r.read) for r in up.collect() if r.id != "c") == [("a", "t", False), ("b", "new", True)] and up.count() == 3
    flags = spark.createDataFrame([("a", True), ("q", True)], "id string, value boolean")
    assert {r.id: r.read for r in store.overlay(items, flags, "read").collect()} == {"a": True, "b": True}
    log = spark.createDataFrame([("s", 1, True, 3, ""), ("s", 2, False, 0, "x"), ("s", 3, False, 0, "y"), ("t", 1, True, 1, "")], "source string, at int, ok boolean, n int, err string")
    assert {r.source: (r.fetches, r.last_error, r.error_count) for r in store.source_status(log).collect()} == {"s": (3, "y", 2), "t": (1, "", 0)}


def test_postings_follow_the_items(spark):
    rows = [("1", "Rust rust", "café", "s", ""), ("2", "News", "rust", "s", "")]
    items = spark.createDataFrame(rows, "id string, title string, summary string, source_name string, author string")
    index = lexical.rebuilt(lexical.postings(items).limit(0), items)
    assert {(r.term, r.id): (r.n, r.weight) for r in index.where("term = 'rust'").collect()} == {("rust", "1"): (2, 20.0), ("rust", "2"): (1, 5.0)}
    moved = lexical.sync_postings(index, items.where("id = '2'").withColumn("summary", F.lit("gold")), items.where("id = '1'").select("id"))
    assert {(r.term, r.id) for r in moved.collect()} == {("news", "2"), ("gold", "2"), ("s", "2")}


def test_feeds(spark, tmp_path):
    (tmp_path / "hn.json").write_text(json.dumps([{"id": 7, "title": "T", "by": "me", "time": 1700000000}, {"id": 8, "title": "", "url": "http://x"}]))
    stories = feeds.answers(spark, f"file://{tmp_path}/hn.json", feeds.HN_SCHEMA.replace("`", ""))
    assert [(r.id, r.url, r.author) for r in feeds.hackernews(stories).collect()] == [("hn-7", "https://news.ycombinator.com/item?id=7", "me")]
    (tmp_path / "poly.json").write_text(json.dumps([{"id": "1", "question": "Low", "volume24hr": 10, "outcomePrices": "[0.25, 0.75]"}, {"id": "2", "question": "High", "volume24hr": "5000", "description": "d" * 200, "slug": "s"}]))
    got = feeds.polymarket(feeds.answers(spark, f"file://{tmp_path}/poly.json", feeds.POLYMARKET_SCHEMA)).collect()
    assert [r.id for r in got] == ["poly-2", "poly-1"] and got[0].summary.endswith("d" * 150 + "...") and got[1].summary.startswith("25% YES")
    (tmp_path / "cat.csv").write_text("name,url,category,refresh_minutes,weight,enabled\nA,http://a,tech,,,\nB,http://b,news,9,2.0,false\n")
    sources = feeds.catalog(spark, f"file://{tmp_path}/cat.csv")
    assert [(r.refresh_minutes, r.weight) for r in sources.orderBy("name").collect()] == [(5, 1.0), (9, 2.0)]
    assert [tuple(r) for r in feeds.categories(sources).collect()] == [("tech", 1)]


def test_a_long_chain_of_conflicts_settles(spark):
    rows = [(i, str(i), f"u{i // 2}", f"t{(i + 1) // 2}") for i in range(30)]
    urls, titles, want = set(), set(), []
    for pos, _, url, title in rows:
        if url not in urls and title not in titles:
            urls.add(url)
            titles.add(title)
            want.append(pos)
    got = dedup.dedup_url_title(spark.createDataFrame(rows, "pos bigint, id string, url string, title string"))
    assert sorted(r.pos for r in got.collect()) == want


@pytest.mark.parametrize("name", ["save_embedding", "fts_sync", "breathing_top", "story_context", "extract_entities", "ad_filter", "pipeline_stats", "knn_join", "briefing", "parse_score_text", "simhash", "due_sources", "source_polymarket"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SMALL}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    shown = lambda row: str([round(x, 6) if isinstance(x, float) else x for x in row])
    got = sorted(shown(r[k] for k in names) for r in df.collect())
    assert got == sorted(map(shown, con.sql(catalog.SQL[name]).project(", ".join(names)).fetchall()))
