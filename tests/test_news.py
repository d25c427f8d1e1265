from __future__ import annotations

import random

import pytest

from newsmill.operators import dedup, entities, lexical, rules, sampling
from newsmill.plans import catalog
from newsmill.sources import items as src

SMALL = "/root/testdata/sf0.001"


def items_of(spark, rows):
    return spark.createDataFrame(rows, "pos bigint, id string, url string, title string")


def kept(df):
    return sorted(r.pos for r in df.select("pos").collect())


def test_first_wins_is_sequential(spark):
    assert kept(dedup.dedup_url_title(items_of(spark, [(0, "a", "u1", "t1"), (1, "b", "u2", "t1"), (2, "c", "u2", "t3")]))) == [0, 2]


def test_first_wins_against_loop(spark):
    rng = random.Random(4)
    rows = [(i, str(i), f"u{rng.randrange(25)}" if rng.random() < 0.8 else "", f"Breaking: t{rng.randrange(25)}" if rng.random() < 0.5 else f"t{rng.randrange(25)}") for i in range(80)]
    urls, titles, want = set(), set(), []
    for pos, _, url, title in rows:
        key = title.lower().removeprefix("breaking:").strip()
        if (url and url in urls) or key in titles:
            continue
        urls.add(url)
        titles.add(key)
        want.append(pos)
    assert kept(dedup.dedup_url_title(items_of(spark, rows))) == want


def test_empty_tables(spark):
    assert kept(dedup.dedup_url_title(items_of(spark, []))) == []
    full = src.items(spark, SMALL)
    assert sampling.limit_per_source(full, 0).count() == 0 and sampling.limit_per_source(full.limit(0), 3).count() == 0


def test_search(spark):
    rows = [("1", "Rust release", "about memory", "s", ""), ("2", "News", "rust on cars", "s", ""), ("3", "Super Bowl night", "game", "s", ""), ("4", "Cafés open", "paris", "s", "")]
    frame = spark.createDataFrame(rows, "id string, title string, summary string, source_name string, author string")
    found = lambda q: [r.id for r in lexical.search(frame, q).collect()]
    assert found("rust") == ["1", "2"] and found("super bowl") == ["3"] and found("rust AND cars") == ["2"]
    assert set(found("bowl OR cars")) == {"2", "3"} and found('"bowl night"') == ["3"] and found("caf*") == ["4"]
    assert found("rust NOT cars") == ["1"] and found("") == [] and found("C++") == []


def test_schedules():
    assert sampling.schedule([("a", 0.5, 9)], 5) == []
    assert [s for s, *_ in sampling.schedule([("a", 2.0, 9), ("b", 1.0, 9)], 6)] == ["a", "a", "b", "a", "a", "b"]
    assert [r[0] for r in sampling.cooldown([("a",), ("a",), ("b",), ("c",)], 1)] == ["a", "b", "a", "c"]


def test_ads_and_entities(spark):
    frame = spark.createDataFrame([("Save $50 today", "", "u", "x"), ("Plain news", "", "http://x/sites/1", "Forbes"), ("Plain news", None, "u", "x"), (" ", "", "u", "x")], "t string, s string, u string, n string")
    from pyspark.sql import functions as F

    assert [r[0] for r in frame.select(rules.is_ad(F.col("t"), F.col("s"), F.col("u"), F.col("n"))).collect()] == [True, True, False, True]
    got = spark.createDataFrame([(1, "$AAPL and $BRK.B in South Korea, according to Reuters", None)], "pos bigint, title string, summary string")
    assert {r.entity_id for r in entities.entities(got).collect()} == {"ticker:AAPL", "ticker:BRK.B", "country:south_korea", "source:Reuters"}


@pytest.mark.parametrize("name", ["feed_stats", "limit_per_source", "time_band", "semantic_dedup", "fts_search"])
def test_queries_equal_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "events", "pages"):
        c.execute(f"CREATE VIEW {t} AS FROM '{SMALL}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[k] for k in names) for r in df.collect())))
    want = c.sql(catalog.SQL[name]).project(", ".join(names)).fetchall()
    assert got == sorted(map(repr, want))
