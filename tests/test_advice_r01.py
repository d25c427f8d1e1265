
from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from newsmill.operators import entities, stories
from newsmill.plans import catalog, more  # noqa: F401
from newsmill.sources import items as src

SMALL = "/root/testdata/sf0.001"


def test_parts_of_a_long_chain(spark):
    order = list(range(400))
    random.Random(3).shuffle(order)
    chain = [(pos, f"e{k + d}") for k, pos in enumerate(order) for d in (0, 1)] + [(pos, f"f{k + d}") for k, pos in enumerate(range(500, 900)) for d in (0, 1)]
    got = {r.pos: r.part for r in stories.parts_of(spark.createDataFrame([*chain, (1000, None)], "pos bigint, entity_id string")).collect()}
    assert got == {**{k: 0 for k in range(400)}, **{k: 500 for k in range(500, 900)}, 1000: 1000}


def test_clusters_are_of_whole_texts(spark, tmp_path):
    text = "Line one of it\nThen $AAPL in Tokyo"
    rows = [(0, text), (1, "Other words\nand so on, $AAPL in Tokyo"), (2, "Line one\nnothing"), (3, "Line one of it\nno entity")]
    spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "'en' AS lang", "'s' AS source", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.pos: r.cluster for r in catalog.QUERIES["cluster_assign"](spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


NEWS = [
    "Plain first line\nThen the U.S. and Beijing, said (Reuters), of $AAPL, $BRK.B and $AAPL",
    "Panamericana\nneither chinas nor indiana; \u20ac5 and $ only",
    "50% off in Tokyo, New Delhi\nnext",
    "Quiet title\nact now: free webinar, according to Wall Street Journal",
    "Save $50 today, citing sources",
    "\nempty title, south korea",
    None,
]


def news(spark, path, texts=NEWS):
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("doc_id", "'en' AS lang", "'s' AS source", "text").write.parquet(f"{path}/documents.parquet")
    return str(path)


def both(spark, name, path):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{path}/documents.parquet/*.parquet'" if path != SMALL else f"CREATE VIEW documents AS FROM '{path}/documents.parquet'")
    df = catalog.QUERIES[name](spark, path)
    names = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[k] for k in names) for r in df.collect())))
    return got, sorted(map(repr, con.sql(catalog.SQL[name]).project(", ".join(names)).fetchall()))


@pytest.mark.parametrize("name", ["extract_tickers", "extract_countries", "extract_attribution", "extract_entities", "filter_entity", "ad_filter"])
def test_extractors_read_whole_texts(spark, tmp_path, name):
    got, want = both(spark, name, news(spark, tmp_path))
    assert got == want and len(set(got)) >= (1 if name == "filter_entity" else 2)
    got, want = both(spark, name, SMALL)
    assert got == want


def test_claims_and_conflicts_of_items(spark, tmp_path):
    texts = ["Quake in Tokyo\n10 million people. The mayor said that it was a quake of old days", "Tokyo shaken\n20 million people. The minister denied that there was any quake at all; rain will be over by tomorrow noon", 'Elsewhere\n90 million, "a quote of some length"; he says he saw all of it and she said nothing of that', None]
    path = news(spark, tmp_path, texts)
    got, want = both(spark, "extract_claims", path)
    assert got == want and len(got) > 8
    kinds = {(r.pos, r.kind) for r in catalog.QUERIES["extract_claims"](spark, path).collect()}
    assert kinds >= {(0, "number"), (0, "attribution"), (1, "denial"), (1, "prediction"), (2, "quote"), (2, "attribution")}
    found = {(r.pos_a, r.pos_b, r.kind) for r in catalog.QUERIES["items_conflicts"](spark, path).collect()}
    assert found == {(0, 1, "factual"), (0, 1, "denial")}
    got, want = both(spark, "extract_claims", SMALL)
    assert got == want
