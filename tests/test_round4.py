"""Whole jobs at larger sizes, second part: a test for each finding that was left of FINDINGS_r02.md."""

from __future__ import annotations

import datetime
import os

import duckdb
import numpy as np
import pytest

from newsmill.operators import similarity
from newsmill.plans import catalog, more, wider  # noqa: F401


def seconds_are_looked_up(spark, path, name, dealt):
    """Rows equal the SQL; seconds are looked up by hash, and only those that a look back meets are dealt twice."""
    times = [1704067200 + 86400 * d + s for d in range(3) for s in (0, 1, 64799, 64800, 64801, 86399) for _ in range(1 + s % 7)]
    rows = [(i, datetime.datetime.fromtimestamp(t, datetime.timezone.utc).replace(tzinfo=None), 1, "click", 0.5, "") for i, t in enumerate(times)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{path}/events.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(path))
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(catalog.SQL[name]).project(", ".join(df.columns)).fetchall())
    plan = df._jdf.queryExecution().executedPlan()
    assert "SortMergeJoin" not in plan.toString() and "round(" not in plan.toString()
    sent = []

    def walk(node):
        if node.nodeName() == "Generate":
            sent.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            walk(node.plan())

    walk(plan)
    assert sent[:1] == [dealt]


def test_velocity_rates(spark, tmp_path):
    """18 seconds, and for the next day those of its last quarter."""
    seconds_are_looked_up(spark, tmp_path, "velocity_rates", 18 + 9)


def test_velocity_baseline(spark, tmp_path):
    """a day's look back meets all seconds of the day before."""
    seconds_are_looked_up(spark, tmp_path, "velocity_baseline", 18 + 18)


@pytest.mark.parametrize("name", ["ann_groups", "ann_primary", "ann_model_twins"])
def test_parts_leave_the_disk(spark, tmp_path, monkeypatch, name):
    """when a part of the vectors is broadcast the one before is gone, and in the end all are."""
    monkeypatch.setattr(similarity, "BLOCK", 64)
    monkeypatch.setattr(similarity.against_earlier, "__defaults__", (4000,))
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(5).normal(size=(300, 8)).astype(np.float32))]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(400).selectExpr("id AS doc_id", "'en' AS lang", "'s' AS source", "'x' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    sent, kept, send = [], [], spark.sparkContext.broadcast

    def broadcast(value):
        kept.append(sum(os.path.exists(b._path) for b in sent))
        sent.append(send(value))
        return sent[-1]

    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    catalog.QUERIES[name](spark, str(tmp_path)).count()
    assert len(sent) > 1 and not any(kept) and not any(os.path.exists(b._path) for b in sent)
