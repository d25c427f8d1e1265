"""Streams over files, a batch at a time, against what a batch query gives."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from newsmill.functions import models
from newsmill.streaming import ingest

ITEM = "pos bigint, id string, url string, title string"


def files(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / f"{name}.json").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def drained(writer):
    query = writer.start()
    query.processAllAvailable()
    query.stop()


def test_ingest_ignores_known_ids_and_urls(spark, tmp_path):
    item = lambda pos, id, url: {"pos": pos, "id": id, "url": url, "title": "t"}
    at, out, mark = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/mark"
    for name, rows in (("1", [item(0, "a", "u1"), item(1, "b", "u1"), item(2, "c", "u2")]), ("2", [item(3, "a", "u9"), item(4, "d", "u2"), item(5, "e", "u5")])):
        files(at, name, rows)
        stream = spark.readStream.schema(ITEM).json(f"file://{at}")
        drained(ingest.ingest(stream, out, mark, "0 seconds"))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "c", "e"]


def test_enrich_skips_empty_texts(spark, tmp_path):
    files(tmp_path / "in", "1", [{"pos": 0, "id": "a", "url": "", "title": "x"}, {"pos": 1, "id": "b", "url": "", "title": ""}])
    stream = spark.readStream.schema(ITEM).json(f"file://{tmp_path}/in")
    drained(ingest.enrich(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/mark", lambda b: b.withColumn("embedding", models.byte_sum_vector(F.col("title"))), "0 seconds"))
    assert [r.id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == ["a"]


def test_follow_reads_new_files_and_skips_bad_lines(spark, tmp_path):
    at = tmp_path / "log"
    files(at, "1", [{"t": "2024-01-01T00:00:00Z", "kind": "a"}, "", "{bad", {"t": "2024-01-01T00:00:01Z", "kind": "b"}])
    query = ingest.follow(spark, f"file://{at}").writeStream.format("memory").queryName("followed").start()
    query.processAllAvailable()
    files(at, "2", [{"t": "2024-01-01T00:00:02Z", "kind": "c"}])
    query.processAllAvailable()
    query.stop()
    assert [r.kind for r in spark.table("followed").orderBy("t").collect()] == ["a", "b", "c"]


def test_windows_and_sessions(spark, tmp_path):
    event = lambda minute, qid="q": {"t": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z", "kind": "k", "qid": qid}
    files(tmp_path / "log", "1", [event(m) for m in (0, 5, 59, 60, 100, 400)] + [event(7, "r")])
    events = ingest.follow(spark, f"file://{tmp_path}/log")
    batch = spark.read.schema("t timestamp, kind string, qid string").json(f"file://{tmp_path}/log")
    for name, f in (("w1", lambda e: ingest.windowed_counts(e)), ("w2", lambda e: ingest.windowed_counts(e, "1 hour", "30 minutes")), ("w3", ingest.sessions)):
        query = f(events).writeStream.format("memory").outputMode("complete").queryName(name).start()
        query.processAllAvailable()
        query.stop()
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, f(batch).collect()))
    assert sorted(r.n for r in ingest.sessions(batch).collect()) == [1, 1, 1, 2, 2]


def test_state_is_kept_between_batches(spark, tmp_path):
    got = {}
    for name, rows in (("1", [{"source": "a", "fresh": 2, "ok": False}, {"source": "b", "fresh": 0, "ok": True}]), ("2", [{"source": "a", "fresh": 0, "ok": False}, {"source": "b", "fresh": 0, "ok": False}])):
        files(tmp_path / "in", name, rows)
        stream = spark.readStream.schema("source string, fresh int, ok boolean").json(f"file://{tmp_path}/in")
        for kind, f in (("poll", ingest.poll_state), ("errors", ingest.error_streaks)):
            def keep(batch, _, kind=kind):
                got.update({(kind, r[0]): r[1] for r in batch.collect()})

            drained(f(stream).writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/{kind}").foreachBatch(keep))
    assert got == {("poll", "a"): 300 * 0.7 * 1.5, ("poll", "b"): 300 * 1.5 * 1.5, ("errors", "a"): 2, ("errors", "b"): 1}
