"""Whole jobs at larger sizes, fourth part: a test for the finding that is left of FINDINGS_r02.md."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from newsmill.operators import dedup, similarity, staging
from newsmill.plans import catalog, more, wider  # noqa: F401
from tests.test_round5 import kept, shuffled


def vectors_of(seed: int) -> np.ndarray:
    vectors = np.random.default_rng(seed).normal(size=(1000, 128)).astype(np.float32)
    vectors[500:] = vectors[:500] + np.float32(0.1) * vectors[500:]
    vectors[800] = vectors[20]
    return vectors


@pytest.mark.parametrize("files", [1, 7])
def test_ann_model_twins(spark, tmp_path, monkeypatch, files):
    """no vectors are on disk when a part is broadcast, only the part; rows equal the SQL in whatever order and files the vectors are."""
    monkeypatch.setattr(similarity, "BLOCK", 100)
    monkeypatch.setattr(similarity, "TILE", 150)
    monkeypatch.setattr(similarity.against_earlier, "__defaults__", (100_000,))
    vectors = vectors_of(13)
    rows = [(i, vectors[i].tolist()) for i in np.random.default_rng(14).permutation(1000).tolist()]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(files).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(1100).selectExpr("id AS doc_id", "'en' AS lang", "'s' AS source", "'x' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    had, held, send = set(kept(spark)) | set(shuffled(spark)), [], spark.sparkContext.broadcast

    def broadcast(value):
        held.append(sum(size for now in (kept(spark), shuffled(spark)) for file, size in now.items() if file not in had))
        return send(value)

    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    df = catalog.QUERIES["ann_model_twins"](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.sql(catalog.SQL["ann_model_twins"]).fetchall())
    assert sorted(map(tuple, df.collect())) == want and 500 < len(want) < 700
    assert len(held) > 4 and max(held) < vectors.nbytes / 4


@pytest.mark.parametrize("n, digits", [(1, None), (5, None), (5, 2)])
def test_nearest_read_again(spark, tmp_path, monkeypatch, n, digits):
    """the nearest ones are those of staged vectors, of all sizes and with a ``pos`` that many share."""
    monkeypatch.setattr(similarity, "BLOCK", 64)
    rows = [(i if i % 3 else i // 200, v[: 20 if i % 7 else 12].tolist()) for i, v in enumerate(vectors_of(15))] + [(900, [0.0] * 20), (0, [0.0] * 20), (None, [1.0]), (2000, None), (2001, []), (2002, [0.5])]
    spark.createDataFrame(rows, "pos bigint, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/v")
    vectors = spark.read.parquet(f"{tmp_path}/v")
    ranked = lambda df: sorted((r["pos"], r["place"], r["near"], r["sim"]) for r in df.collect())
    want = ranked(dedup.nearest_earlier(vectors, n, 0.1, digits))
    for part, read in ((30_000, True), (2000, False)):
        monkeypatch.setattr(similarity.against_earlier, "__defaults__", (part,))
        assert (similarity.ranges(vectors, part) is not None) == read and similarity.only_read(vectors)
        found = similarity.nearest(vectors, n, 0.1, digits, write=staging.folder(spark))
        monkeypatch.setattr(similarity, "nearest", lambda *a, found=found, **b: found)
        assert ranked(dedup.nearest_earlier(vectors, n, 0.1, digits)) == want and len(want) > 500
        monkeypatch.undo()
        monkeypatch.setattr(similarity, "BLOCK", 64)


def test_only_read(spark, tmp_path):
    """vectors that are made by more than reading files, or that may be others next time, are staged."""
    spark.range(9).selectExpr("id AS pos", "array(float(id)) AS embedding").write.parquet(f"{tmp_path}/v")
    read = spark.read.parquet(f"{tmp_path}/v")
    assert similarity.only_read(read.where("pos > 1").selectExpr("pos + 1 AS pos", "embedding"))
    assert not any(map(similarity.only_read, (read.repartition(2), read.selectExpr("pos", "array(float(rand())) AS embedding"), read.selectExpr("monotonically_increasing_id() AS pos", "embedding"), spark.range(3))))
