"""Whole jobs at larger sizes, third part: a test for each finding that is left of FINDINGS_r02.md."""

from __future__ import annotations

import os

import numpy as np
import pytest

from newsmill.operators import similarity, staging
from newsmill.plans import catalog, more, wider  # noqa: F401
from tests.test_round3 import cosine_pairs


def shuffled(spark) -> dict[str, int]:
    """Bytes of each shuffle file on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(k).getPath() for k in range(files.size())]
    return {n: os.path.getsize(n) for n in names if "/shuffle_" in n and os.path.exists(n)}


@pytest.mark.parametrize("part", [9000, 1 << 20])
def test_theta_similarity_join(spark, tmp_path, monkeypatch, part):
    """nothing is broadcast, and what was shuffled to stage the vectors is gone; vectors of a size meet whichever parts they are in."""
    monkeypatch.setattr(similarity, "BLOCK", 64)
    monkeypatch.setattr(similarity.against_earlier, "__defaults__", (part,))
    rng = np.random.default_rng(11)
    sizes = {5: 0, 40: 3, 41: 3, 400: 3, 599: 5}
    rows = [(i, None if i == 77 else rng.normal(size=sizes.get(i, 24 if i % 3 else 32)).astype(np.float32).tolist()) for i in range(600)]
    rows[300], rows[301] = (300, rows[3][1]), (301, [0.0] * 24)
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(5).selectExpr("id AS doc_id", "'en' AS lang", "'s' AS source", "'x' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    sent, send, before = [], spark.sparkContext.broadcast, set(shuffled(spark))
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(send(value)) or sent[-1])
    df = catalog.QUERIES["theta_similarity_join"](spark, str(tmp_path))
    left = sum(size for name, size in shuffled(spark).items() if name not in before)
    want = sorted(k for k, sim in cosine_pairs(rows).items() if sim > np.float32(0.35))
    for _ in range(2):
        assert sorted(map(tuple, df.collect())) == want and len(want) > 1000
    assert not sent and left < 20000


def kept(spark) -> dict[str, int]:
    """Bytes of each file that is staged."""
    top = staging.folder(spark).removeprefix("file://").rpartition("/")[0]
    return {f"{d}/{n}": os.path.getsize(f"{d}/{n}") for d, _, names in os.walk(top) for n in names}


@pytest.mark.parametrize("name", ["ann_primary", "ann_model_twins"])
def test_vectors_leave_the_disk(spark, tmp_path, monkeypatch, name):
    """when the groups are known neither the staged vectors nor what was shuffled for them is on disk."""
    monkeypatch.setattr(similarity, "BLOCK", 100)
    monkeypatch.setattr(similarity.against_earlier, "__defaults__", (200_000,))
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(1000, 128)).astype(np.float32)
    vectors[500:] = vectors[:500] + np.float32(0.1) * vectors[500:]
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(1100).selectExpr("id AS doc_id", "'en' AS lang", "'s' AS source", "'x' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    staged, moved = set(kept(spark)), set(shuffled(spark))
    df = catalog.QUERIES[name](spark, str(tmp_path))
    left = [sum(size for file, size in now.items() if file not in had) for now, had in ((kept(spark), staged), (shuffled(spark), moved))]
    unit = vectors / np.linalg.norm(vectors.astype(np.float64), axis=1)[:, None]
    alone = (1 + np.tril(unit @ unit.T, -1).max(axis=1)) / 2 < 0.68
    assert sorted(int(r.id) for r in df.collect()) == [*np.flatnonzero(alone).tolist(), *range(1000, 1100)] and 400 < alone.sum() < 501
    assert max(left) < vectors.nbytes / 10
