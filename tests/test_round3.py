"""Whole jobs at larger sizes: a test for each finding of FINDINGS_r02.md."""

from __future__ import annotations

import datetime
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from newsmill.operators import dedup, entities, similarity
from newsmill.plans import catalog, more, wider  # noqa: F401


def test_only_repeated_strings_are_merged():
    """of pieces with one minimizer only the strings found twice are merged."""
    from newsmill.llm import suffix_dedup as sd

    rng = np.random.default_rng(7)
    common = rng.integers(97, 123, 60).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 123, 30).astype(np.uint8), common[: 60 - k], rng.integers(97, 123, 20).astype(np.uint8)]) for k in (0, 3, 60)]
    size = np.array([len(t) for t in texts])
    start, n, data = np.cumsum(size) - size, size - 49, np.concatenate(texts)
    piece, skip, many = sd._repeated(data, start, n, 50)
    strings = [[t[i : i + 50].tobytes() for i in range(len(t) - 49)] for t in texts]
    every = [x for own in strings for x in own]
    want = {(p, i) for p, own in enumerate(strings) for i, x in enumerate(own) if every.count(x) > 1}
    assert {(p, a + i) for p, a, m in zip(piece.tolist(), skip.tolist(), many.tolist()) for i in range(m)} == want and len(want) == 16
    found = np.repeat([5, 6, 7], n)
    first = np.cumsum(n) - n
    found[sd._ranges(first[piece] + skip, many)] = sd.least_keys(data, start[piece] + skip, many, np.array([5, 6, 7])[piece], 50)
    assert (found == sd.least_keys(data, start, n, np.array([5, 6, 7]), 50)).all()
    assert not len(sd._repeated(data, start[:1], n[:1], 50)[0])


EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


@pytest.fixture(scope="session")
def log(spark, tmp_path_factory):
    """Events at the edges of all windows, with equal times, null times and kinds."""
    edges = [0, 0, 1, 899, 900, 901, 3599, 3600, 3601, 3602, 21600, 21601, 86399, 86400, 86401, 90000, 172800, 172801, 259200]
    times = [1704067200 + 43200 * (k % 3) + x for k in range(6) for x in edges]
    rows = [(i, None if i % 29 == 5 else datetime.datetime.fromtimestamp(t, datetime.timezone.utc).replace(tzinfo=None), 1, [None, "click", "view"][i % 3], 0.5, "") for i, t in enumerate(times)]
    path = str(tmp_path_factory.mktemp("log"))
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{path}/events.parquet")
    return path


def velocity_equals_sql(spark, log, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{log}/events.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, log)
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, con.sql(catalog.SQL[name]).project(", ".join(df.columns)).fetchall()))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # every frame starts with its part, and a part is a day of a cluster: nothing is added up anew for each row
    frames = re.findall(r"specifiedwindowframe\(RangeFrame, (\w+)", plan)
    assert frames and set(frames) == {"unboundedpreceding"} and "_day" in plan


def test_velocity_record(spark, log):
    """F3"""
    velocity_equals_sql(spark, log, "velocity_record")


def test_velocity_baseline(spark, log):
    """F4"""
    velocity_equals_sql(spark, log, "velocity_baseline")


def test_velocity_rates(spark, log):
    """F5"""
    velocity_equals_sql(spark, log, "velocity_rates")


def near_vectors(n=700, seed=3, sizes=(6, 4)):
    """Vectors of two sizes around a few centres, with copies, zeros, nulls and ids in no order."""
    rng = np.random.default_rng(seed)
    centres = {s: rng.normal(size=(9, s)) for s in sizes}
    rows = []
    for i in rng.permutation(n).tolist():
        s = sizes[i % 11 == 0]
        v = (centres[s][i % 9] + (0.3 * rng.normal(size=s) if i % 5 else 0)).astype(np.float32)
        rows.append((i, None if i % 97 == 1 else [] if i % 97 == 2 else [0.0] * s if i % 97 == 3 else v.tolist()))
    return rows


def cosine_pairs(rows):
    """(a, b): cosine as a float, 0 with a zero vector; of vectors of one size."""
    out = {}
    own = [(p, np.asarray(v, np.float64)) for p, v in sorted(rows) if v]
    for j, (b, y) in enumerate(own):
        for a, x in own[:j]:
            if len(x) == len(y):
                norm = np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())
                out[a, b] = np.float32((x * y).sum() / norm) if norm else np.float32(0)
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    """Many blocks, tiles and parts of few vectors."""
    for name, value in (("BLOCK", 64), ("TILE", 50), ("SOME", 100)):
        monkeypatch.setattr(similarity, name, value)
    monkeypatch.setattr(similarity.against_earlier, "__defaults__", (4000,))


def best_earlier(rows, n, rank, threshold=-1.01):
    by = {}
    for (a, b), sim in cosine_pairs(rows).items():
        if sim > np.float32(threshold):
            by.setdefault(b, []).append((-rank(sim), a))
    return {b: [a for _, a in sorted(x)[:n]] for b, x in by.items()}


def test_knn_join(spark, tmp_path, small_blocks):
    """near ties are ranked as the SQL does, over all earlier vectors, however
    many there are; no task makes rows of all pairs."""
    rows = near_vectors()
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    frame.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(0, "x")], "doc_id bigint, text string").selectExpr("doc_id", "'en' AS lang", "'s' AS source", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in catalog.QUERIES["knn_join"](spark, str(tmp_path)).orderBy("pos", "place").collect():
        got.setdefault(r.pos, []).append(r.near)
        assert len(got[r.pos]) == r.place
    want = best_earlier(rows, 5, lambda s: np.floor(np.float64(s) * 1e5 + 0.5) if s >= 0 else -np.floor(-np.float64(s) * 1e5 + 0.5))
    assert got == want and len(got) > 600
    # twenty vectors that differ less than the rounding: the first five of them are nearest
    almost = [(i, [1.0, 0.0011 * (i < 12) + 1e-5 * i]) for i in range(20)] + [(20, [1.0, 0.0])]
    found = dedup.nearest_earlier(spark.createDataFrame(almost, "pos bigint, embedding array<float>"), 5, digits=5).where("pos = 20")
    assert sorted((r.place, r.near) for r in found.collect()) == [(k + 1, k) for k in range(5)]


def groups_equal_brute_force(spark, name, tmp_path):
    """Queries of groups of near vectors against a loop; pairs are never rows."""
    rows = [(i, v) for i, v in near_vectors(400)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(500).selectExpr("id AS doc_id", "'en' AS lang", "'s' AS source", "'x' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    best = {}
    for (a, b), sim in cosine_pairs(rows).items():
        if (1 + sim) / 2 >= 0.68 and (b not in best or (-sim, a) < best[b]):
            best[b] = (-sim, a)
    root = {}
    for p in sorted(p for p, _ in rows):
        root[p] = root[best[p][1]] if p in best else p
    want = sorted(root.items()) if name == "ann_groups" else sorted((str(p),) for p in range(500) if root.get(p, p) == p)
    df = catalog.QUERIES[name](spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.collect()) == want and 9 < len(set(root.values())) < 100


def blocks_that_travel(monkeypatch, run):
    """The plans of what ``run`` writes or gives; no vector may be exploded into a row for each block it meets."""
    plans, write = [], similarity.against_earlier
    monkeypatch.setattr(similarity, "against_earlier", lambda *a, **b: (lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), df)[1])(write(*a, **b)))
    run()
    assert plans and not any(re.search(r"Generate|Join|Repartition", p) for p in plans)


def test_ann_model_twins(spark, tmp_path, small_blocks, monkeypatch):
    """F7"""
    blocks_that_travel(monkeypatch, lambda: groups_equal_brute_force(spark, "ann_model_twins", tmp_path))


def test_ann_primary(spark, tmp_path, small_blocks, monkeypatch):
    """F9"""
    blocks_that_travel(monkeypatch, lambda: groups_equal_brute_force(spark, "ann_primary", tmp_path))


def test_ann_groups(spark, tmp_path, small_blocks, monkeypatch):
    """F10"""
    blocks_that_travel(monkeypatch, lambda: groups_equal_brute_force(spark, "ann_groups", tmp_path))


def test_theta_similarity_join(spark, tmp_path, small_blocks, monkeypatch):
    """all pairs over the threshold, of vectors of any sizes, none of them copied for each block it meets."""
    rows = near_vectors(400)
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(5).selectExpr("id AS doc_id", "'en' AS lang", "'s' AS source", "'x' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(k for k, sim in cosine_pairs(rows).items() if sim > np.float32(0.35))

    def check(want):
        assert sorted(map(tuple, catalog.QUERIES["theta_similarity_join"](spark, str(tmp_path)).collect())) == want and len(want) > 1000
        frame = spark.createDataFrame(rows, "pos bigint, embedding array<float>")
        below = sorted(k for k, sim in cosine_pairs(rows).items() if sim > np.float32(-0.5))
        assert sorted((r.a, r.b) for r in dedup.similar_pairs(frame, -0.5).collect()) == below
        assert dedup.similar_pairs(frame.where("pos < 0"), 0.1).count() == 0

    blocks_that_travel(monkeypatch, lambda: check(want))


@pytest.mark.parametrize("most", [1 << 14, 37])
def test_semantic_dedup(spark, monkeypatch, most):
    """the greedy pass in rounds of rows equals a loop, and writes no pairs."""
    rows = [(i, v) for i, v in near_vectors(400)]
    items = [(i, str(i), [None, "", f"u{i % 60}", f"v{i}"][i % 4]) for i in range(450)]
    monkeypatch.setattr(similarity.first_wins_near, "__defaults__", (most,))
    monkeypatch.setattr(similarity, "pairs_over", None)
    near = {}
    for (a, b), sim in cosine_pairs(rows).items():
        if sim > np.float32(0.9):
            near.setdefault(b, []).append(a)
    want, urls = [], set()
    for pos, _, url in items:
        if not (url and url in urls) and not set(near.get(pos, [])) & set(want):
            want.append(pos)
            urls.add(url)
    got = dedup.semantic_dedup(spark.createDataFrame(items, "pos bigint, id string, url string"), spark.createDataFrame([(str(i), v) for i, v in rows], "id string, embedding array<float>"), 0.9)
    assert sorted(r.pos for r in got.collect()) == want and 50 < len(want) < 400


def test_countries_are_found_in_one_pass(spark):
    """F8: names inside names, at any place, as one search for each country finds them."""
    words = [w for ws in entities.COUNTRIES.values() for w in ws]
    rng = np.random.default_rng(5)
    texts = [None, "", "North Korea, south korea; mexico city's U.S. and u.s.a us2 chinas-china", *words]
    texts += ["".join(str(x) for x in rng.choice([*words, " ", "-", ".", "x", "new", "7", "\n", "é"], 9)) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    column = entities.countries(F.col("t"))
    alone = {k: re.compile("(?<![a-z0-9])(" + "|".join(re.escape(w) for w in sorted(ws, key=len, reverse=True)) + ")(?![a-z0-9])") for k, ws in entities.COUNTRIES.items()}
    got = [r[0] for r in frame.select(column).collect()]
    assert got == [sorted(k for k, p in alone.items() if p.search((t or "").lower())) for t in texts] and sum(map(len, got)) > 200
    assert "rlike" not in frame.select(column)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_claims_are_searched_once(spark):
    """one search of a text for each kind of claim; a claim's parts come from what it found."""
    texts = ['The old mayor said that it was a quake of old days, he says 10 million people. "a quote of some length"', "We will be over by tomorrow noon\n$1,200.5 billion 7 % and Mr X  denied   that there was any\nquake; she said no", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "pos bigint, title string").selectExpr("pos", "title", "CAST(NULL AS string) AS summary")
    df = entities.extract_claims(frame)
    got = sorted((r.pos, r.kind, r.text, r.value, r.speaker) for r in df.collect())
    want = []
    for pos, text in enumerate(texts):
        for kind, pattern in entities.CLAIMS.items():
            parts = [[r[0][i] if r[0] else None for r in spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(pattern), k)).collect()] for k in range({"number": 3, "quote": 2, "attribution": 4, "prediction": 3}[kind]) for i in [0]]
            if parts[0][0] is not None:
                first = [p[0] for p in parts]
                value = {"number": lambda m: f"{m[1]} {m[2]}", "quote": lambda m: m[1], "attribution": lambda m: m[3], "prediction": lambda m: m[2]}[kind](first)
                want.append((pos, kind, first[0], value, first[1].strip() if kind == "attribution" else ""))
    assert set(want) <= set(got) and len(want) > 4
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == len(entities.CLAIMS)
