"""Hot keys, short test items, token ids, repositories and the whole pipeline
against brute force, with nulls, empty and long texts, ties, repeated rows, empty
tables and clashing column names."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsmill.llm import _common, decontaminate, fingerprints, near_duplicates, packing, secrets, suffix_dedup, url_filters, warc
from newsmill.llm._components import components
from newsmill.llm._words import Finder, hashes, spans


def prose(seed: int, n: int) -> str:
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n))


@pytest.fixture()
def hot(monkeypatch):
    monkeypatch.setattr(_common, "FEW_ROWS", 3)
    monkeypatch.setattr(_common, "HOT", 4)


def test_hot_join_equals_join(spark, hot):
    left = spark.createDataFrame([(k, i) for i, k in enumerate([b"a"] * 30 + [b"b"] * 20 + [b"c", b"d", None, None])], "k binary, v int")
    right = spark.createDataFrame([(b"a", 1), (b"b", 2), (b"c", 3), (b"e", 4)], "k binary, r int")
    assert sorted(map(bytes, _common.hot_keys(left, "k"))) == [b"a", b"b"]
    for how in ("inner", "left"):
        assert sorted(map(str, _common.hot_join(left, right, "k", how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 60)] + [(61, 62), (62, 63)], [(i, 999) for i in range(40)], [(None, 3), (4, None), (5, 6)]])
def test_components(spark, hot, edges):
    part: dict = {}
    for a, b in edges:
        if a is not None and b is not None:
            part.setdefault(a, a), part.setdefault(b, b)
    for _ in part:
        for a, b in edges:
            if a in part and b in part:
                part[a] = part[b] = min(part[a], part[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == part


def test_hashes_go_by_bytes(monkeypatch):
    from newsmill.llm import _words

    text = ("one two one " + "x" * 400 + " two " + "x" * 400 + " " + "x" * 399).encode()
    data, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    starts, ends, _ = spans(data, at)
    for step in (64, 1 << 16):
        monkeypatch.setattr(_words, "STEP", step)
        _words._tables.cache_clear()
        h = hashes(data, starts, ends).tolist()
        words = text.split()
        assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(h)) for j in range(len(h)))
    _words._tables.cache_clear()
    keys = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    places = Finder(keys).find(np.concatenate([keys[::-1], keys[:9] + np.uint64(1)]))
    assert places.tolist() == list(range(4999, -1, -1)) + [-1] * 9 and Finder(keys[:0]).find(keys[:3]).tolist() == [-1] * 3


def test_digests_equal_a_plain_count():
    texts = [b"", b"a", b"abc", "ñandú and more".encode(), prose(1, 400).encode()]
    data, offsets = fingerprints._joined(texts)
    for text, got in zip(texts, fingerprints.digests(data, offsets)):
        count = [0] * 256
        for i in range(len(text)):
            for (a, b, c), salt in zip(fingerprints.TRIPLETS, fingerprints.SALTS):
                if i + c < len(text):
                    code = text[i + a] | text[i + b] << 8 | text[i + c] << 16
                    count[((code + 1) * salt % 2**32) >> 24] += 1
        q1, q2, q3 = (sorted(count)[k * 64 - 1] for k in (1, 2, 3))
        codes = [(n > q1) + (n > q2) + (n > q3) for n in count]
        body = [codes[i] | codes[i + 1] << 2 | codes[i + 2] << 4 | codes[i + 3] << 6 for i in range(0, 256, 4)]
        top = max(q3, 1)
        assert got.tolist() == [min(255, round(12 * math.log2(1 + len(text)))), min(15, q1 * 16 // top) << 4 | min(15, q2 * 16 // top), *body]
    a, b = fingerprints.digests(data, offsets)[[3, 4]]
    step = lambda x, y: {0: 0, 1: 1, 2: 2, 3: 6}[abs(x - y)]
    two = lambda x: [x >> s & 3 for s in (0, 2, 4, 6)]
    far = sum(step(p, q) for x, y in zip(a[2:].tolist(), b[2:].tolist()) for p, q in zip(two(x), two(y))) + abs(int(a[0]) - int(b[0])) + 2 * (abs(int(a[1] >> 4) - int(b[1] >> 4)) + abs(int(a[1] & 15) - int(b[1] & 15)))
    assert fingerprints.likeness(a[None], b[None])[0] == pytest.approx(max(0.0, 1 - far / fingerprints.UNRELATED))
    assert fingerprints.likeness(a[None], a[None])[0] == 1


def test_neighbours_are_the_same_in_any_ranges(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 40, prose(i % 40, 30)) for i in range(41)], "doc_id bigint, text string").repartition(5)
    want = sorted(docs and fingerprints.compare_neighbours(docs).collect(), key=str)
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 500)
    assert sorted(fingerprints.compare_neighbours(docs).collect(), key=str) == want


def test_repositories_decide_as_well_as_owners(spark):
    key = lambda i: f"password={'q7Zk2Lp9Xw4Vt8Rn3'[i:]}{i}mB5cD6"
    rows = [(0, key(0), "o1", "r1", 5)]
    rows += [(10 + k, key(1), "o1", f"r{k}", 5) for k in range(5)]  # one owner, many repositories
    rows += [(20 + k, key(2), f"o{k}", "r1", 5) for k in range(3)]  # many owners
    rows += [(30 + k, key(3), f"o{k % 2}", f"r{k // 2}", 5) for k in range(4)]
    rows += [(40, None, None, None, 0), (41, "", "o1", None, 0), (None, key(0), "o1", "r1", 5), (42, key(4), None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, hash int")
    got = {r.doc_id: (r.n_live, r.n_copied) for r in secrets.secret_report(docs).collect()}
    assert all(got[i] == (1, 0) for i in (0, None, 30, 31, 32, 33, 42))
    assert all(got[i] == (0, 1) for i in (*range(10, 15), *range(20, 23))) and got[40] == got[41] == (0, 0)
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert clean[0] == clean[42] == "<SECRET>" and clean[10] == key(1) and clean[40] is None
    assert secrets.redact(docs.select("doc_id", "text")).count() == len(rows)
    assert secrets.redact(docs.limit(0)).count() == secrets.secret_report(docs.limit(0)).count() == 0


def test_one_payload_of_most_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FEW_ROWS", 3)
    monkeypatch.setattr(warc, "HOT", 4)
    rows = [(i, f"http://a/{i}", "same" if i % 3 else f"own {i // 6}", "x") for i in range(5, 60)] + [(None, None, "same", "y"), (None, None, None, "y"), (70, "http://b", "", "z"), (71, None, None, "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string")
    first = {}
    for i, _, h, _ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(h or "", i)
    warc.write(warc.with_revisits(pages), f"file://{tmp_path}/w")
    got = sorted((r.page_id is None, r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.page_records(warc.read(spark, f"file://{tmp_path}/w", "digest")).collect())
    want = sorted((i is None, i, "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""], len(h or "")) for i, _, h, _ in rows)
    assert list(map(str, got)) == list(map(str, want))
    warc.write(warc.with_revisits(pages.limit(0)), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


BENCH = [(str(k), prose(300 + k, 12 + k % 5)) for k in range(30)] + [("short", "zebra quagga"), ("four", "one lone gnu here"), ("none", None), ("empty", " "), ("again", prose(300, 12))]


@pytest.fixture(scope="module")
def leaky(spark):
    texts = [prose(900 + k, 40) + (" " + BENCH[k][1] if k % 2 else "") + " " + prose(950 + k, 500 * (k % 3)) for k in range(0, 12)]
    texts += [None, "", "a Zebra, quagga!", "zebra and quagga", "x one lone gnu here y", "one lone gnu", prose(300, 12), "zebra"]
    return spark.createDataFrame([(i, t, "k", 1.5) for i, t in enumerate(texts)] + [(None, BENCH[3][1], "k", 0.0)] * 2, "doc_id bigint, text string, item_id string, bm25 double")


def held_items(text) -> set:
    plain = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split()
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    own, out = plain(text), set()
    for name, item in BENCH:
        w = plain(item)
        if w:
            k = min(5, len(w))
            runs = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
            if sum(r in grams(own, k) for r in runs) >= 0.8 * len(runs):
                out.add(name)
    return out


@pytest.mark.parametrize("limit", [1 << 24, 700])
def test_items_of_any_length_in_any_split(spark, leaky, limit):
    items = spark.createDataFrame([(i, t, "x") for i, t in [*BENCH, BENCH[0]]], "item_id string, text string, term string")
    got = decontaminate.contamination(leaky, items, leaky.columns, limit=limit).collect()
    assert len(got) == leaky.count() and sum(len(r["__hits"]) for r in got) > 8
    for r in got:
        assert {h.item_id for h in r["__hits"]} == held_items(r.text), r.doc_id
        assert len(r["__hits"]) == len({h.item_id for h in r["__hits"]})
    whole = decontaminate.contamination(leaky, items, ["doc_id"]).collect()
    score = lambda rows: sorted((str(r.doc_id), h.item_id, round(h.bm25, 9)) for r in rows for h in r["__hits"])
    assert score(got) == score(whole)
    assert all(not r["__hits"] for r in decontaminate.contamination(leaky, items.limit(0), ["doc_id"]).collect())
    assert decontaminate.contamination(leaky.limit(0), items, ["doc_id"], limit=limit).count() == 0


def test_question_and_answer_are_verified_apart(spark):
    items = spark.createDataFrame([("q", prose(1, 20), prose(2, 20))], "item_id string, text string, answer string")
    docs = spark.createDataFrame([(0, prose(1, 20)), (1, prose(1, 20) + " " + prose(2, 20)), (2, prose(2, 20)), (3, prose(3, 20))], "doc_id bigint, text string")
    got = {r.doc_id: [(round(h.question_overlap, 2), round(h.answer_overlap, 2)) for h in r["__hits"]] for r in decontaminate.contamination(docs, items, ["doc_id"], "answer", threshold=0.4).collect()}
    assert got == {0: [(1.0, 0.0)], 1: [(1.0, 1.0)], 2: [], 3: []}


def test_packed_token_ids_are_the_texts(spark):
    texts = [None, "", "a b  c", "\x1c odd\u00a0 \u2003space", prose(4, 900), prose(4, 900), "x" * 2000]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(None, "a", 1, 2)], "doc_id bigint, text string, rid int, batch int")
    encoder, end = packing._encoder(packing.VOCABULARY)[0], packing.end_id()
    ids = defaultdict(list)
    rows = packing.pack(docs, context=64, buckets=4, budget=512).collect()
    for r in sorted(rows, key=lambda r: r.seq):
        assert r.start == r.seq * 64 and len(r.token_ids) == r.n_tokens <= r.padded
        ids[r.doc_id] += r.token_ids
    assert ids == {**{i: [*encoder.encode_ordinary(t or ""), end] for i, t in enumerate(texts)}, None: [*encoder.encode_ordinary("a"), end]}
    full = Counter((r.bucket, r.batch) for r in rows)
    for b in {r.bucket for r in rows}:
        room = max(1, 512 // next(r.padded for r in rows if r.bucket == b))
        assert all(n == room for (k, _), n in sorted(full.items()) if k == b and (k, _ + 1) in full) and max(n for (k, _), n in full.items() if k == b) <= room


def test_large_groups_are_shared_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "TEAM", 3)
    rows = [(i, prose(7, 100) + f" tail{i % 9}") for i in range(12)] + [(20, prose(8, 100)), (21, None), (22, "")]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in near_duplicates.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i] == (0, 11, 2 if i % 9 < 3 else 1) for i in range(12)) and got[20] == (20, 0, 1) and got[21] == got[22] == (21, 1, 2)


def test_suffix_dedup_leaves_no_table(spark):
    docs = spark.createDataFrame([(0, "z" * 60), (1, "z" * 60)], "doc_id bigint, text string")
    before = {t.name for t in spark.catalog.listTables()}
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()} == {0: 0, 1: 60}
    assert {t.name for t in spark.catalog.listTables()} == before


def corpus(spark, path, empty=False):
    words = {"en": "the of and to in that is was for it with as his on be at by".split(), "de": "der die und das ist nicht ein zu von den mit sich auf für dem".split()}
    rng = np.random.default_rng(3)
    say = lambda lang, n: " ".join(rng.choice(words[lang], n)) + "."
    rows = [(i, say(lang, 60), lang) for i in range(40) for lang in [("en", "de")[i % 2]]]
    rows += [(100 + i, rows[i][1] + " more", rows[i][2]) for i in range(4)] + [(3, rows[3][1], "de"), (None, rows[5][1], "de"), (None, None, "en"), (50, "", None), (51, "12 !! 34", "en")]
    rows += [(60, say("en", 30) + " " + BENCH[2][1], "en"), (61, say("de", 40) + " password=Zk2Lp9Xw4Vt8Rn3 " + say("de", 30), "de"), (62, say("en", 3000), "en")]
    docs = spark.createDataFrame([(i, t, lang, f"s{k % 3}", len(t or ""), 0.5, "q", 7) for k, (i, t, lang) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, lang_pred string, rid int")
    (docs.limit(0) if empty else docs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    at = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    rows = [(i, t) for i, t, _ in rows]
    order = lambda rows: sorted(rows, key=str)
    kept = lambda df: order((r.doc_id, r.text) for r in df.collect())

    told = stages["language_id"](spark, docs, at)
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    assert told.columns == columns and kept(told) == order(rows)

    grams = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    own = [grams(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])]
    label = list(range(len(rows)))
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    rows = [r for k, r in enumerate(rows) if label[k] == k]
    one = stages["ngram_jaccard_join"](spark, told, at)
    assert one.columns == columns and kept(one) == order(rows)

    rows = [(i, t) for i, t in rows if not held_items(t)]
    clean = stages["decontamination"](spark, one, at)
    assert clean.columns == columns and kept(clean) == order(rows) and 60 not in {i for i, _ in rows}

    rows = [(i, t.replace("password=Zk2Lp9Xw4Vt8Rn3", "<SECRET>")) for i, t in rows]
    masked = stages["secret_scan"](spark, clean, at)
    assert masked.columns == columns and kept(masked) == order(rows) and all(r.n_chars == len(r.text) for r in masked.collect())

    encoder, end = packing._encoder(packing.VOCABULARY)[0], packing.end_id()
    ids = defaultdict(list)
    out = corpus_pipeline.run(spark, at)
    for r in sorted(out.collect(), key=lambda r: r.seq):
        ids[r.doc_id] += r.token_ids
    assert ids == {i: [*encoder.encode_ordinary(t), end] for i, t in rows}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    corpus(spark, tmp_path, empty=True)
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_long_lists_of_rules_are_joined(spark, monkeypatch):
    rules = (*url_filters.RULES, url_filters.Rule("block", "a.example.org", "/"), url_filters.Rule("allow", "a.example.org", "/"), url_filters.Rule("block", "", "/x"))
    urls = [None, "no scheme", "http://a.example.org/es/1", "http://b.a.example.org/q", "http://example.org", "http://notexample.org/es/", "http://a.com/de/1", "http://com/fr/", "http://z.net/x", "http://z.net/y", "http:///x/1", "http://z.net/y"]
    html = [None] * 9 + ["<link rel=canonical href='http://a.com/de/2'>", None, None]
    pages = spark.createDataFrame([(i, u, h, "k") for i, (u, h) in enumerate(zip(urls, html))], "page_id bigint, url string, html string, rule string")
    edges = url_filters.links(pages)
    want = sorted(url_filters.judge(pages, edges, rules).collect(), key=lambda r: r.page_id)
    assert want[11].verdict == "block" and want[2].rule == "example.org/es/" and want[3].verdict == "allow"
    monkeypatch.setattr(url_filters, "MAX_RULES", 2)
    assert sorted(url_filters.judge(pages, edges, rules).collect(), key=lambda r: r.page_id) == want
