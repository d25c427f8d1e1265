"""Benchmark decontamination: a BM25 index of test items searched with every
training passage, under block-max bounds, then verified on word shingles.

The search is block-max WAND without its cursor: a passage's lists are all taken
at once, and a block of items is a pivot where the block maxima of the lists that
reach it add up to the threshold. Only pivots are scored, so the same items are
found as by scoring all."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmill.llm._common import chunks, hot_join, staged, table, text_column, tune
from newsmill.llm._words import hashes, shingles, spans

K1, B = 1.2, 0.75
#: Share of an item's score against itself that a passage must reach.
THRESHOLD = 0.5
#: Share of an item's word shingles that a document must have.
OVERLAP = 0.8
WORDS = 5
BLOCK_ITEMS = 16
#: Text of test items that one index holds; more items make further indexes.
INDEX_BYTES = 16 << 20
#: Postings that are looked at together, in whole passages.
POSTINGS = 1 << 18
#: Bytes of documents that are searched together, or one longer text.
SEARCH_BYTES = 256 << 10
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 0x20


def words(data: np.ndarray, offsets: np.ndarray):
    """Hashes and texts of the words; ASCII punctuation separates words too."""
    plain = _PLAIN[data]
    starts, ends, own = spans(plain, offsets)
    return hashes(plain, starts, ends), own


def _pack(texts: list[str]):
    raw = [t.lower().encode() for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    return words(np.frombuffer(b"".join(raw), np.uint8), offsets)


@dataclass
class Index:
    """Items by length in blocks; per term its postings and its block maxima.
    Impacts are shares of the item's score against itself."""

    ids: list
    stride: int
    terms: np.ndarray
    top: np.ndarray
    post_at: np.ndarray
    post_item: np.ndarray
    post_impact: np.ndarray
    block_at: np.ndarray
    block_no: np.ndarray
    block_top: np.ndarray
    grams: list[np.ndarray]
    answer: list[np.ndarray]
    run: list[int]
    parted: list[bool]


def answer_start(text: str) -> int:
    """Characters before the answer: the last sentence, or the last third of the
    words where there is one sentence."""
    cuts = [m.end() for m in re.finditer(r"[.?!:]\s+", text.rstrip())]
    if cuts:
        return cuts[-1]
    parts = [m.start() for m in re.finditer(r"\S+", text)]
    return parts[len(parts) * 2 // 3] if parts else 0


def item_words(text: str | None, answer: str | None) -> tuple[np.ndarray, int]:
    """Word hashes of an item, question then answer, and those of the question.
    Without an answer the last sentence is taken as one."""
    text = text or ""
    question, reply = (text, answer) if answer is not None else (text[: answer_start(text)], text[answer_start(text) :])
    q, _ = _pack([question])
    a, _ = _pack([reply])
    return np.concatenate([q, a]), len(q)


def build(items: list[tuple], size: int = WORDS, stats: tuple | None = None) -> Index | None:
    """The index of (id, text, answer or None) rows; rows without a word are left
    out. ``stats``: items in all, their mean length, sorted terms and how many
    items have each, where these rows are a share of the items."""
    rows = []
    for key, text, answer in items:
        both, n_question = item_words(text, answer)
        if len(both):
            rows.append((len(both), key, both, n_question, answer is not None))
    if not rows:
        return None
    rows.sort(key=lambda r: (r[0], str(r[1])))
    terms, tid = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
    item = np.repeat(np.arange(len(rows)), [r[0] for r in rows])
    pair, tf = np.unique(tid.astype(np.int64) * len(rows) + item, return_counts=True)
    term, item = pair // len(rows), pair % len(rows)
    total, mean, df = len(rows), sum(r[0] for r in rows) / len(rows), np.bincount(term, minlength=len(terms))
    if stats:
        total, mean, known, many = stats
        df = many[np.searchsorted(known, terms)]
    length = np.array([r[0] for r in rows], float)[item]
    idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
    impact /= np.bincount(item, weights=impact, minlength=len(rows))[item]
    post_at = np.searchsorted(term, np.arange(len(terms) + 1))
    top = np.maximum.reduceat(impact, post_at[:-1])
    block = item // BLOCK_ITEMS
    fresh = np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))
    first = np.flatnonzero(fresh)
    grams, answer, run = [], [], []
    for n, _, both, n_question, _ in rows:
        k = min(size, n)
        g, _ = shingles(both, np.zeros(n, np.int64), 1, k)
        grams.append(g)
        answer.append(np.arange(len(g)) + k > n_question)
        run.append(k)
    return Index([r[1] for r in rows], int(max(r[0] for r in rows)), terms, top, post_at, item, impact, np.searchsorted(term[first], np.arange(len(terms) + 1)), block[first], np.maximum.reduceat(impact, first), grams, answer, run, [r[4] for r in rows])


def _spread(at: np.ndarray, tid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lists of the terms, and for each place the term's row."""
    n = at[tid + 1] - at[tid]
    row = np.repeat(np.arange(len(tid)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[tid], n)
    return place, row


def _scored(index: Index, window: np.ndarray, tid: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """(passage, item, score) of what reaches the threshold, of the terms of
    whole passages."""
    spot, row = _spread(index.block_at, tid)
    n_blocks = int(index.block_no.max()) + 1
    cell, inverse = np.unique(window[row] * n_blocks + index.block_no[spot], return_inverse=True)
    kept = cell[np.bincount(inverse, weights=index.block_top[spot]) >= threshold]
    if not len(kept):
        return []
    live = np.isin(window, np.unique(kept // n_blocks))
    window, tid = window[live], tid[live]
    spot, row = _spread(index.post_at, tid)
    item = index.post_item[spot]
    cell = window[row] * n_blocks + item // BLOCK_ITEMS
    near = np.searchsorted(kept, cell)
    near[near == len(kept)] = 0
    inside = kept[near] == cell
    pair, inverse = np.unique(window[row][inside] * len(index.ids) + item[inside], return_inverse=True)
    score = np.bincount(inverse, weights=index.post_impact[spot][inside])
    good = score >= threshold - 1e-9
    return [(k // len(index.ids), k % len(index.ids), s) for k, s in zip(pair[good].tolist(), score[good].tolist())]


def search(index: Index, data: np.ndarray, offsets: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
    """(text, item, score) of all items that a passage of a text scores at
    ``threshold`` or more; the best passage counts.

    Passages are windows of twice the longest item's words that overlap by half,
    so an item always lies whole in one. A passage is dropped when its terms'
    maxima can't reach the threshold, then a block of items when its block
    maxima can't; only what is left is scored."""
    word, own = words(data, offsets)
    if not len(word):
        return []
    count = np.bincount(own, minlength=len(offsets) - 1)
    place = np.arange(len(word)) - (np.cumsum(count) - count)[own]
    at = np.searchsorted(index.terms, word)
    at[at == len(index.terms)] = 0
    hit = index.terms[at] == word
    tid, own, place = at[hit], own[hit], place[hit]
    if not len(tid):
        return []
    per = int(count.max()) // index.stride + 2
    window = own * per + place // index.stride + 1
    both = np.concatenate([window, window - 1])  # a word is in the window that starts here and in the one before
    pair = np.unique(both * len(index.terms) + np.concatenate([tid, tid]))
    window, tid = pair // len(index.terms), pair % len(index.terms)
    keys, window = np.unique(window, return_inverse=True)
    live = np.bincount(window, weights=index.top[tid])[window] >= threshold
    window, tid = window[live], tid[live]
    reach = np.cumsum(index.post_at[tid + 1] - index.post_at[tid])
    best: dict[tuple[int, int], float] = {}
    at = 0
    while at < len(tid):
        # up to POSTINGS, then back to where a passage starts, or one passage
        to = int(np.searchsorted(reach, (reach[at - 1] if at else 0) + POSTINGS, "right"))
        if to < len(tid):
            to = int(np.searchsorted(window, window[to]))
            to = to if to > at else int(np.searchsorted(window, window[at], "right"))
        for w, i, score in _scored(index, window[at:to], tid[at:to], threshold):
            where = (int(keys[w]) // per, i)
            best[where] = max(score, best.get(where, 0.0))
        at = to
    return [(t, i, s) for (t, i), s in sorted(best.items())]


HIT = "array<struct<item_id:string,bm25:double,question_overlap:double,answer_overlap:double>>"


def verified(index: Index, data: np.ndarray, offsets: np.ndarray, threshold: float, overlap: float) -> list[list[dict]]:
    """The hits of each text. An item of fewer than WORDS words is verified as a
    run of all its words; where the answer is given apart, the question's own
    share is enough, and the answer's is told."""
    out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    found = search(index, data, offsets, threshold)
    at, word, have = None, None, {}
    for t, i, score in found:
        if at != t:
            word, own = words(data[offsets[t] : offsets[t + 1]], np.array([0, offsets[t + 1] - offsets[t]]))
            at, have = t, {}
        k = index.run[i]
        if k not in have:
            have[k] = np.unique(shingles(word, own, 1, k)[0]) if len(word) >= k else np.zeros(0, np.uint64)
        grams, answer = index.grams[i], index.answer[i]
        if not len(have[k]):
            continue
        near = np.searchsorted(have[k], grams)
        near[near == len(have[k])] = 0
        there = have[k][near] == grams
        share = lambda own: float(there[own].mean()) if own.any() else 1.0
        question = share(~answer)
        if there.mean() >= overlap or index.parted[i] and (~answer).any() and question >= overlap:
            out[t].append({"item_id": index.ids[i], "bm25": score, "question_overlap": question, "answer_overlap": share(answer)})
    return out


def _items(items: DataFrame, answer_col: str | None) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    return items.select(text("item_id").alias("id"), text("text").alias("text"), (text(answer_col) if answer_col else F.lit(None).cast("string")).alias("answer")).distinct()


def shards_of(items: DataFrame, answer_col: str | None = None, limit: int = INDEX_BYTES) -> list[tuple]:
    """For each ``limit`` bytes of items (about) a condition on the rows of
    ``_items`` that are in one index, and what all items say: their number, mean
    length and terms. One index: no more is needed than its rows."""
    rows = _items(items, answer_col)
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("answer"), F.lit(0)) + 32)).first()[0] or 0
    shards = max(1, -(-total // limit))
    if shards == 1:
        return [(rows, None, None)]
    part = F.pmod(F.xxhash64("id", "text", "answer"), F.lit(shards))

    def count(batches):
        for batch in batches:
            for k, text, answer in zip(*(batch.column(c).to_pylist() for c in ("part", "text", "answer"))):
                both, _ = item_words(text, answer)
                if len(both):
                    term = np.unique(both)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(term), pa.int64()), pa.array(term.view(np.int64)), pa.array([len(both)] + [None] * (len(term) - 1), pa.int64())], ["part", "term", "length"])

    spread = staged(rows.select(part.alias("part"), "text", "answer").mapInArrow(count, "part bigint, term bigint, length bigint"), "terms")
    n, mean = spread.agg(F.count("length"), F.avg("length")).first()
    df = staged(spread.groupBy("term").agg(F.count("*").alias("df")), "df")
    own = staged(hot_join(spread.select("part", "term").distinct(), df, "term"), "own")
    return [(rows.where(part == k), own.where(F.col("part") == k).select("term", "df"), (n, mean)) for k in range(shards)]


def _index(rows: DataFrame, terms: DataFrame | None, totals: tuple | None) -> Index | None:
    """The index of one shard: its items and the counts of its own terms are all
    that is gathered."""
    stats = None
    if terms is not None:
        found = sorted((np.int64(r.term).view(np.uint64), r.df) for r in terms.collect())
        stats = (*totals, np.array([f[0] for f in found], np.uint64), np.array([f[1] for f in found], np.int64))
    return build([tuple(r) for r in rows.collect()], stats=stats)


def contamination(docs: DataFrame, items: DataFrame, keep: list[str], answer_col: str | None = None, threshold: float = THRESHOLD, overlap: float = OVERLAP, limit: int = INDEX_BYTES) -> DataFrame:
    """The columns ``keep`` of each document with ``__hits``, the test items it
    holds: those retrieved whose word shingles it has to ``overlap`` at least. A
    shingle is five words; an item of fewer words is one, found as a run. Without
    ``answer_col`` question and answer (the last sentence) are verified together;
    with it the question alone is enough as well. Both shares are told.

    Items fill indexes of ``limit`` bytes of text; counts, idf and mean length
    are those of all items, so scores don't depend on the split. One index: each
    document is searched in one pass. More: documents are numbered and written
    once, and one index after the other is sent out, searched and taken back, so
    that one is held at a time.

    Null and empty texts and items and empty tables give no hits; repeated rows
    are judged each; equal items with other ids are each reported, repeated rows
    of an item once; a ``keep`` of any names stays as it is."""
    spark = docs.sparkSession
    tune(spark)
    text = F.lower(text_column(docs))
    kind = pa.list_(pa.struct([("item_id", pa.string()), ("bm25", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))
    hit_type = T._parse_datatype_string(HIT)
    parts = shards_of(items, answer_col, limit)

    def searcher(sent):
        def work(batches):
            for part, data, offsets in chunks(batches, "__text", SEARCH_BYTES):
                hits = verified(sent.value, data, offsets, threshold, overlap) if sent.value else [[]] * part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(hits, kind)], [*part.schema.names[:-1], "__hits"])

        return work

    def searched(rows, sent):
        return rows.mapInArrow(searcher(sent), T.StructType([*rows.schema.fields[:-1], T.StructField("__hits", hit_type)]))

    if len(parts) == 1:
        return searched(docs.select(*keep, text.alias("__text")), spark.sparkContext.broadcast(_index(*parts[0])))
    rows = staged(docs.select(*keep, text.alias("__text")).withColumn("__rid", F.monotonically_increasing_id()), "numbered")
    found = None
    for part in parts:
        sent = spark.sparkContext.broadcast(_index(*part))
        own = staged(searched(rows.select("__rid", "__text"), sent).where(F.size("__hits") > 0), "hits")
        sent.destroy()
        found = own if found is None else found.unionByName(own)
    hits = found.groupBy("__rid").agg(F.flatten(F.collect_list("__hits")).alias("__hits"))
    return rows.drop("__text").join(hits, "__rid", "left").select(*keep, F.coalesce("__hits", F.array().cast(hit_type)).alias("__hits"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and test item that it holds."""
    items = table(spark, sf_dir, "benchmark")
    found = contamination(table(spark, sf_dir, "documents"), items, ["doc_id"])
    hits = found.select("doc_id", F.explode("__hits").alias("x"))
    return hits.select("doc_id", F.col("x.item_id").cast("bigint").alias("item_id"), "x.bm25", "x.question_overlap", "x.answer_overlap")
