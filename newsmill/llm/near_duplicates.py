"""N-gram Jaccard join: MinHash bands find candidates, full sets verify them."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmill.llm._common import FEW_ROWS, HOT, chunks, groups, hot_join, new_path, scratch, staged, table, text_column, tune
from newsmill.llm._components import components
from newsmill.llm._words import hashes, mix, shingles, spans

SIZE = 5
SIMILARITY = 0.8
RECALL = 0.9999
ROWS = 6
#: Shingles that a verifying task holds of one block, about; a text counts as
#: LEAST of them at least, so a block holds BLOCK / LEAST texts at most.
BLOCK = 1_500_000
LEAST = 500
SMALLEST = -(2**63)
#: A group of more than TEAM texts is cut into blocks of about TEAM for several
#: tasks, up to TEAMS of them; beyond that blocks grow, then BLOCK bounds them.
TEAM, TEAMS = 96, 32
#: A shingle in more texts of a block than this is counted by matrix products.
DENSE = 24
#: Rows of a block that are compared at once.
SOME = 256


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` hashes that find a pair of this similarity with at least
    the chance ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))


def text_sets(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    starts, ends, own = spans(data, offsets)
    grams, text = shingles(hashes(data, starts, ends), own, len(offsets) - 1, size)
    cuts = np.searchsorted(text, np.arange(len(offsets)))
    return [np.unique(grams[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def digest_of(grams: np.ndarray, raw: bytes) -> bytes:
    """Equal for texts with equal shingle sets; a text without words: equal for
    equal texts."""
    return hashlib.blake2b(grams.tobytes() if len(grams) else b"text:" + raw, digest_size=16).digest()


class Bands:
    def __init__(self, n: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 2**31, n * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, n * rows, dtype=np.uint32)[:, None]
        self.n, self.rows = n, rows

    def of(self, grams: np.ndarray) -> np.ndarray:
        """The band hashes of a set; a band's number is part of its hash."""
        x = (grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.n * self.rows, 2**32 - 1, np.uint32)
        for at in range(0, len(x), 2048):
            np.minimum(least, (self.a * x[at : at + 2048] + self.b).min(axis=1), out=least)
        value = np.arange(self.n, dtype=np.uint64)
        for column in least.reshape(self.n, self.rows).T.astype(np.uint64):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + column)
        return value.view(np.int64)


def links_between(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """Boolean matrix of the pairs whose Jaccard similarity is reached: of ``left``
    by ``right``, or without ``right`` of the sets among themselves (a half is
    counted, then mirrored). The counts of common shingles are the one matrix of
    numbers; what follows goes by some rows at a time."""
    sets = left if right is None else left + right
    n, n_left = len(sets), len(left)
    first_column = 0 if right is None else n_left
    sizes = np.array([len(s) for s in sets], np.int64)
    value = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    member = np.repeat(np.arange(n), sizes)
    order = np.argsort(value, kind="stable")
    value, member = value[order], member[order]
    first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(value)))
    width = n - first_column
    common = np.zeros((n_left, width), np.float32)
    for c in range(2, DENSE + 1):
        at = first[count == c]
        if len(at):
            rows = member[at[:, None] + np.arange(c)]  # members ascend inside a shingle
            for i in range(c):
                for j in range(i + 1, c):
                    a, b = rows[:, i], rows[:, j]
                    if right is not None:
                        across = (a < n_left) & (b >= n_left)
                        a, b = a[across], b[across]
                    pair, times = np.unique(a * width + b - first_column, return_counts=True)
                    common.ravel()[pair] += times
    wide = np.flatnonzero(count > DENSE)
    for k in range(0, len(wide), 1024):
        own = wide[k : k + 1024]
        dense = np.zeros((n, len(own)), np.float32)
        reps = count[own]
        column = np.repeat(np.arange(len(own)), reps)
        place = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(first[own], reps)
        dense[member[place], column] = 1.0
        for at in range(0, n_left, SOME):
            common[at : at + SOME] += dense[at : min(at + SOME, n_left)] @ dense[first_column:].T
    linked = np.zeros(common.shape, bool)
    for at in range(0, n_left, SOME):
        own = common[at : at + SOME]
        total = sizes[at : at + len(own), None] + sizes[None, first_column:]
        linked[at : at + SOME] = (own * (1 + similarity) >= similarity * total - 1e-3) & (own > 0)
    if right is None:
        linked = np.triu(linked, 1)
        linked |= linked.T.copy()
    return linked


def roots(linked: np.ndarray, n: int) -> np.ndarray:
    """The least index that each of n indexes is joined with; ``linked`` is square,
    or of the first indexes by the last."""
    n_left, width = linked.shape
    label = np.arange(n)
    while True:
        new = label.copy()
        by_column = np.full(width, n)
        for at in range(0, n_left, SOME):
            own = linked[at : at + SOME]
            rows = slice(at, at + len(own))
            new[rows] = np.minimum(new[rows], np.where(own, label[None, n - width :], n).min(axis=1, initial=n))
            by_column = np.minimum(by_column, np.where(own, label[rows, None], n).min(axis=0, initial=n))
        new[n - width :] = np.minimum(new[n - width :], by_column)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def linked_copies(linked: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """For each index the copies of all that it is linked with."""
    n_left, width = linked.shape
    out = np.zeros(len(copies), np.int64)
    for at in range(0, n_left, SOME):
        own = linked[at : at + SOME]
        out[at : at + len(own)] += own @ copies[len(copies) - width :]
        if width != len(copies):
            out[n_left:] += copies[at : at + len(own)] @ own
    return out


def join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS, size: int = SIZE) -> DataFrame:
    """``doc_id, class_id, n_links, n_copies`` for each document.

    Texts are linked when the Jaccard similarity of their sets of ``size``
    consecutive words is ``similarity`` or more. class_id is the least doc_id of
    all documents that links join; n_links counts the documents linked with this
    one, its copies included; n_copies counts documents with an equal set.

    Copies are one class from the start, by a grouped minimum. Band hashes of
    classes are shuffled; the classes of a bucket are tied to its least, never
    paired. What that ties together is a candidate group, cut into blocks of
    bounded size (a large group into 32 at least, so that many tasks share it); a
    task verifies two blocks on full sets and returns sums and a spanning forest,
    never the pairs. Counting the links of a group takes time by the square of
    its number of different texts, as it may have that many links. A pair at the threshold is a candidate with
    the chance ``recall``, a closer pair with a higher one.

    Null texts are empty. A text of 1 to size-1 words has one shingle; texts
    without words are linked to equal texts only. Null ids work as the least id
    and stay null; rows with a repeated id are documents of their own. An empty
    table gives no rows; other columns don't matter."""
    path = new_path(docs.sparkSession, "joined")
    null = lambda c: F.nullif(F.col(c), F.lit(SMALLEST))
    with scratch(docs.sparkSession):
        signed, whole = _joined(docs, similarity, recall, rows, size)
        found = hot_join(signed.select("key", "digest"), whole.drop("first"), "digest")
        return staged(found.select(null("key").alias("doc_id"), null("class_id").alias("class_id"), "n_links", "n_copies"), "joined", path)


def _keys(docs: DataFrame) -> tuple:
    """What names a row: its id, and the sum of its text, as ids repeat."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(SMALLEST)), F.unhex(F.md5(text_column(docs)))


def _joined(docs: DataFrame, similarity: float, recall: float, rows: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Key and digest of each row, and of each digest its class; ``first`` (key,
    digest, sum) is the least row of the class."""
    spark = docs.sparkSession
    tune(spark)
    n_bands = bands_for(similarity, recall, rows)
    key, total = _keys(docs)
    source = docs.select(key.alias("key"), total.alias("sum"), text_column(docs).alias("text"))

    def sign(batches):
        bands = Bands(n_bands, rows)
        for part, data, offsets in chunks(batches, "text"):
            sets = text_sets(data, offsets, size)
            raw = data.tobytes()
            digest = [digest_of(g, raw[a:b]) for g, a, b in zip(sets, offsets[:-1], offsets[1:])]
            found = [bands.of(g) if len(g) else np.zeros(0, np.int64) for g in sets]
            at = np.concatenate(([0], np.cumsum([len(f) for f in found])))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(digest, pa.binary()), pa.array([len(g) for g in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(found), pa.int64()))],
                ["key", "sum", "digest", "n", "bands"],
            )

    signed = staged(source.mapInArrow(sign, "key bigint, sum binary, digest binary, n bigint, bands array<bigint>"), "signed")
    classes = staged(signed.groupBy("digest").agg(F.min(F.struct("key", "sum", "n", "bands")).alias("m"), F.count("*").alias("copies")).select("digest", F.col("m.key").alias("rep"), F.col("m.sum").alias("sum"), F.col("m.n").alias("n"), "copies", F.col("m.bands").alias("bands")), "classes")

    bucket = classes.select("digest", F.explode("bands").alias("band"))
    shared = staged(bucket.groupBy("band").agg(F.min("digest").alias("least"), F.count("*").alias("n")).where("n > 1"), "shared")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [r.band for r in shared.where(F.col("n") > max(FEW_ROWS, total / HOT)).collect()]  # fewer than HOT
    star = hot_join(bucket, shared.drop("n"), "band", hot=hot).where("least <> digest")
    group = components(star.select(F.col("least").alias("a"), F.col("digest").alias("b")))

    weight = F.greatest(F.col("n"), F.lit(LEAST))
    member = group.withColumnRenamed("node", "digest").join(classes.drop("bands"), "digest")
    spread = F.least(F.ceil(F.count("*") / F.lit(TEAM)), F.lit(TEAMS))
    blocks = member.groupBy("component").agg(F.greatest(F.ceil(F.sum(weight) / F.lit(BLOCK)), spread).alias("blocks"))
    member = hot_join(member, blocks, "component").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")))
    texts = member.select("component", "digest", "copies", "blocks", "block", F.col("rep").alias("key"), "sum").join(source, ["key", "sum"]).dropDuplicates(["key", "sum"])
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    dealt = texts.withColumn("other", other).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "digest", "copies", "text")
    dealt = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")

    def verify(batches):
        out: list[tuple[bytes, bytes, int]] = []
        for (_, i, j), rows_ in groups(batches, ["component", "i", "j"]):
            own: dict[bytes, tuple] = {}
            texts_ = rows_.column("text").to_pylist()
            raw = [t.encode() for t in texts_]
            for d, b, c, r in zip(rows_.column("digest").to_pylist(), rows_.column("block").to_pylist(), rows_.column("copies").to_pylist(), raw):
                if d in own:
                    continue
                grams = text_sets(np.frombuffer(r, np.uint8), np.array([0, len(r)]), size)[0]
                own[d] = (b, c, grams)
            keys = sorted(own, key=lambda d: (own[d][0], d))
            left = [d for d in keys if own[d][0] == i]
            right = [d for d in keys if own[d][0] != i]
            linked = links_between([own[d][2] for d in left], [own[d][2] for d in right] if i != j else None, similarity)
            copies = np.array([own[d][1] for d in keys], np.int64)
            label, sums = roots(linked, len(keys)), linked_copies(linked, copies)
            out += [(d, keys[label[k]], int(sums[k])) for k, d in enumerate(keys)]
            if len(out) > 5000:
                yield _links(out)
                out = []
        yield _links(out)

    found = staged(dealt.mapInArrow(verify, "digest binary, root binary, links bigint"), "links")
    label = components(found.where("digest <> root").select(F.col("digest").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy("digest").agg(F.sum("links").alias("links"))
    whole = classes.select("digest", "rep", "sum", "copies").join(degree, "digest", "left").join(label.withColumnsRenamed({"node": "digest", "component": "root"}), "digest", "left")
    whole = whole.withColumn("root", F.coalesce("root", "digest"))
    least = whole.groupBy("root").agg(F.min(F.struct(F.col("rep").alias("key"), "digest", "sum")).alias("first"))
    return signed, hot_join(whole, least, "root").select("digest", "first", F.col("first.key").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))


def _links(rows: list[tuple[bytes, bytes, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["digest", "root", "links"])


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near duplicates: of each class one row stays whole,
    that with the least doc_id (null first), then the least digest. Null texts
    are empty and one class; columns of any name stay as they are."""
    kept = _joined(docs, SIMILARITY, RECALL, ROWS, SIZE)[1].select(F.col("first.key").alias("__key"), F.col("first.sum").alias("__sum")).distinct()
    key, total = _keys(docs)
    keyed = docs.withColumns({"__key": key, "__sum": total})
    return keyed.join(kept, ["__key", "__sum"], "left_semi").dropDuplicates(["__key", "__sum"]).select(docs.columns)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; edge cases as ``join`` says."""
    return join(table(spark, sf_dir, "documents"))
