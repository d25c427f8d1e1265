"""Quartile bucket digests of texts.

Hashed byte triplets of a text are counted in 256 buckets. The digest holds, for
each bucket, which quartile of the counts it falls in (two bits), with codes for
the length and for the ratios of the quartiles."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmill.llm._common import CHUNK_BYTES, chunks, table, text_column, tune

BUCKETS = 256
#: Places of the three bytes inside a window of five.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
SALTS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646D)
#: Body difference at which digests count as unrelated: what independent
#: uniform quartiles give, 1.625 a bucket.
UNRELATED = 416.0
#: Bytes of text in a range of ids, about.
RANGE_BYTES = 64 << 20
SMALLEST = -(2**63)


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of 66 bytes for each text: length code, quartile ratios, body."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    counts = np.zeros(n * BUCKETS, np.int64)
    if len(data):
        wide = data.astype(np.uint32)
        end = np.repeat(offsets[1:], sizes)
        base = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, sizes)
        room = end - np.arange(len(data))
        for (a, b, c), salt in zip(TRIPLETS, SALTS):
            last = len(data) - c
            if last <= 0:
                continue
            code = wide[a : a + last] | (wide[b : b + last] << np.uint32(8)) | (wide[c : c + last] << np.uint32(16))
            bucket = (((code + np.uint32(1)) * np.uint32(salt)) >> np.uint32(24)).astype(np.int64)
            inside = room[:last] > c
            counts += np.bincount((base[:last] + bucket)[inside], minlength=len(counts))
    counts = counts.reshape(n, BUCKETS)
    ordered = np.sort(counts, axis=1)
    q1, q2, q3 = (ordered[:, k * BUCKETS // 4 - 1][:, None] for k in (1, 2, 3))
    body = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8).reshape(n, BUCKETS // 4, 4)
    packed = body[:, :, 0] | (body[:, :, 1] << 2) | (body[:, :, 2] << 4) | (body[:, :, 3] << 6)
    length = np.minimum(255, np.round(12 * np.log2(1.0 + sizes))).astype(np.uint8)[:, None]
    safe = np.maximum(q3, 1)
    ratio = ((np.minimum(15, q1 * 16 // safe) << 4) | np.minimum(15, q2 * 16 // safe)).astype(np.uint8)
    return np.concatenate([length, ratio, packed], axis=1)


_CODES = np.stack([(np.arange(256) >> s) & 3 for s in (0, 2, 4, 6)], axis=1)
_STEP = np.array([0, 1, 2, 6])
#: Difference of two packed bytes of four buckets.
DIFFERENCE = _STEP[np.abs(_CODES[:, None, :] - _CODES[None, :, :])].sum(axis=2).astype(np.int32)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests down to 0 for a difference of UNRELATED or more."""
    body = DIFFERENCE[a[:, 2:], b[:, 2:]].sum(axis=1).astype(float)
    length = np.abs(a[:, 0].astype(int) - b[:, 0].astype(int))
    ratio = np.abs((a[:, 1] >> 4).astype(int) - (b[:, 1] >> 4)) + np.abs((a[:, 1] & 15).astype(int) - (b[:, 1] & 15))
    return np.maximum(0.0, 1.0 - (body + length + 2.0 * ratio) / UNRELATED)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a ``fingerprint`` (hex) of each whole text; null: empty."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_column(docs, text_col).alias("text"))

    def work(batches):
        for part, data, offsets in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes().hex() for r in digests(data, offsets)], pa.string())], ["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Each document with digests of its text and of its edited text, and the
    likeness of its digest to that of the edited text and of the next document.

    Documents are taken by descending doc_id (null ids last; rows of one id by
    the bytes of their compressed text, which is any order but a fixed one). The edited text has the last floor(n/3) code points replaced by
    the first as many (or all) of the next document; after the last comes the
    first, so a single document is its own neighbour. Null texts are empty. Rows
    that repeat keep a row each. An empty table gives no rows; other columns
    don't matter.

    Ids alone are dealt out by range to find the largest id of each range; each
    text is then shuffled once, compressed, to its range, and the first document
    of a range goes to the range before it as well. Tasks stream over their
    sorted rows and hold a few texts at a time."""
    spark = docs.sparkSession
    tune(spark)
    size = docs.agg(F.sum(F.octet_length(text_column(docs)))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(SMALLEST))
    ids = docs.select(key.alias("key"))
    found = ids.repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.max("key").alias("top")).collect()
    bounds = np.array(sorted(r.top for r in found), np.int64)  # a number for each shuffle partition
    rows = docs.select("doc_id", key.alias("key"), text_column(docs).alias("text"))

    def deal(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            bucket = np.searchsorted(bounds, keys, "left")
            z = [packer.compress(t.encode()) for t in batch.column(2).to_pylist()]
            z = pa.array(z, pa.binary())
            edge = np.flatnonzero(bounds[bucket] == keys) if len(keys) else np.zeros(0, int)
            at = pa.array(np.concatenate([np.arange(len(keys)), edge]))
            to = np.concatenate([bucket, (bucket[edge] + 1) % len(bounds)]) if len(keys) else bucket
            extra = np.arange(len(to)) >= len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(extra), batch.column(0).cast(pa.int64()).take(at), batch.column(1).take(at), z.take(at)], ["bucket", "extra", "doc_id", "key", "z"])

    dealt = rows.mapInArrow(deal, "bucket bigint, extra boolean, doc_id bigint, key bigint, z binary")
    sorted_ = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "extra", F.desc("key"), "z")

    def compare(batches):
        opener = zstandard.ZstdDecompressor()
        held: list[tuple] = []  # (bucket, extra, doc_id, text); the last waits for its next

        def emit():
            texts = [t for *_, t in held]
            own = digests(*_joined([t.encode() for t in texts]))
            pairs = [i for i in range(len(held) - 1) if not held[i][1] and held[i][0] == held[i + 1][0]]
            edited = []
            for i in pairs:
                n = len(texts[i])
                edited.append((texts[i][: n - n // 3] + texts[i + 1][: n // 3]).encode())
            if not pairs:
                return None
            other = digests(*_joined(edited))
            at = np.array(pairs)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([held[i][2] for i in pairs], pa.int64()),
                    pa.array([len(texts[i]) for i in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                    pa.array([own[i].tobytes().hex() for i in pairs], pa.string()),
                    pa.array([r.tobytes().hex() for r in other], pa.string()),
                    pa.array(likeness(own[at], other)),
                    pa.array(likeness(own[at], own[at + 1])),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        room = CHUNK_BYTES
        for batch in batches:
            for bucket, extra, doc_id, _, z in zip(*(c.to_pylist() for c in batch.columns)):
                text = opener.decompress(z).decode()
                held.append((bucket, extra, doc_id, text))
                room -= len(text)
                if room < 0:
                    if (made := emit()) is not None:
                        yield made
                    held, room = held[-1:], CHUNK_BYTES
        if held and (made := emit()) is not None:
            yield made

    return sorted_.mapInArrow(compare, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; edge cases as ``compare_neighbours`` says."""
    return compare_neighbours(table(spark, sf_dir, "documents"))
