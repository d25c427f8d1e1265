"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

Texts are dealt into bounded buckets so that equal strings of ``length`` bytes
always meet: a string belongs to the bucket of the least hash (minimizer) of the
grams inside it. Neighbouring strings with one minimizer travel as one piece of
text, and only pieces whose minimizer is found in two documents travel at all.

In a bucket the pieces are cut into shards. Each shard's suffixes are sorted to
the depth that matters, which gives its transform (the byte before each suffix).
The transforms are then merged without sorting suffixes again: an interleave of
the shards that is right for the first k bytes gives, by one stable pass over the
two bytes before, the interleave for k+2 bytes; the pass in which two neighbours
part first tells their common prefix. The intervals between neighbours that part
before ``length`` bytes are the sets of equal strings of that length."""

from __future__ import annotations

import functools
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmill.llm._common import chunks, groups, new_path, scratch, staged, table, text_column, tune

LENGTH = 50
#: Bytes of text in one row of the staged texts (or one longer text).
CHUNK = 8 << 20
#: Bytes of input text for each bucket; about a tenth of that is merged there.
BUCKET = 8 << 20
#: Bytes of pieces whose suffixes are sorted at once.
SHARD = 256 << 10
#: A minimizer with more pieces than this has each of its strings dealt alone, by
#: a hash of the whole string, so that no bucket grows with one common passage.
HOT = 50_000
#: Most strings in one piece, and starts looked at at once.
MOST, STEP = 64, 1 << 18
#: Pieces whose bytes are compared at once.
SOME = 1 << 13
SMALLEST = -(2**63)
NEVER = 2**63 - 1
_ODD = 0x9E3779B97F4A7C15


@functools.cache
def _hashing() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte; powers of an odd number, and their inverses
    modulo 2**64, so that differences of running sums are hashes of substrings."""
    numbers = np.random.default_rng(50).integers(0, 2**63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    n = STEP + 4096
    powers = []
    for x in (_ODD, pow(_ODD, -1, 2**64)):
        steps = np.full(n, x, np.uint64)
        steps[0] = 1
        powers.append(np.cumprod(steps, dtype=np.uint64))
    return numbers, *powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _sums(block: np.ndarray) -> np.ndarray:
    numbers, powers, _ = _hashing()
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(numbers[block] * powers[: len(block)], dtype=np.uint64)])


def pieces(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All strings of ``length`` bytes inside the texts, as runs of neighbours with
    one minimizer: first start, number of strings, 48-bit minimizer, text."""
    gram = max(1, length // 2 - 1)
    wide = length - gram + 1
    inverse = _hashing()[2]
    found = []
    for a in range(0, max(0, len(data) - length + 1), STEP):
        to = min(a + STEP, len(data) - length + 1)
        block = data[a : to + length - 1]
        sums = _sums(block)
        m = _mix((sums[gram:] - sums[:-gram]) * inverse[: len(block) - gram + 1])
        span = 1
        while span * 2 <= wide:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if span < wide:
            m = np.minimum(m[: span - wide], m[wide - span :])
        cut = np.append(True, m[1:] != m[:-1])
        marks = np.concatenate([offsets, offsets[1:] - length + 1]) - a
        cut[marks[(marks >= 0) & (marks < len(cut))]] = True
        first = np.flatnonzero(cut)
        n = np.diff(np.append(first, len(m)))
        least, first = m[first], first + a
        text = np.searchsorted(offsets, first, "right") - 1
        inside = first + length <= offsets[text + 1]
        found.append((first[inside], n[inside], _mix(least[inside] * np.uint64(_ODD)) >> np.uint64(16), text[inside]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none
    start, n, least, text = (np.concatenate(x) for x in zip(*found))
    many = -(-n // MOST)
    if len(many) and many.max() > 1:
        part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start, n = np.repeat(start, many) + part * MOST, np.minimum(np.repeat(n, many) - part * MOST, MOST)
        least, text = np.repeat(least, many), np.repeat(text, many)
    return start, n, least, text


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def _distinct(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the substrings, one of each set of equal ones, and the number of its set
    for each. Sets come by a hash and are checked byte by byte; where a hash has
    two texts, by the bytes alone."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    numbers, powers, _ = _hashing()
    h = np.empty(len(start), np.uint64)
    some = [slice(a, a + SOME) for a in range(0, len(start), SOME)]
    for k in some:
        at = np.cumsum(size[k]) - size[k]
        h[k] = np.add.reduceat(numbers[data[_ranges(start[k], size[k])]] * powers[_ranges(np.zeros_like(at), size[k])], at)
    h = h * np.uint64(_ODD) + size.astype(np.uint64)
    _, one, of = np.unique(h, return_index=True, return_inverse=True)
    other = one[of]
    if (size == size[other]).all() and all((data[_ranges(start[k], size[k])] == data[_ranges(start[other[k]], size[k])]).all() for k in some):
        return one, of
    raw = np.empty(len(start), object)
    raw[:] = [data[s : s + k].tobytes() for s, k in zip(start.tolist(), size.tolist())]
    _, one, of = np.unique(raw, return_index=True, return_inverse=True)
    return one, of


def transform(text: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the text, read in a circle, to at least ``depth`` bytes, and
    the transform: the byte before each suffix in that order."""
    key = np.zeros(len(text), np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | np.roll(text, -k).astype(np.uint64)
    width = 8
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        parted = np.append(False, sorted_[1:] != sorted_[:-1])
        if width >= depth or parted[1:].all():
            return order, text[order - 1]
        rank = np.empty(len(text), np.uint64)
        rank[order] = np.cumsum(parted).astype(np.uint64)
        key = rank * np.uint64(len(text)) + np.roll(rank, -width)
        width *= 2


def merge(transforms: list[np.ndarray], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of the suffixes (numbered shard by shard, in the shard's order)
    to ``depth`` bytes, and for each place in it the common prefix with the place
    before: ``depth``, or less (whole passes, two bytes each) where they part.

    The suffix that starts a byte earlier follows from the transform by counting;
    texts are never looked at."""
    whole = np.concatenate(transforms)
    back = np.empty(len(whole), np.int32)
    at = 0
    for t in transforms:
        back[at + np.argsort(t, kind="stable")] = np.arange(at, at + len(t), dtype=np.int32)
        at += len(t)
    steps = [(whole[back].astype(np.uint16) << 8 | whole, back[back], 2)] * (depth // 2) + [(whole, back, 1)] * (depth % 2)
    order, interval = np.arange(len(whole), dtype=np.int32), np.zeros(len(whole), np.int32)
    common = np.full(len(whole), depth, np.uint16)
    common[:1] = 0
    done = 0
    for before, earlier, width in steps:
        read = before[order]
        by = np.argsort(read, kind="stable")
        read, interval = read[by], interval[by]
        parted = np.append(False, (read[1:] != read[:-1]) | (interval[1:] != interval[:-1]))
        order = earlier[order[by]]
        common[parted & (common == depth)] = done
        interval = np.cumsum(parted, dtype=np.int32)
        done += width
    return order, common


def least_keys(data: np.ndarray, start: np.ndarray, n: np.ndarray, key: np.ndarray, length: int = LENGTH, shard: int = SHARD) -> np.ndarray:
    """For each string of each piece (a piece has n strings, so n + length - 1
    bytes, and its document's key) the least key among all equal strings."""
    size = n + length - 1
    shards = np.cumsum(size) // shard
    transforms, numbers = [], []
    before = np.cumsum(n) - n
    for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(shards)) + 1):
        order, bwt = transform(data[_ranges(start[part], size[part])], length)
        number = np.full(len(order), -1, np.int64)
        number[_ranges(np.cumsum(size[part]) - size[part], n[part])] = _ranges(before[part], n[part])
        transforms.append(bwt)
        numbers.append(number[order])
    order, common = merge(transforms, length)
    number = np.concatenate(numbers)[order]
    held = np.where(number >= 0, np.repeat(key, n)[number], NEVER)
    first = np.flatnonzero(common < length)
    least = np.repeat(np.minimum.reduceat(held, first), np.diff(np.append(first, len(held))))
    out = np.empty(int(n.sum()), np.int64)
    out[number[number >= 0]] = least[number >= 0]
    return out


def _meets(data: np.ndarray, start: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Whether a piece of different ones can hold a string of another: one with
    its minimizer, of which some have more than one string."""
    size = n + length - 1
    _, _, least, text = pieces(data[_ranges(start, size)], np.cumsum(np.append(0, size)), length)
    own = np.empty(len(n), np.uint64)
    own[text] = least
    _, of, many = np.unique(own, return_inverse=True, return_counts=True)
    return ((many > 1) & (np.bincount(of, weights=n > 1) > 0))[of]


def _hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of each string of ``length`` bytes of the text."""
    inverse = _hashing()[2]
    found = [np.zeros(0, np.uint64)]
    for a in range(0, len(data) - length + 1, STEP):
        to = min(a + STEP, len(data) - length + 1)
        sums = _sums(data[a : to + length - 1])
        found.append(_mix((sums[length:] - sums[:-length]) * inverse[: to - a]))
    return np.concatenate(found)


def _repeated(data: np.ndarray, start: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of strings inside the pieces whose hash another of their strings
    has: piece, first string (from the piece's start) and number of strings. Equal
    strings have one hash, so a string outside the runs is found once."""
    size = n + length - 1
    h = _hashes(data[_ranges(start, size)], length)[_ranges(np.cumsum(size) - size, n)]
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return (np.zeros(0, np.int64),) * 3
    held = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
    piece, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    begins = held.copy()
    begins[1:] &= ~held[:-1] | (piece[1:] != piece[:-1])
    at = np.flatnonzero(begins)
    many = np.add.reduceat(held.astype(np.int64), at)
    return piece[at], at - first[piece[at]], many


def _row(*values) -> pa.RecordBatch:
    names = ["chunk", "bucket", "a", "b", "c"][: len(values)]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in values], names)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _wide(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = x.reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _by_bucket(bucket: np.ndarray):
    """Each bucket with the places that are in it, in their order."""
    order = np.argsort(bucket, kind="stable")
    held = bucket[order]
    for part in np.split(order, np.flatnonzero(held[1:] != held[:-1]) + 1):
        if len(part):
            yield int(bucket[part[0]]), part


def _shared(batch: pa.RecordBatch, i: int, buckets: int, length: int):
    """The texts of a staged row, its pieces that other documents may share (with
    the strings of hot minimizers alone), the distinct ones and their buckets."""
    ids, offsets, data = (_unpack(batch.column(k)[i].as_py(), t) for k, t in (("ids", np.int64), ("offsets", np.int64), ("data", np.uint8)))
    start, n, least, text = pieces(data, offsets, length)
    distinct, of = np.unique(least, return_inverse=True)
    code = np.zeros(len(distinct), np.uint8)
    codes = {x["bucket"]: x["a"] for x in batch.column("codes")[i].as_py() or []}
    for bucket, part in _by_bucket((distinct % np.uint64(buckets)).astype(np.int64)):
        code[part] = _unpack(codes[bucket], np.uint8)
    code = code[of]
    hot = code == 2
    plain = code == 1
    alone = _ranges(start[hot], n[hot])
    start, n, text = np.concatenate([start[plain], alone]), np.concatenate([n[plain], np.ones(len(alone), np.int64)]), np.concatenate([text[plain], np.repeat(text[hot], n[hot])])
    size = n + length - 1
    one, same = _distinct(data, start, size)
    key = np.full(len(one), NEVER, np.int64)
    np.minimum.at(key, same, ids[text])
    by = least[plain]
    if len(alone):
        by = np.concatenate([by, _hashes(data, length)[alone] >> np.uint64(16)])
    return ids, offsets, data, start, n, text, one, same, key, (by[one] % np.uint64(buckets)).astype(np.int64)


def remove_repeats(docs: DataFrame, length: int = LENGTH, chunk: int = CHUNK, bucket: int = BUCKET, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """Each document with its bytes, the bytes and runs removed and the digest of
    what is left. A byte goes if a string of ``length`` bytes over it also starts
    in a document with a smaller doc_id. Null ids count as the least, null texts
    are empty; rows of one id don't remove each other's bytes.

    A task holds one staged row (``chunk``) or one bucket; the number of buckets
    grows with the text. Empty tables give no rows, repeated rows keep a row each
    and other columns don't matter. The texts' table and what lies between are
    dropped when the result is written to the shared folder."""
    spark = docs.sparkSession
    tune(spark)
    path, name = new_path(spark, "cut"), f"newsmill_{uuid.uuid4().hex}"
    with scratch(spark):
        try:
            return staged(_removed(docs, name, length, chunk, bucket, shard, hot), "cut", path)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def _removed(docs: DataFrame, name: str, length: int, chunk: int, bucket: int, shard: int, hot: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(SMALLEST)).alias("key"), text_column(docs).alias("text"))

    def stage(batches):
        number = TaskContext.get().partitionId() << 32
        for part, data, offsets in chunks(batches, "text", chunk):
            ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(data)], pa.int64()), *(pa.array([_pack(x)], pa.binary()) for x in (ids, offsets, data))], ["chunk", "bytes", "ids", "offsets", "data"])
            number += 1

    # A table in buckets by chunk: the two joins below don't shuffle the texts.
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = rows.mapInArrow(stage, "chunk bigint, bytes bigint, ids binary, offsets binary, data binary")
    made.write.bucketBy(width, "chunk").option("path", new_path(spark, "texts")).option("compression", "none").format("parquet").saveAsTable(name)
    texts = spark.table(name)
    total = texts.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = max(width, -(-total // bucket))
    texts = texts.drop("bytes")

    def hashes(batches):
        for batch in batches:
            for number, offsets, data in zip(*(c.to_pylist() for c in batch.columns)):
                start, _, least, text = pieces(_unpack(data, np.uint8), _unpack(offsets, np.int64), length)
                order = np.argsort(least, kind="stable")
                least, text = least[order], text[order]
                first = np.flatnonzero(np.append(True, least[1:] != least[:-1])) if len(least) else np.zeros(0, np.int64)
                many = np.diff(np.append(first, len(least)))
                code = np.minimum(many, 2**15 - 1).astype(np.uint16) * 2 + (text[first] != text[first + many - 1])
                distinct = least[first]
                for b, part in _by_bucket((distinct % np.uint64(buckets)).astype(np.int64)):
                    yield _row(number, b, _narrow(distinct[part]).tobytes(), _pack(code[part]))

    def count(batches):
        for (b,), held in groups(batches, ["bucket"]):
            numbers, codes = held.column("chunk").to_pylist(), [_unpack(x, np.uint16) for x in held.column("b").to_pylist()]
            least = np.concatenate([_wide(np.frombuffer(x, np.uint8)) for x in held.column("a").to_pylist()])
            code = np.concatenate(codes).astype(np.int64)
            _, of, rows_ = np.unique(least, return_inverse=True, return_counts=True)
            many = np.bincount(of, weights=code >> 1)
            shared = (rows_ > 1) | (np.bincount(of, weights=code & 1) > 0)
            out = np.where(shared, np.where(many > hot, 2, 1), 0).astype(np.uint8)[of]
            at = np.cumsum([0, *map(len, codes)])
            for k, number in enumerate(numbers):
                yield _row(number, b, _pack(out[at[k] : at[k + 1]]))

    dealt = texts.select("chunk", "offsets", "data").mapInArrow(hashes, "chunk bigint, bucket bigint, a binary, b binary")
    counted = staged(dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "chunk bigint, bucket bigint, a binary"), "codes")
    back = lambda df, name: df.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "a")).alias(name)).hint("shuffle_hash")
    known = texts.join(back(counted, "codes"), "chunk", "left")

    def send(batches):
        for batch in batches:
            for i, number in enumerate(batch.column("chunk").to_pylist()):
                _, _, data, start, n, _, one, _, key, where = _shared(batch, i, buckets, length)
                for b, part in _by_bucket(where):
                    own = one[part]
                    yield _row(number, b, _pack(n[own].astype(np.uint8)), _pack(data[_ranges(start[own], n[own] + length - 1)]), _pack(key[part]))

    def join(batches):
        for (b,), held in groups(batches, ["bucket"]):
            numbers = held.column("chunk").to_pylist()
            sizes, datas, keys = ([_unpack(x, t) for x in held.column(c).to_pylist()] for c, t in (("a", np.uint8), ("b", np.uint8), ("c", np.int64)))
            n, data, key = np.concatenate(sizes).astype(np.int64), np.concatenate(datas), np.concatenate(keys)
            del datas
            start = np.cumsum(n + length - 1) - (n + length - 1)
            one, same = _distinct(data, start, n + length - 1)
            least = np.full(len(one), NEVER, np.int64)
            np.minimum.at(least, same, key)
            meet = _meets(data, start[one], n[one], length)
            found = np.repeat(least, n[one])
            first = np.cumsum(n[one]) - n[one]
            near = np.flatnonzero(meet)
            piece, skip, many = _repeated(data, start[one[near]], n[one[near]], length)
            if len(piece):
                piece = near[piece]
                found[_ranges(first[piece] + skip, many)] = least_keys(data, start[one[piece]] + skip, many, least[piece], length, shard)
            at = np.cumsum([0, *map(len, sizes)])
            for k, number in enumerate(numbers):
                own = slice(at[k], at[k + 1])
                yield _row(number, b, _pack(found[_ranges(first[same[own]], n[own])]))

    sent = known.mapInArrow(send, "chunk bigint, bucket bigint, a binary, b binary, c binary")
    merged = staged(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(join, "chunk bigint, bucket bigint, a binary"), "least")

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, offsets, data, start, n, text, one, same, _, where = _shared(batch, i, buckets, length)
                least = np.empty(int(n[one].sum()), np.int64)
                first = np.cumsum(n[one]) - n[one]
                found = {x["bucket"]: x["a"] for x in batch.column("least")[i].as_py() or []}
                for b, part in _by_bucket(where):
                    least[_ranges(first[part], n[one][part])] = _unpack(found[b], np.int64)
                hit = least[_ranges(first[same], n)] < np.repeat(ids[text], n)
                at = _ranges(start, n)[hit]
                step = np.zeros(len(data) + length + 1, np.int32)
                np.add.at(step, at, 1)
                np.add.at(step, at + length, -1)
                gone = np.cumsum(step) > 0
                out = []
                for k, key in enumerate(ids.tolist()):
                    a, b = int(offsets[k]), int(offsets[k + 1])
                    own = gone[a:b]
                    runs = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
                    out.append((key if key != SMALLEST else None, b - a, int(own.sum()), runs, hashlib.sha256(data[a:b][~own].tobytes()).hexdigest()))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([*(pa.array(columns[k], pa.int64()) for k in range(4)), pa.array(columns[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return known.join(back(merged, "least"), "chunk", "left").mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; edge cases as ``remove_repeats`` says."""
    return remove_repeats(table(spark, sf_dir, "documents"))
