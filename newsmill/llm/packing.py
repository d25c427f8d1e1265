"""Length buckets of least padding, and token-budget batches inside them."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsmill.llm._common import chunks, staged, table, text_column, tune
from newsmill.llm._words import WHITE, hashes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Longest sequence; longer documents become several. It bounds the histogram.
CONTEXT = 2048
BUCKETS = 8
#: Padded tokens that a batch holds at most.
BUDGET = 16384
#: Sequences that one window partition numbers, about.
SHARD_ROWS = 20_000
_known: dict[str, tuple] = {}
_SEEN = 400_000


def _encoder(path: str):
    if path not in _known:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        _known[path] = (tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), {})
    return _known[path]


def token_ids(data: np.ndarray, offsets: np.ndarray, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, one after the other, and their n+1 offsets. The
    tokenizer never joins the end of a word to white space after it, so texts are
    cut before each run of ASCII white space, and a piece that occurs often is
    tokenized once. Texts with other white space, where such runs can be longer,
    are tokenized whole."""
    encoder, seen = _encoder(path)
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    raw = data.tobytes()
    white = WHITE[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = white[1:] & ~white[:-1]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    odd = np.add.reduceat(np.append((data >= 0xC2) | ((data >= 0x1C) & (data <= 0x1F)), False), np.minimum(offsets[:-1], len(data))) * (np.diff(offsets) > 0)
    for i in np.flatnonzero(odd).tolist():
        text = raw[offsets[i] : offsets[i + 1]].decode()
        if any(c.isspace() and (ord(c) > 127 or "\x1c" <= c <= "\x1f") for c in set(text)):
            cut[offsets[i] + 1 : offsets[i + 1]] = False
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    own = np.searchsorted(offsets[1:], starts, "right")
    key, first, back = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
    if len(seen) > _SEEN:
        seen.clear()
    made = []
    for k, f in zip(key.tolist(), first.tolist()):
        got = seen.get(k)
        if got is None:
            got = seen[k] = np.array(encoder.encode_ordinary(raw[starts[f] : ends[f]].decode()), np.int32)
        made.append(got)
    size = np.array([len(x) for x in made], np.int64)
    at = (np.cumsum(size) - size)[back]
    many = size[back]
    total = np.bincount(own, weights=many, minlength=n).astype(np.int64)
    place = np.arange(many.sum()) + np.repeat(at - (np.cumsum(many) - many), many)
    return np.concatenate(made)[place], np.concatenate([[0], np.cumsum(total)])


def end_id(path: str = VOCABULARY) -> int:
    """The id that ends a document: the first after the vocabulary's."""
    return _encoder(path)[0].n_vocab


def sequences(docs: DataFrame, context: int = CONTEXT, vocabulary: str = VOCABULARY) -> DataFrame:
    """``rid, doc_id, seq, start, n_tokens, token_ids``: each document's tokens and
    one end token, cut into pieces of ``context`` tokens; rid numbers the rows.
    Null texts are empty and are a sequence of the end token alone. No token is
    dropped. Written once to the shared folder, so the numbers stay."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column(docs).alias("text"))

    def work(batches):
        rid = TaskContext.get().partitionId() << 40
        for part, data, offsets in chunks(batches, "text"):
            ids, at = token_ids(data, offsets, vocabulary)
            n = part.num_rows
            ids = np.insert(ids, at[1:], end_id(vocabulary)).astype(np.int32)
            at = at + np.arange(n + 1)
            pieces = -(-np.diff(at) // context)
            row = np.repeat(np.arange(n), pieces)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = at[row] + seq * context
            cuts = np.append(first, len(ids))
            tokens = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + len(row))), part.column(0).take(pa.array(row)), pa.array(seq), pa.array(seq * context), pa.array(np.diff(cuts)), tokens], ["rid", "doc_id", "seq", "start", "n_tokens", "token_ids"])
            rid += len(row)

    return staged(rows.mapInArrow(work, "rid bigint, doc_id bigint, seq bigint, start bigint, n_tokens bigint, token_ids array<int>"), "sequences")


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that cover all lengths with
    the least padding: a dynamic program over the histogram. Of equal costs
    fewer buckets, then smaller bounds, win."""
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0), np.int64)
    n = len(lengths)
    if not n:
        return []
    count = np.array([histogram[int(k)] for k in lengths], np.float64)
    many = np.concatenate(([0.0], np.cumsum(count)))
    mass = np.concatenate(([0.0], np.cumsum(count * lengths)))
    cost = np.full(n + 1, np.inf)
    cost[0] = 0.0
    back: list[np.ndarray] = []
    best, at = np.inf, 0
    for k in range(min(buckets, n)):
        new, pick = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(k + 1, n + 1):
            i = np.arange(k, j)
            value = cost[i] + lengths[j - 1] * (many[j] - many[i]) - (mass[j] - mass[i])
            p = int(np.argmin(value))
            new[j], pick[j] = value[p], i[p]
        cost = new
        back.append(pick)
        if cost[n] < best:
            best, at = cost[n], k
    out, j = [], n
    for k in range(at, -1, -1):
        out.append(int(lengths[j - 1]))
        j = int(back[k][j])
    return out[::-1]


def pack(docs: DataFrame, context: int = CONTEXT, buckets: int = BUCKETS, budget: int = BUDGET, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row per sequence with its ``bucket``, ``padded`` length, ``batch`` and
    ``token_ids``: what a batch holds, up to padding.

    The histogram has at most ``context`` rows, whatever the corpus. A batch of
    bucket b holds floor(budget / padded) sequences (one at least); only the last
    batch of a bucket can hold fewer. Sequences are numbered inside shards of a
    bucket and shards are added up, so a bucket with most rows meets in no task;
    token ids travel once, by the number of their row. An empty table gives no
    rows; repeated rows are sequences of their own; other columns don't matter.
    One very long text is held by a task, as ids, and cut into sequences."""
    made = sequences(docs, context, vocabulary)
    narrow = made.drop("token_ids")
    histogram = {r.n_tokens: r.n for r in narrow.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    bounds = boundaries(histogram, buckets)
    if not bounds:
        bounds = [context]
    shards = max(1, -(-sum(histogram.values()) // SHARD_ROWS))
    number, padded = F.lit(len(bounds) - 1), F.lit(bounds[-1])
    for i in range(len(bounds) - 2, -1, -1):
        number = F.when(F.col("n_tokens") <= bounds[i], i).otherwise(number)
        padded = F.when(F.col("n_tokens") <= bounds[i], bounds[i]).otherwise(padded)
    rows = narrow.withColumns({"bucket": number, "padded": padded.cast("bigint"), "shard": F.pmod(F.xxhash64("rid"), F.lit(shards))})
    size = rows.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("bucket").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    offset = size.select("bucket", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("bucket", "shard").orderBy("doc_id", "seq", "n_tokens", "rid"))
    placed = rows.withColumn("own", own).join(offset, ["bucket", "shard"])
    capacity = F.greatest(F.lit(1).cast("bigint"), F.expr(f"{budget} div padded"))
    placed = placed.withColumn("capacity", capacity).select("rid", "doc_id", "seq", "start", "n_tokens", "bucket", "padded", F.expr("(before + own - 1) div capacity").alias("batch"))
    return placed.join(made.select("rid", "token_ids"), "rid").drop("rid")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per sequence, with a digest in place of its token ids."""
    made = pack(table(spark, sf_dir, "documents"))
    return made.withColumn("token_digest", F.xxhash64("token_ids")).drop("token_ids")
