"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A
word's probability is the sum, over all ways to write it as pieces, of the
product of theirs (a forward pass over its bytes); a text's log-probability is
the sum over its words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmill.llm._common import chunks, groups, staged, table, text_column, tune
from newsmill.llm._words import MULTIPLIER, Finder, hashes, mix, spans

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Most languages that a model holds (its size is this times the vocabulary).
MAX_LANGUAGES = 400
SMOOTHING = 0.1
#: Words whose scores a worker keeps.
KEPT_WORDS = 200_000
#: New words that are summed over at once.
AT_ONCE = 1 << 15
BLOCK = 1000
MARK = "▁".encode()
_vocabularies: dict[str, "Vocabulary"] = {}


class Vocabulary:
    """The pieces as byte strings, and what finds the piece of a hash."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        kept: dict[bytes, int] = {}
        for i in range(self.size):
            if self.model.is_control(i) or self.model.is_unknown(i):
                continue
            piece = self.model.id_to_piece(i)
            raw = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.encode()
            if not self.model.is_byte(i) or raw not in kept:
                kept[raw] = i
        self.longest = max(map(len, kept))
        self.lengths = sorted({len(k) for k in kept})
        self.ids = np.array(list(kept.values()), np.int64)
        self.keys = np.array([self._hash(k) for k in kept], np.uint64)
        self.finder = Finder(self.keys)

    @staticmethod
    def _hash(raw: bytes) -> int:
        h = 0
        for b in raw:
            h = (h * MULTIPLIER + b + 1) % 2**64
        return int(mix(np.array([h ^ len(raw)], np.uint64))[0])

    def forward(self, words: list[bytes], p: np.ndarray) -> np.ndarray:
        """Log-probability of each word (after a word mark) under each language;
        p: pieces by languages, in the order of ids."""
        n, languages = len(words), p.shape[1]
        out = np.empty((n, languages))
        order = np.argsort([-len(w) for w in words], kind="stable")
        ordered = [MARK + words[i] for i in order]
        size = np.array([len(w) for w in ordered], np.int64)
        first = np.zeros(n + 1, np.int64)
        np.cumsum(size, out=first[1:])
        data = np.frombuffer(b"".join(ordered), np.uint8).astype(np.uint64) + np.uint64(1)
        end = np.repeat(first[1:], size)
        room = end - np.arange(len(data))
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        h = np.zeros(len(data), np.uint64)
        for length in range(1, self.longest + 1):
            live = len(data) - length + 1
            if live <= 0:
                break
            h = h[:live] * np.uint64(MULTIPLIER) + data[length - 1 :]
            if length in self.lengths:
                start = np.flatnonzero(room[:live] >= length)
                if not len(start):
                    break
                piece = self.finder.find(mix(h[start] ^ np.uint64(length)))
                hit = piece >= 0
                start, piece = start[hit], piece[hit]
                word = np.searchsorted(first, start, "right") - 1
                by = np.argsort(start - first[word] + length, kind="stable")
                found[length] = ((start - first[word] + length)[by], word[by], piece[by])
        ring = self.longest + 1
        alpha = np.zeros((ring, n, languages))
        alpha[0] = 1.0
        scale = np.zeros(n)
        cuts = {k: np.searchsorted(v[0], np.arange(size.max(initial=0) + 2)) for k, v in found.items()}
        for j in range(1, int(size.max(initial=0)) + 1):
            active = int(np.searchsorted(-size, -j, "right"))
            now = alpha[j % ring]
            now[:active] = 0.0
            for length, (_, word, piece) in found.items():
                if length > j:
                    continue
                a, b = cuts[length][j], cuts[length][j + 1]
                if a < b:
                    w = word[a:b]  # a word has one start for an end and a length
                    now[w] += alpha[(j - length) % ring][w] * p[piece[a:b]]
            if j % 8 == 0:
                most = alpha[:, :active].max(axis=(0, 2))
                most[most <= 0] = 1.0
                alpha[:, :active] /= most[:, None]
                scale[:active] += np.log(most)
            done = slice(int(np.searchsorted(-size, -j, "left")), active)
            if done.start < done.stop:
                with np.errstate(divide="ignore"):
                    out[order[done]] = np.maximum(np.log(now[done]), -690.0) + scale[done, None]
        return out


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def distinct_words(data: np.ndarray, offsets: np.ndarray):
    """Hashes of the distinct words, a span of each, and per occurrence its text
    and number of word."""
    starts, ends, own = spans(data, offsets)
    key, first, back = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
    return key, starts[first], ends[first], own, back


def learn(docs: DataFrame, lang_col: str = "lang", path: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities, from all rows of ``docs`` that
    have a language. Tasks add up piece counts; these are summed by language and
    block of pieces in executors, and only the sums reach the driver."""
    tune(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.lower(text_column(docs)).alias("text"))

    def count(batches):
        known = vocabulary(path)
        sums: dict[str, np.ndarray] = {}
        for part, data, offsets in chunks(batches, "text", 4 << 20):
            names = part.column(0).to_pylist()
            index = {k: i for i, k in enumerate(dict.fromkeys(names))}
            _, starts, ends, own, back = distinct_words(data, offsets)
            if not len(starts):
                continue
            raw = data.tobytes()
            pieces = known.model.encode([raw[a:b].decode() for a, b in zip(starts, ends)], num_threads=1)
            sizes = np.array([len(x) for x in pieces])
            flat = np.fromiter((y for x in pieces for y in x), np.int64, int(sizes.sum()))
            language = np.array([index[k] for k in names])[own]
            for name, i in index.items():
                many = np.bincount(back[language == i], minlength=len(starts))
                own_sum = np.bincount(flat, weights=np.repeat(many, sizes), minlength=known.size)
                sums[name] = sums.get(name, 0) + own_sum
        for name, total in sums.items():
            blocks = [total[a : a + BLOCK].astype(np.int64) for a in range(0, len(total), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(blocks)), pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["lang", "block", "counts"])

    def add(batches):
        for (name, block), rows in groups(batches, ["lang", "block"]):
            total = sum(np.frombuffer(x, np.int64) for x in rows.column("counts").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["lang", "block", "counts"])

    schema = "lang string, block int, counts binary"
    parts = rows.mapInArrow(count, schema)
    sums = parts.repartition("lang", "block").sortWithinPartitions("lang", "block").mapInArrow(add, schema)
    sums = staged(sums, "pieces")
    names = sorted(r.lang for r in sums.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    known = vocabulary(path)
    counts = np.zeros((known.size, len(names)))
    for r in sums.collect():
        own = np.frombuffer(r.counts, np.int64)
        counts[r.block * BLOCK : r.block * BLOCK + len(own), names.index(r.lang)] = own
    counts = counts[known.ids] + SMOOTHING
    return names, counts / counts.sum(axis=0) if names else counts


def classify(docs: DataFrame, names: list[str], p: np.ndarray, path: str = VOCABULARY, keep: list[str] | None = None, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``out``, the language and the
    share of that language if all are equally likely before. A text that is
    null or has no letter is ``und`` with score 0, as is every text if no
    language was learnt. Equal scores: the first language by name."""
    tune(docs.sparkSession)
    keep = keep or ["doc_id"]
    rows = docs.select(*keep, F.lower(text_column(docs)).alias("__text"), F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    model = docs.sparkSession.sparkContext.broadcast(p)
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields[:-2], T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])
    width = len(keep)

    def work(batches):
        own_p = model.value
        known = vocabulary(path)
        seen_key, seen = np.zeros(0, np.uint64), np.zeros((0, len(names)))
        for part, data, offsets in chunks(batches, "__text"):
            n = part.num_rows
            letter = np.array(part.column(width + 1).to_pylist(), bool)
            best, share = np.zeros(n, np.int64), np.zeros(n)
            if names:
                key, starts, ends, own, back = distinct_words(data, offsets)
                at = np.searchsorted(seen_key, key)
                at[at == len(seen_key)] = 0
                old = seen_key[at] == key if len(seen_key) else np.zeros(len(key), bool)
                score = np.empty((len(key), len(names)))
                score[old] = seen[at[old]]
                new = np.flatnonzero(~old)
                if len(new):
                    raw = data.tobytes()
                    for a in range(0, len(new), AT_ONCE):
                        some = new[a : a + AT_ONCE]
                        score[some] = known.forward([raw[starts[i] : ends[i]] for i in some], own_p)
                    if len(seen_key) + len(new) > KEPT_WORDS:
                        seen_key, seen = key, score
                    else:
                        joined = np.concatenate([seen_key, key[new]])
                        by = np.argsort(joined)
                        seen_key, seen = joined[by], np.concatenate([seen, score[new]])[by]
                total = np.stack([np.bincount(own, weights=score[back, k], minlength=n) for k in range(len(names))], axis=1)
                total -= total.max(axis=1, keepdims=True)
                chance = np.exp(total)
                chance /= chance.sum(axis=1, keepdims=True)
                best, share = chance.argmax(axis=1), chance.max(axis=1)
            fits = letter & bool(names)
            found = pa.array([names[b] if f else "und" for b, f in zip(best, fits)], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[:width], found, pa.array(np.where(fits, share, 0.0))], [*keep, *out])

    return rows.mapInArrow(work, schema)


def remainder(mod: int):
    """crc32 of doc_id as text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def identify(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document. Rows are learnt
    from where the remainder of their id is known and not 2; null ids are
    neither held out nor learnt from. Repeated rows keep a row each. An empty
    table gives no rows; other columns don't matter."""
    names, p = learn(docs.where(remainder(4) != 2), path=path)
    held = docs.withColumn("held_out", F.coalesce(remainder(4) == 2, F.lit(False)))
    return classify(held, names, p, path, ["doc_id", "held_out"])


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; edge cases as ``identify`` says."""
    return identify(table(spark, sf_dir, "documents"))
