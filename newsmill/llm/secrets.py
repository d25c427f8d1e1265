"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmill.llm._common import hot_join, staged, table, text_column, tune

KINDS = ("assign", "access", "hex", "provider", "entropy")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # greedy runs: the same as runs of any length that have 32
#: Formats that issuers document for their keys.
PROVIDER = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
PROVIDER_HINTS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "sk_live_", "eyJ")
ENTROPY = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{24,}")
WORDS = ("passw", "secret", "token", "apikey", "api_key")
PLACEHOLDERS = ("example", "changeme", "xxxx", "your", "dummy", "sample", "00000000", "12345678")
#: A value that more owners, or more repositories of them, than this hold is a
#: widely copied example.
MAX_OWNERS, MAX_REPOS = 2, 4
#: Least entropy, in bits a character, of a live-looking value.
MIN_BITS = 2.5
_RUNS = np.zeros(256, np.uint8)
_RUNS[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-"]] = 1


def bits(value: str) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) if n else 0.0


def live_looking(value: str) -> bool:
    low = value.lower()
    return bits(value) >= MIN_BITS and not any(p in low for p in PLACEHOLDERS)


def _long_run(text: str, least: int) -> bool:
    """Whether a run of ``least`` characters of [A-Za-z0-9+/_=-] is there."""
    data = np.frombuffer(text.encode(), np.uint8)
    gaps = np.flatnonzero(np.concatenate(([1], 1 - _RUNS[data], [1])))
    return bool((np.diff(gaps) > least).any())


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of all candidates, by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if any(h in text for h in PROVIDER_HINTS):
        out += [("provider", m.start(), m.end(), m[0]) for m in PROVIDER.finditer(text)]
    if len(text) >= 24 and _long_run(text, 24):
        out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
        taken = [(s, e) for _, s, e, _ in out]
        for m in ENTROPY.finditer(text):
            if bits(m[0]) >= 3.5 and all(e <= m.start() or s >= m.end() for s, e in taken):
                out.append(("entropy", m.start(), m.end(), m[0]))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _hash(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()[:32]


CANDIDATE = "array<struct<kind:string,start:bigint,stop:bigint,hash:string,live:boolean>>"


def scan(docs: DataFrame, names: list[str], text: str = "text") -> DataFrame:
    """The columns ``names`` of ``docs`` with ``__rid``, a number for each row,
    and ``__found``, the candidates of its text. Written once to the shared
    folder: the numbers stay whatever is computed anew."""
    tune(docs.sparkSession)
    rows = docs.select(*names, text_column(docs, text).alias("__text"))
    found = T._parse_datatype_string(CANDIDATE)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("__rid", T.LongType()), T.StructField("__found", found)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("hash", pa.string()), ("live", pa.bool_())]))

    def work(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            made = []
            for t in batch.column(len(names)).to_pylist():
                made.append([{"kind": k, "start": s, "stop": e, "hash": _hash(v), "live": live_looking(v)} for k, s, e, v in find(t)])
            rid = pa.array(range(number, number + len(made)), pa.int64())
            number += len(made)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], rid, pa.array(made, kind)], [*names, "__rid", "__found"])

    return staged(rows.mapInArrow(work, schema), "scan")


def ownership(scanned: DataFrame, owner: str = "__owner", repo: str = "__repo") -> DataFrame:
    """Per candidate hash its distinct owners, distinct repositories and rows.

    Rows are combined per (hash, owner, repository) before they are counted, so
    a value that a third of all rows hold costs a row for each task."""
    one = scanned.select(F.explode("__found.hash").alias("hash"), F.col(owner).alias("owner"), F.col(repo).alias("repo"))
    each = one.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    per = each.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return per.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_rows"))


def judged(scanned: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """Per ``__rid`` the spans ``kind, start, stop, live, base`` that count.

    Base kinds always count. The method's own kinds (provider, entropy) count
    only where their value is owner-specific. A span is live when its value
    looks live, has at most ``max_owners`` distinct owners and is in at most
    ``max_repos`` distinct repositories: what few owners carry through many
    repositories is copied as well (a vendored file or a fixture)."""
    stats = ownership(scanned)
    each = scanned.where(F.size("__found") > 0).select("__rid", F.explode("__found").alias("x")).select("__rid", "x.*")
    few = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    joined = hot_join(each, stats, "hash").withColumns({"live": F.col("live") & few, "base": F.col("kind").isin(*BASE)})
    kept = joined.where(F.col("base") | F.col("live"))
    order = F.when(F.col("kind") == KINDS[0], 0)
    for i, k in enumerate(KINDS[1:], 1):
        order = order.when(F.col("kind") == k, i)
    span = F.struct("start", order.alias("rank"), "stop", "kind", "live", "base")
    return kept.groupBy("__rid").agg(F.sort_array(F.collect_list(span)).alias("__spans"))


def _is(kind: str):
    return lambda x: x.kind == kind


def _named(spans):
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.stop.cast("string"))))


def _owned(docs: DataFrame, owner_col: str | None, repo_col: str | None) -> dict:
    """Owner and repository of each row; a column that isn't there: null for all."""
    value = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    return {"__owner": value(owner_col), "__repo": value(repo_col)}


def secret_report(docs: DataFrame, owner_col: str | None = "source", repo_col: str | None = "lang", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """A row per document: counts and digest of its base spans, all its spans,
    how many are live and how many copied examples.

    An owner is a value of ``owner_col``, a repository a pair of owner and
    ``repo_col`` (``documents`` names no repository, so language stands for it);
    null counts as one value, as for all rows where a column isn't there. Null
    texts are empty; an empty table gives no rows; repeated rows keep a row each;
    other columns don't matter."""
    scanned = scan(docs.withColumns(_owned(docs, owner_col, repo_col)).select("doc_id", "text", "__owner", "__repo"), ["doc_id", "__owner", "__repo"])
    rows = scanned.select("__rid", "doc_id").join(judged(scanned, max_owners, max_repos), "__rid", "left")
    spans = F.coalesce("__spans", F.array().cast("array<struct<start:bigint,rank:int,stop:bigint,kind:string,live:boolean,base:boolean>>"))
    rows = rows.select("doc_id", spans.alias("spans"))
    base = F.filter("spans", lambda x: x.base)
    count = lambda test: F.size(F.filter("spans", test)).cast("bigint")
    return rows.select(
        "doc_id",
        *(count(_is(k)).alias(f"n_{k}") for k in BASE),
        F.sha2(_named(base), 256).alias("base_sha256"),
        _named(F.col("spans")).alias("spans"),
        count(lambda x: x.live).alias("n_live"),
        count(lambda x: ~x.live).alias("n_copied"),
        _named(F.filter("spans", lambda x: x.live)).alias("live_spans"),
    )


def redact(docs: DataFrame, mark: str = "<SECRET>", owner_col: str | None = "source", repo_col: str | None = "lang") -> DataFrame:
    """``docs`` with each live span of ``text`` replaced by ``mark``; the columns
    stay (n_chars follows the new text). Copied examples and all other text stay
    as they are. Overlapping spans are replaced as one. Null and empty texts, rows
    that repeat and columns of any other name stay as they are; columns of owner
    and repository that aren't there count as null."""
    columns = docs.columns
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    scanned = scan(docs.withColumns(_owned(docs, owner_col, repo_col)), [*columns, "__owner", "__repo"])
    live = judged(scanned).select("__rid", F.filter("__spans", lambda x: x.live).alias("__spans")).where(F.size("__spans") > 0)
    joined = scanned.where(F.size("__found") > 0).join(live, "__rid", "left")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        piece = F.substring(F.col("text"), (acc.at + 1).cast("int"), F.greatest(x.start - acc.at, F.lit(0)).cast("int"))
        fresh = x.start >= acc.at
        return F.struct(F.greatest(x.stop, acc.at).alias("at"), F.when(fresh, F.concat(acc.out, piece, F.lit(mark))).otherwise(acc.out).alias("out"))

    new = F.aggregate("__spans", start, step, lambda a: F.concat(a.out, F.substring(F.col("text"), (a.at + 1).cast("int"), 2**31 - 1)))
    joined = joined.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(new))
    if "n_chars" in columns:
        joined = joined.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kinds["n_chars"])))
    return scanned.where(F.size("__found") == 0).select(columns).unionAll(joined.select(columns))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; edge cases as ``secret_report`` says."""
    return secret_report(table(spark, sf_dir, "documents"))
