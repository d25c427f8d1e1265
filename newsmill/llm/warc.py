"""WARC archives: a writer made of SQL functions and a Python data source reader."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from newsmill.llm._common import FEW_ROWS, HOT, new_path, staged, table

CRLF = "\r\n"
SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, content_type string, full_length bigint, content_length bigint, payload_sha1 string, payload binary, file string, offset bigint"
#: Header that gives a column, lower-cased.
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "content_type": "content-type",
    "full_length": "x-full-payload-length",
}


def sha1_base32(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text, by SQL functions."""
    hexed = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def urn(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``key, url, payload, n_bytes, digest, record_type, refers_to`` per page.

    Of pages with equal payloads of at least ``min_bytes`` bytes, that with the
    least key is the response (all rows that repeat this key are), the others
    are revisits that refer to it. Null keys come last; a payload that has only
    null keys is all response. Null html is empty; an empty table gives no rows;
    other columns don't matter.

    The least key is a grouped minimum over digests. Payloads travel only in the
    join that gives them their record type. A payload that more than 1 / HOT of
    the pages share is looked up by broadcast (fewer than HOT digests) and its
    rows join by their key, so it meets in no task."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("key"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("bigint"), "digest": sha1_base32(F.col("payload"))})
    sums = rows.select("key", "n_bytes", "digest").where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.min("key").alias("least"), F.count("*").alias("n"))
    sums = staged(sums.where("n > 1"), "digests")
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = sums.where(F.col("n") > max(FEW_ROWS, total / HOT)).select("digest", F.col("least").alias("hot_least"))
    rows = rows.join(F.broadcast(hot), "digest", "left")
    # a hot row's payload is known to be at least min_bytes long: equal digests have equal payloads
    dealt = F.when(F.col("hot_least").isNotNull(), F.concat(F.lit("-"), F.coalesce(F.col("key").cast("string"), F.concat(F.lit("u"), F.xxhash64("url").cast("string"))))).otherwise(F.col("digest"))
    joined = rows.withColumn("dealt", dealt).join(sums.select(F.col("digest").alias("dealt"), "least"), "dealt", "left")
    joined = joined.withColumn("least", F.coalesce("least", "hot_least"))
    revisit = F.coalesce((F.col("n_bytes") >= min_bytes) & F.col("least").isNotNull() & ~F.col("key").eqNullSafe(F.col("least")), F.lit(False))
    joined = joined.withColumn("revisit", revisit)
    return joined.select("key", "url", "payload", "n_bytes", "digest", F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), F.when(F.col("revisit"), F.col("least")).alias("refers_to"))


def write(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Write one WARC/1.1 record per row of ``with_revisits``, a file per task.

    Spark's own text writer is used, with the two line ends that close a record
    as line separator: its commit protocol leaves each record once, whatever
    tasks are lost or run twice, on any file system that Spark writes. A revisit
    has no content; headers keep the digest and length of the full payload."""
    one = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("payload"))
    uri = F.regexp_replace("url", r"[\r\n]", " ")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    record = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col("key"))),
        line("WARC-Date", F.lit(date)),
        optional("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("refers_to").isNotNull(), line("WARC-Refers-To", urn(F.col("refers_to")))).otherwise(F.lit("")),
        line("X-Full-Payload-Length", F.col("n_bytes").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(one).cast("string")),
        F.lit(CRLF),
        one,
    )
    records.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


def _open(path: str):
    """A readable file of a local or shared path, or of any store pyarrow knows."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        file = open(unquote(parts.path) if parts.scheme else path, "rb")
    else:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        file = store.open_input_stream(inner, buffer_size=1 << 20, compression=None)
    return gzip.open(file) if path.endswith(".gz") else file


def _listed(path: str) -> list[tuple[str, int]]:
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        top = unquote(parts.path) if parts.scheme else path
        if os.path.isfile(top):
            return [(top, os.path.getsize(top))]
        found = [os.path.join(d, f) for d, _, names in os.walk(top) for f in names if f[0] not in "._"]
        return sorted((f, os.path.getsize(f)) for f in found)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(inner, recursive=True))
    start = path[: len(path) - len(inner.rstrip("/"))] if path.endswith(inner) else f"{parts.scheme}://{parts.netloc}"
    return sorted((start + f.path, f.size) for f in found if f.is_file and f.base_name[0] not in "._")


@dataclass
class WarcFiles(InputPartition):
    files: tuple[str, ...]


class WarcReader(DataSourceReader):
    """Plans partitions of whole files, packed up to ``partition_bytes``.

    Equality, membership and prefix filters on header columns are pushed down:
    a record's headers are parsed first, and where they fail a filter the
    content is passed over unread. Option ``payload``: ``bytes`` gives the
    content, ``digest`` only its SHA-1, ``none`` passes over all contents."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.mode = options.get("payload", "bytes")
        self.size = int(options.get("partition_bytes", 64 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and column != "full_length" and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.tests.append((type(f).__name__, HEADERS[column], f.value))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append(("IsNotNull", HEADERS[column], None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out: list[list[str]] = []
        room = 0
        for path, size in _listed(self.path):
            if not size:
                continue
            if not out or size > room:
                out.append([])
                room = self.size
            out[-1].append(path)
            room -= size
        return [WarcFiles(tuple(x)) for x in out]

    def _wanted(self, head: dict[str, str]) -> bool:
        for kind, name, value in self.tests:
            own = head.get(name)
            if own is None or kind == "EqualTo" and own != value or kind == "In" and own not in value or kind == "StringStartsWith" and not own.startswith(value):
                return False
        return True

    def read(self, partition: WarcFiles):
        for path in partition.files:
            with _open(path) as file:
                yield from self._records(file, path)

    def _records(self, file, path: str):
        at = 0

        def line() -> bytes:
            nonlocal at
            got = file.readline()
            at += len(got)
            return got

        while True:
            start = at
            first = line()
            while first and not first.strip():
                start = at
                first = line()
            if not first:
                return
            if not first.startswith(b"WARC/"):
                raise ValueError(f"{path}: no record at byte {start}")
            head: dict[str, str] = {}
            while (own := line()) and own.strip():
                name, _, value = own.decode("utf-8", "replace").partition(":")
                head[name.strip().lower()] = value.strip()
            length = int(head.get("content-length", 0))
            if not self._wanted(head):
                left = length
                if hasattr(file, "seek") and getattr(file, "seekable", lambda: False)():
                    file.seek(length, 1)
                    left = 0
                while left and (got := file.read(min(left, 1 << 20))):
                    left -= len(got)
                at += length
                continue
            content = sha1 = None
            if self.mode == "none":
                left = length
                while left and (got := file.read(min(left, 1 << 20))):
                    left -= len(got)
            else:
                parts, made, left = [], hashlib.sha1(), length
                while left and (got := file.read(min(left, 1 << 20))):
                    left -= len(got)
                    made.update(got)
                    if self.mode == "bytes":
                        parts.append(got)
                if left:
                    raise ValueError(f"{path}: the record at byte {start} is cut off")
                sha1 = base64.b32encode(made.digest()).decode()
                content = b"".join(parts) if self.mode == "bytes" else None
            at += length
            full = head.get("x-full-payload-length")
            yield (*(head.get(HEADERS[c]) for c in HEADERS if c != "full_length"), int(full) if full else None, length, sha1, content, path, start)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "newsmill_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read(spark: SparkSession, path: str, payload: str = "bytes") -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("newsmill_warc").option("path", path).option("payload", payload).load()


def page_records(records: DataFrame) -> DataFrame:
    """Per record what the archives say of a page; a response's digest and length
    are those of the content read, a revisit's those its headers keep."""
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("bigint")
    revisit = F.col("record_type") == "revisit"
    return records.select(
        number("record_id").alias("page_id"),
        F.when(revisit, F.col("full_length")).otherwise(F.col("content_length")).alias("payload_bytes"),
        F.when(revisit, F.substring("payload_digest", 6, 32)).otherwise(F.col("payload_sha1")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page, as read back from the archives."""
    path = new_path(spark, "warc")
    write(with_revisits(table(spark, sf_dir, "pages")), path)
    found = read(spark, path, payload="digest").where(F.col("record_type").isin("response", "revisit"))
    return page_records(found)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS least FROM p),
q AS (SELECT *, [('0x' || substr(hex, 1 + 5 * k, 5))::BIGINT FOR k IN range(8)] AS fives FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((fives[1 + k // 4] >> (15 - 5 * (k % 4))::INT) & 31)::INT, 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to
FROM q
"""
