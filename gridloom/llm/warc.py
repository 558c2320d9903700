"""WARC archives of web captures, with a capture index in global order.

Each writing task appends its records to archives of its own, one gzip member a record, and hands on index entries as locally sorted runs. The index is then dealt by ranges of (URL key, timestamp, page), and each range merges its share of all runs with a loser tree, so that the entries, range after range, are the capture histories of all URLs in order. Payload bytes are only moved from the table into the archive; grouping by equal payloads works on digests.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, joined, shared_dir, table, written

#: Payloads of fewer bytes are always stored in full. Bytes after which a task starts another archive; entries of a run.
LEAST, ARCHIVE_BYTES, RUN_ENTRIES = 100, 256 << 20, 100_000
#: When the page with id 0 counts as captured, where no capture times are given; each further id one second later.
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
ENTRY = "url_key string, timestamp string, page_id long, run string, file string, offset long, length long"
RECORD = "file string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
SHAPE = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in ENTRY.split(", "))])
RECORD_SHAPE = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in RECORD.split(", "))])


def url_key(url: str | None) -> str:
    """The URL with its host turned round (com,example)/path?query), without scheme, default port, user and fragment; empty for none."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.lower()
    port = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


class LoserTree:
    """Merges sorted runs: inner nodes hold the loser of the match below them, so that the next least item needs one match a level, along one path."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, k = runs, [0] * len(runs), len(runs)
        self.loser = [-1] * k
        winner = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.loser[node] = (a, b) if self._before(a, b) else (b, a)
        self.best = winner[1] if k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        i, j = self.at[a], self.at[b]
        if i >= len(self.runs[a]):
            return False
        return j >= len(self.runs[b]) or (self.runs[a][i], a) < (self.runs[b][j], b)

    def __iter__(self) -> Iterator:
        while self.runs and self.at[self.best] < len(self.runs[self.best]):
            run = self.best
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            node = (run + len(self.runs)) // 2
            while node:
                if self._before(self.loser[node], self.best):
                    self.loser[node], self.best = self.best, self.loser[node]
                node //= 2


def header(value: str) -> str:
    return quote(value, safe="".join(chr(c) for c in range(33, 127)))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, when: datetime) -> bytes:
    """One WARC record; a revisit has the HTTP header of its capture, with the length of the payload, and no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header(url)}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def captured(page_id: int | None, given: datetime | None) -> datetime:
    if given is not None:
        return given.replace(tzinfo=UTC) if given.tzinfo is None else given
    return EPOCH + timedelta(seconds=(page_id or 0) % (1 << 32))


def _writer(place: str):
    def run(batches):
        fs, folder = pa.fs.FileSystem.from_uri(place)
        task = TaskContext.get()
        name, entries, out, count, runs, offset = f"{task.partitionId()}-{task.taskAttemptId()}", [], None, 0, 0, 0

        def sorted_run() -> pa.RecordBatch:
            entries.sort(key=lambda e: (e[0], e[1], e[2] is not None, e[2] or 0))
            return pa.RecordBatch.from_pylist([dict(zip(SHAPE.names, e, strict=True)) for e in entries], SHAPE)

        for batch in batches:
            for page_id, url, html, digest, kind, refers_to, when in zip(*(c.to_pylist() if n != "html" else c for n, c in zip(batch.schema.names, batch.columns, strict=True)), strict=True):
                html = html.as_py()
                when = captured(page_id, when)
                if out is None:
                    file = f"{name}-{count}.warc.gz"
                    out, offset, count = fs.open_output_stream(f"{folder}/{file}", compression=None), 0, count + 1
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = pack.compress(record(page_id, url, (html or "").encode(), digest, kind, refers_to, when)) + pack.flush()
                out.write(data)
                entries.append((url_key(url), f"{when:%Y%m%d%H%M%S}", page_id, f"{name}-{runs}", file, offset, len(data)))
                offset += len(data)
                if offset >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                if len(entries) >= RUN_ENTRIES:
                    yield sorted_run()
                    entries, runs = [], runs + 1
        if out is not None:
            out.close()
        if entries:
            yield sorted_run()

    return run


def _merge(batches):
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    rows = pa.Table.from_batches(tables)
    keys = list(zip(rows["url_key"].to_pylist(), rows["timestamp"].to_pylist(), ((p is not None, p or 0) for p in rows["page_id"].to_pylist()), range(rows.num_rows), strict=False))
    runs: dict[str, list] = {}
    for run, key in zip(rows["run"].to_pylist(), keys, strict=True):
        runs.setdefault(run, []).append(key)
    for run in runs.values():
        if any(a > b for a, b in zip(run, run[1:], strict=False)):  # a run that came in pieces
            run.sort()
    order = pa.array((k[3] for k in LoserTree(list(runs.values()))), pa.int64())
    yield from rows.take(order).combine_chunks().to_batches(max_chunksize=10_000)


FIELD = re.compile(rb"^([A-Za-z-]+): (.*)\r$", re.M)


def members(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of an open file, one at a time."""
    unpack, parts, start, at = zlib.decompressobj(31), [], 0, 0
    while data := stream.read(1 << 20):
        while data:
            parts.append(unpack.decompress(data))
            used = len(data) - len(unpack.unused_data)
            at, data = at + used, unpack.unused_data
            if unpack.eof:
                yield start, b"".join(parts)
                unpack, parts, start = zlib.decompressobj(31), [], at
    if parts:
        raise ValueError("an archive ends within a record")


def parse(content: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record; a stored payload must have the length and digest that its headers give."""
    head, _, rest = content.partition(b"\r\n\r\n")
    field = {k.lower(): v for k, v in FIELD.findall(head + b"\r")}
    block = rest[: int(field[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length, kind = int({k.lower(): v for k, v in FIELD.findall(http + b"\r")}[b"content-length"]), field[b"warc-type"].decode()
    digest = field[b"warc-payload-digest"].decode().removeprefix("sha256:")
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its headers")
    number = lambda v: int(x) if (x := v.decode().strip("<>").rpartition(":")[2]) else None
    return number(field[b"warc-record-id"]), length, digest, kind, number(field[b"warc-refers-to"]) if b"warc-refers-to" in field else None


def _reader(place: str):
    def run(batches):
        fs, folder = pa.fs.FileSystem.from_uri(place)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                found = []
                with fs.open_input_stream(f"{folder}/{file}", compression=None) as stream:
                    for offset, content in members(stream):
                        found.append((file, offset, *parse(content)))
                        if len(found) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), RECORD_SHAPE, strict=True)], schema=RECORD_SHAPE)
                            found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), RECORD_SHAPE, strict=True)], schema=RECORD_SHAPE)

    return run


def payload(html: str) -> Column:
    return F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")


def write_archives(pages: DataFrame, place: str, captured_at: str | None = None, least: int = LEAST) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC archives into the folder place and returns the merged index, in global order of url_key, timestamp and page_id over its partitions.

    Of pages with equal payloads of least bytes or more, the one with the smallest page_id is stored, the others become revisits of it. Null html is an empty payload, a null url has an empty key and no target, a null page_id is never referred to; rows equal in page_id and payload are all stored. captured_at names a timestamp column. An empty table gives an empty index and no archives. Archives of failed attempts may stay in the folder; the index names none of them.
    """
    spark: SparkSession = pages.sparkSession
    base = shared_dir(spark)
    p = pages.select("page_id", "url", "html", (F.col(captured_at).cast("timestamp") if captured_at else F.lit(None).cast("timestamp")).alias("when")).withColumn("digest", F.sha2(payload("html"), 256)).withColumn("size", F.octet_length(payload("html")))
    groups = p.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1 AND refers_to IS NOT NULL").select("digest", "refers_to")
    groups = written(groups, f"{base}/groups")
    d = joined(p, groups, ["digest"], groups.count(), "left")
    again = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    d = d.select("page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("refers_to")).alias("refers_to"), "when")
    fs, folder = pa.fs.FileSystem.from_uri(place)
    fs.create_dir(folder, recursive=True)
    runs = written(d.mapInArrow(_writer(place), ENTRY), f"{base}/runs")
    delete(spark, f"{base}/groups")
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return runs.repartitionByRange(ranges, "url_key", "timestamp", "page_id").mapInArrow(_merge, ENTRY)


def read_archives(spark: SparkSession, place: str, files: DataFrame) -> DataFrame:
    """The records of archives (file: names in the folder place), in RECORD's columns; payloads are checked against their digests."""
    files = files.select("file").distinct()
    return files.repartition(max(1, files.count())).mapInArrow(_reader(place), RECORD)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived, indexed and read back."""
    place, base = shared_dir(spark), shared_dir(spark)
    index = written(write_archives(table(spark, sf_dir, "pages"), place), f"{base}/index")
    records = read_archives(spark, place, index)
    # both sides grow with the pages, so they meet by a shuffle; an entry whose record is missing is an error
    found = index.select("file", "offset").join(records.withColumn("found", F.lit(True)).hint("merge"), ["file", "offset"], "left")
    kind = F.when(F.col("found"), F.col("record_type")).otherwise(F.raise_error(F.lit("an archive lacks a record of the index")))
    return found.select("page_id", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE octet_length(encode(html)) >= 100 GROUP BY html)
SELECT p.page_id, octet_length(encode(p.html)) AS payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""
