"""WARC archives, index first.

Digests decide what each page becomes: of equal payloads of at least LEAST_BYTES the one with the smallest page_id
is a response, others are revisits of it. Pages are then written as gzip-per-record WARC files in a shared folder,
and the same pass returns an index row per record: file, offset, length, URL and digest. Reading goes by the index alone:
the selected records' byte ranges are sorted, near ones are coalesced into one read, and records are parsed from that.

Archives are written under a name of each attempt's own and the index is stored as a table, so that a task that runs
twice leaves a spare file but no wrong index. A hot payload (one digest of a third of all rows) is one row after
aggregation; rows find it by a join that spreads heavy digests.

Defined cases: null html is an empty payload; payloads under LEAST_BYTES are all responses; a null page_id counts as
larger than any; rows repeated with the page_id that is the smallest of their digest are all responses; a null url
leaves the target out; control characters in a url are percent-encoded; an empty table writes no file and gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.llm.common import load, lookup, materialize, parallelism, shared_dir, tidy

LEAST_BYTES = 100
#: A task starts another file beyond FILE_BYTES; a read takes records with gaps of up to GAP_BYTES together, up to READ_BYTES.
FILE_BYTES, READ_BYTES, GAP_BYTES, LEVEL = 256 << 20, 8 << 20, 64 << 10, 3
#: Archive bytes that a task of a read takes, about; a small archive is dealt out to all cores in stretches of STRETCH_BYTES at least.
TASK_BYTES, STRETCH_BYTES = 128 << 20, 256 << 10
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id bigint, file string, offset bigint, length bigint, url string, digest string, record_type string"


def located(name: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a file's URI, by the names that Hadoop has for schemes too."""
    scheme, _, rest = name.partition("://")
    return pa.fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3', 'wasbs': 'abfss', 'wasb': 'abfs'}.get(scheme, scheme)}://{rest}")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; its headers give the payload's digest, size and first place."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if revisit else http + payload
    ident = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}:{revisit}")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{ident}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {target}"] if target else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    head += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        head += [f"X-Refers-To-Page-ID: {refers_to}"] if refers_to is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    body = rest[: int(headers["content-length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def planned(spark: SparkSession, pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, digest, and first: the smallest page_id of the payload, null if it occurs once or is short."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    hashed = F.sha2(payload, 256)
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), hashed.alias("digest"), F.length(payload).alias("size"))
    groups = known.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = materialize(spark, groups, "warc-digests")
    total, many = groups.agg(F.sum("n"), F.count("*")).first()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", hashed.alias("digest"))
    if not many:
        return rows.withColumn("first", F.lit(None).cast("long"))
    return lookup(rows, groups, "digest", "n", total)


def write(spark: SparkSession, plan: DataFrame, folder: str) -> DataFrame:
    """Writes the planned pages' records to files in folder, and returns the index."""

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        for batch in batches:
            rows: list[tuple] = []
            for page, url, html, digest, first in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "digest", "first")), strict=True):
                if out is None or at > FILE_BYTES:
                    if out:
                        out.close()
                    name, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    files, path = located(name)
                    files.create_dir(path.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(path, compression=None)
                payload = (html or "").encode()
                revisit = first is not None and first != page
                squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = squeeze.compress(record(page, url, payload, digest, len(payload), first, revisit)) + squeeze.flush()
                out.write(data)
                rows.append((page, name, at, len(data), url, digest, "revisit" if revisit else "response"))
                at += len(data)
            if rows:
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                names = ["page_id", "file", "offset", "length", "url", "digest", "record_type"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        if out:
            out.close()

    return materialize(spark, plan.select("page_id", "url", "html", "digest", "first").mapInArrow(tidy(archive), INDEX), "warc-index")


def ranges(rows: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Coalesced reads (start, end, records) of sorted (offset, length) records of one file."""
    held: list[tuple[int, int]] = []
    for offset, length in rows:
        if held and (offset - sum(held[-1]) > GAP_BYTES or offset + length - held[0][0] > READ_BYTES):
            yield held[0][0], sum(held[-1]), held
            held = []
        held.append((offset, length))
    if held:
        yield held[0][0], sum(held[-1]), held


def read(spark: SparkSession, index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the index rows chosen: page_id, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked.

    payload_bytes and payload_digest are of the full payload: measured for a response, which must agree with its headers,
    and as its headers say for a revisit.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads

    def fetched(file: str, spans: list[tuple[int, int]]) -> Iterator[tuple]:
        files, path = located(file)
        with files.open_input_file(path) as f:
            for start, end, held in ranges(spans):
                data = f.read_at(end - start, start)
                for offset, length in held:
                    headers, payload = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    whole, size = headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["x-payload-length"])
                    page, kind = headers.get("x-page-id"), headers["warc-type"]
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != whole):
                        raise ValueError(f"record at {offset} of {file} doesn't match its digest")
                    first = headers.get("x-refers-to-page-id")
                    yield (page and int(page), size, whole, kind, first and int(first)) + (payload,) * payloads

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("file", "offset", "length")]
            at = 0
            while at < batch.num_rows:
                end = at
                while end < batch.num_rows and columns[0][end] == columns[0][at] and end - at < 2000:
                    end += 1
                rows = list(fetched(columns[0][at], list(zip(columns[1][at:end], columns[2][at:end], strict=True))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                at = end

    # byte ranges of one file in one place, in order; a file's stretches are dealt out to tasks by their bytes, not by index rows
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(parallelism(spark), -(-total // TASK_BYTES))
    stretch = min(READ_BYTES, max(STRETCH_BYTES, total // (4 * tasks)))
    near = index.select("file", "offset", "length", F.expr(f"offset div {stretch}").alias("stretch"))
    near = near.repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return near.mapInArrow(tidy(get), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    index = write(spark, planned(spark, pages), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read(spark, index)


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND f <> page_id THEN f END AS refers_to
FROM g
"""
