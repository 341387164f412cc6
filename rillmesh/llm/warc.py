"""WARC archives with the index written first-class.

Writing: every task streams its rows into gzip members, one WARC record each, in a file of
its own attempt in the shared folder, and returns an index row per record: file, offset,
length, URL, digest, type.  Spark commits the index, so only records of tasks that
succeeded are ever listed; what a failed attempt left behind is never read.

Equal payloads are stored once.  The digest groups are aggregated first (a group's rows are
combined before the shuffle), and only groups of two or more survive as a table of keepers;
that table is broadcast if its row count is below ``broadcast_rows`` and joined by
shuffle beyond.  Rows other than the keeper become revisit records, which carry the
HTTP head, the payload's digest and a reference, but no payload.

Reading: the index rows of the selected records are dealt by file and stretch of the
file to as many tasks as their archive bytes ask for (not as the small index would), sorted by
offset, and neighbours whose gap is small are read by one byte-range request of bounded size;
records are then cut out, inflated, parsed and checked against their digest.

Defined results: null html is an empty payload; null URLs get a ``urn:page:`` URI and
control characters in URLs are percent-encoded; of rows with equal payloads all those
with the largest page_id are responses (so repeated rows stay alike) and rows with a null id
revisit it; a group with null ids only is all responses; payloads shorter than
``least_bytes`` are always responses; a very long payload is one record, held whole by one task at a time; an empty table
gives an empty index and no record; only ``page_id``, ``url`` and ``html`` are read, other columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_BYTES = 0
ROLL_BYTES = 512 << 20
#: Largest byte-range request, and the largest gap that one request may bridge.
RANGE_BYTES, GAP_BYTES = 8 << 20, 64 << 10
#: Archive bytes that a reading task should get, and what is dealt out as one.
TASK_BYTES, STRETCH_BYTES = 64 << 20, 8 << 20
BROADCAST_ROWS = 100_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, record_type string, record_id string, page_id long, payload_bytes long"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}:{digest}'.encode()).digest()[:16], version=5)}>"


def target_uri(page_id: int | None, url: str | None) -> str:
    if not url:
        return f"urn:page:{page_id if page_id is not None else ''}"
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, keeper: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record: an HTTP response, or a revisit with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target_uri(page_id, url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(keeper, digest)}", f"X-Refers-To-Page-ID: {keeper}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def member(data: bytes) -> bytes:
    """A gzip member of its own, without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _qualified(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    return fs.makeQualified(path).toString()


def keepers(rows: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Digest groups of two or more rows with the id that stays a response."""
    groups = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("sha", "payload_bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    return groups.where("n > 1 and keeper is not null").select(F.col("sha").alias("k_sha"), F.col("payload_bytes").alias("k_bytes"), "keeper")


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, roll_bytes: int = ROLL_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) below ``folder`` and returns the committed index."""
    spark = pages.sparkSession
    common.short_batches(spark)
    data = _qualified(spark, f"{folder}/archive")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    kept = common.written(keepers(rows.drop("payload", "url"), least_bytes), "keepers")
    if kept.count() <= broadcast_rows:
        kept = F.broadcast(kept)
    joined = rows.join(kept, (F.col("sha") == F.col("k_sha")) & (F.col("payload_bytes") == F.col("k_bytes")), "left").select("page_id", "url", "payload", "keeper")
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        store, base = pafs.FileSystem.from_uri(data)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        out, name, at, rolls = None, "", 0, 0
        try:
            for batch in batches:
                listed = []
                for page_id, url, body, keeper in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "keeper")), strict=True):
                    if out is None:
                        name = f"part-{part:05d}-{rolls:04d}-{attempt}.warc.gz"
                        out, at, rolls = store.open_output_stream(f"{base}/{name}", compression=None), 0, rolls + 1
                    digest = payload_digest(body)
                    revisit = keeper is not None and keeper != page_id
                    packed = member(record(page_id, url, body, digest, keeper, revisit))
                    out.write(packed)
                    listed.append((name, at, len(packed), target_uri(page_id, url), digest, "revisit" if revisit else "response", record_id(page_id, digest), page_id, len(body)))
                    at += len(packed)
                    if at >= roll_bytes:
                        out.close()
                        out = None
                if listed:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*listed, strict=True), schema, strict=True)], schema=schema)
        finally:
            if out is not None:
                out.close()

    joined.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read(index: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """The records that ``index`` lists: ``page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, payload`` (a revisit's payload is null)."""
    spark = index.sparkSession
    common.short_batches(spark)
    data = _qualified(spark, f"{folder}/archive")
    wanted = index.select("file", "offset", "length")
    size = wanted.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    wanted = wanted.repartition(tasks, "file", F.floor(F.col("offset") / STRETCH_BYTES)).sortWithinPartitions("file", "offset")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
        name, lo, hi, inside = None, 0, 0, []
        for batch in batches:
            for f, o, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if inside and (f != name or o - hi > gap_bytes or max(hi, o + n) - lo > range_bytes):
                    yield name, lo, hi, inside
                    inside = []
                if not inside:
                    name, lo, hi = f, o, o
                inside.append((o, n))
                hi = max(hi, o + n)
        if inside:
            yield name, lo, hi, inside

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        store, base = pafs.FileSystem.from_uri(data)
        name, source = None, None
        for f, lo, hi, inside in ranges(batches):
            if f != name:
                if source is not None:
                    source.close()
                name, source = f, store.open_input_file(f"{base}/{f}")
            chunk = source.read_at(hi - lo, lo)
            for k in range(0, len(inside), common.BATCH_ROWS):
                found = []
                for o, n in inside[k : k + common.BATCH_ROWS]:
                    head, http, payload = parse(zlib.decompress(chunk[o - lo : o - lo + n], 31))
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = head["WARC-Type"] == "revisit"
                    size = int(http["Content-Length"])
                    if not revisit and (len(payload) != size or payload_digest(payload) != digest):
                        raise ValueError(f"record at {f}:{o} doesn't match its digest")
                    page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                    found.append((int(page) if page else None, head["WARC-Target-URI"], size, digest, head["WARC-Type"], int(refers) if refers else None, None if revisit else payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return wanted.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and every record read back through the index."""
    folder = common.fresh_dir(spark, "warc")
    index = write(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
k AS (SELECT sha, max(page_id) AS keeper, count(*) AS n FROM p GROUP BY sha),
g AS (SELECT p.*, keeper, keeper IS NOT NULL AND keeper IS DISTINCT FROM page_id AS again FROM p JOIN k USING (sha))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(sha, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT) >> s) & 31) + 1 AS BIGINT), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN keeper END AS refers_to
FROM g
"""
