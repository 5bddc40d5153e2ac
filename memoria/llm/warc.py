"""Operator 8: deterministic sharded WARC writer and its reader."""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, scratch_path
from .files import NewFile, read_chunks

#: Payloads from this many bytes on are written once; later equal ones become revisit records.
REVISIT_BYTES = 1000
#: Compressed bytes after which a task begins another file.
FILE_BYTES = 32 << 20
#: The archives hold no clock time, so equal input gives equal bytes.
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "part int, seq int, path string, sha256 string, records long, bytes long"


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One record with its headers; a revisit has no payload."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    headers = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{url}:{digest}')}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        headers += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_warc(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", payload: str = "html", file_bytes: int = FILE_BYTES, level: int = 4, partitions: int | None = None) -> DataFrame:
    """Write a record for each row below ``folder`` and return the manifest, a row for each file.

    The digest of every payload is the key that finds repeats: of the rows with an equal payload of at least
    REVISIT_BYTES, the largest page_id is the response and the others are revisits of it. Rows are then
    range-sorted by page_id, so a task writes consecutive records, rolls to a new file by compressed size and
    commits each file by a rename. Null payloads are empty; rows with equal page_id and payload are all
    written, and every one but a row with the largest page_id is a revisit; rows with a null page_id are
    responses; null urls are empty; extra columns are ignored.
    """
    def write(batches):
        part, seq, file, count = TaskContext.get().partitionId(), 0, None, 0

        def flush():
            nonlocal seq, file, count
            path, digest = file.commit()
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [path], "sha256": [digest], "records": [count], "bytes": [file.size]})
            seq, file, count = seq + 1, None, 0
            return row

        mark = (None, None, None)
        for batch in batches:
            columns = [batch.column(k) for k in range(6)]
            for i in range(batch.num_rows):
                page, digest, is_mark, link, body, refers = (c[i].as_py() for c in columns)
                if is_mark:
                    mark = (page, digest, refers)
                    continue
                refers = mark[2] if mark[:2] == (page, digest) else None
                file = file or NewFile(folder, f"pages-{part:06d}-{seq:06d}.warc.gz")
                file.write(_member(_record(page, link, body.encode(), refers, digest), level))
                count += 1
                if file.size >= file_bytes:
                    yield flush()
        if file:
            yield flush()

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    digests = rows.filter(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
    repeats = digests.filter("n > 1").select("digest", "response")
    n = partitions or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Payloads are shuffled once: what a revisit refers to comes as a row of its own that sorts before its page.
    narrow = rows.filter(F.octet_length("html") >= REVISIT_BYTES).select("page_id", "digest")
    marks = narrow.join(repeats, "digest").filter("page_id != response").distinct()
    none = F.lit(None).cast("string")
    marks = marks.select("page_id", "digest", F.lit(True).alias("mark"), none.alias("url"), none.alias("html"), F.col("response").alias("refers_to"))
    rows = rows.select("page_id", "digest", F.lit(False).alias("mark"), "url", "html", F.lit(None).cast("long").alias("refers_to")).union(marks)
    rows = rows.repartitionByRange(n, "page_id").sortWithinPartitions("page_id", "digest", F.desc("mark"), "url")
    # A row for each file: a few tasks write the manifest down.
    return materialize(rows.mapInArrow(write, MANIFEST).repartition(1 + n // 64), "warc-manifest")


def parse_warc(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each gzip member of a file that comes in chunks; digests are checked. One record is held at a time."""
    chunks = iter(chunks)
    while some := next(chunks, b""):
        while some:
            z, parts = zlib.decompressobj(31), []
            while not z.eof:
                if not some and not (some := next(chunks, b"")):
                    raise ValueError("a file ends within a record")
                parts.append(z.decompress(some))
                some = z.unused_data
            record = b"".join(parts)
            head, _, rest = record.partition(b"\r\n\r\n")
            headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
            block = rest[: int(headers["Content-Length"])]
            if base64.b32encode(hashlib.sha1(block).digest()).decode() != headers["WARC-Block-Digest"].removeprefix("sha1:"):
                raise ValueError("a block differs from its digest")
            yield headers, block.partition(b"\r\n\r\n")[2]


def read_warc(manifest: DataFrame) -> DataFrame:
    """The records of the files in a manifest: page_id, url, payload_bytes, payload_digest, record_type, refers_to. Files are read in chunks, rows leave a few hundred at a time."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def rows(path: str, sha256: str):
        for h, body in parse_warc(read_chunks(path, sha256)):
            digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            if h["WARC-Type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
                raise ValueError("a payload differs from its digest")
            yield int(h["X-Page-Id"]) if h["X-Page-Id"] else None, h["WARC-Target-URI"], int(h["X-Payload-Length"]), digest, h["WARC-Type"], int(h["X-Refers-To-Page-Id"]) if "X-Refers-To-Page-Id" in h else None

    def read(batches):
        for batch in batches:
            for path, sha256 in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = rows(path, sha256)
                while some := list(itertools.islice(found, 500)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some), schema)], schema=schema)

    return manifest.repartition(n, "part", "seq").select("path", "sha256").mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(documents(spark, sf_dir, "pages"), scratch_path(spark, "warc"))).drop("url")


OP8_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT payload_digest, max(page_id) AS response FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN r.response <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN r.response <> p.page_id THEN r.response END AS refers_to
FROM p LEFT JOIN r ON p.payload_digest = r.payload_digest AND p.payload_bytes >= 1000
"""
