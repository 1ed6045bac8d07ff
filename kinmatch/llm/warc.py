"""WARC records as a table of chunks.

`write_archive` turns each page into one WARC/1.1 record and cuts its bytes into
rows (record, chunk, last, data) of at most `chunk_bytes`; the `data` of a record's
chunks, in order, are the bytes of that record in a WARC file. `read_archive` takes
the rows back to one row per record. Records of one chunk are read where they
lie. Chunks of longer records are sorted by record and number and streamed: the digest is
carried from chunk to chunk, and no task ever holds a whole record.

Of records with equal payloads of at least 100 bytes the one with the smallest
page id is a response and the others are revisits, which have the response's
HTTP headers but no payload. Reading fails if a payload doesn't have the digest
that its header states.

Defined cases: a null payload is empty; shorter payloads are always responses; a null url gives a record
without target URI; line breaks and blanks in a url are percent-encoded; rows equal in id, url
and payload are written alike; a null page id sorts after all others; an empty table gives an
empty archive; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, shared_folder, whole_text

#: Payloads of fewer bytes are written each time.
LEAST_REVISIT = 100
CHUNK_BYTES = 64 * 1024
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNKS = "record long, chunk int, last boolean, data binary"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, chunks int"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Rows (page_id, url, payload, digest, size, refers_to); refers_to is null for responses."""
    payload = F.encode(whole_text(payload_col), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    rows = rows.withColumn("_row", F.xxhash64("url"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "_row")
    groups = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("copies"))
    groups = groups.where("copies > 1").select("digest", F.col("first.page_id").alias("first_id"), F.col("first._row").alias("first_row"), "copies")
    found = lookup(rows, groups, "digest", "copies")
    first = F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("_row") == F.col("first_row"))
    return found.select("page_id", "url", "payload", "digest", "size", (F.col("copies").isNotNull() & ~first).alias("revisit"), F.when(~first, F.col("first_id")).alias("refers_to"))


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record_head(page_id: int | None, url: str | None, digest: str, size: int, revisit: bool, refers_to: int | None) -> bytes:
    """All of a record before its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=-._~"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else size)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _chunks(head: bytes, payload: memoryview, size: int) -> Iterator[bytes]:
    """The record's bytes in pieces of `size`; the payload is never copied as a whole."""
    first = max(0, size - len(head))
    parts = [head[i : i + size] for i in range(0, len(head), size)]
    parts[-1] += bytes(payload[:first])
    tail = b"\r\n\r\n"
    for i in range(first, len(payload), size):
        yield parts.pop(0) if parts else b""
        parts.append(bytes(payload[i : i + size]))
    yield from parts[:-1]
    yield parts[-1] + tail


def _to_chunks(chunk_bytes: int):
    schema = pa.schema([("record", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()), ("data", pa.binary())])

    def write(batches):
        for batch in batches:
            rows, held = [], 0
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                page_id, url, digest, size, revisit, refers_to, record = (at[c][i].as_py() for c in ("page_id", "url", "digest", "size", "revisit", "refers_to", "record"))
                payload = memoryview(b"" if revisit else at["payload"][i].as_buffer() or b"")
                before = None
                for n, data in enumerate(_chunks(record_head(page_id, url, digest, size, revisit, refers_to), payload, chunk_bytes)):
                    if before is not None:
                        rows.append((record, n - 1, False, before))
                    before, last = data, n
                    held += len(data)
                    if held > 4_000_000:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                rows.append((record, last, True, before))
            if rows:
                yield _batch(rows, schema)

    return write


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def write_archive(planned: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write the records of `plan_records` as a chunk table in Parquet."""
    numbered = planned.withColumn("record", F.monotonically_increasing_id())
    numbered.mapInArrow(_to_chunks(chunk_bytes), CHUNKS).write.parquet(path)


class _Reader:
    """One record, fed chunk by chunk; keeps the header and the running digest only."""

    def __init__(self) -> None:
        self.head, self.meta, self.seen, self.digest, self.held, self.chunks = b"", None, 0, hashlib.sha256(), b"", 0

    def feed(self, data) -> None:
        self.chunks += 1
        if self.meta is None:
            self.head += bytes(data)
            warc, found, rest = self.head.partition(b"\r\n\r\n")
            http, more, rest = rest.partition(b"\r\n\r\n")
            if not (found and more):
                return
            fields = dict(line.split(": ", 1) for line in warc.decode().split("\r\n")[1:])
            inner = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
            self.meta, self.head = (fields, int(inner["Content-Length"])), b""
            self.due = int(fields["Content-Length"]) - len(http) - 4
            data = rest
        # The last four bytes after the payload end the record.
        part = memoryview(data)[: max(0, self.due - self.seen)]
        self.digest.update(part)
        self.seen += len(part)

    def row(self) -> tuple:
        fields, size = self.meta
        stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        number = lambda uri: None if uri == _uri(None) else int(uri.removeprefix("<urn:page:").rstrip(">"))
        kind = fields["WARC-Type"]
        if kind == "response" and (self.seen != size or self.digest.hexdigest() != stated):
            raise ValueError(f"record {fields['WARC-Record-ID']}: payload doesn't match its digest")
        refers_to = number(fields["WARC-Refers-To"]) if kind == "revisit" else None
        return (number(fields["WARC-Record-ID"]), size, stated, kind, refers_to, fields.get("WARC-Target-URI"), self.chunks)


def _from_chunks(batches):
    """Rows must come by record and chunk number."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("chunks", pa.int32())])
    reader = _Reader()
    for batch in batches:
        rows = []
        data, last = batch.column("data"), batch.column("last").to_pylist()
        for i in range(batch.num_rows):
            reader.feed(data[i].as_buffer())
            if last[i]:
                rows.append(reader.row())
                reader = _Reader()
        if rows:
            yield _batch(rows, schema)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of a chunk table."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    short = chunks.where("chunk = 0 and last").mapInArrow(_from_chunks, RECORDS)
    long = chunks.where("not (chunk = 0 and last)").repartition("record").sortWithinPartitions("record", "chunk")
    return short.unionByName(long.mapInArrow(_from_chunks, RECORDS))


def archive_pages(pages: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Write an archive of `pages` and read it back; without a path, into the shared folder."""
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(plan_records(pages, **columns), path)
    return read_archive(spark, path)
