"""WARC chunk tables: round trips, revisits and bounded chunks."""

import hashlib

import pytest
from pyspark.sql import functions as F

from kinmatch.llm.warc import plan_records, read_archive, write_archive

PAGES = "page_id long, url string, html string, record string"


def test_round_trip(spark, tmp_path):
    long = "é" * 500_000
    pages = [(1, "http://a", "x" * 120, "c"), (2, None, "x" * 120, None), (3, "http://b c\r\n", None, ""), (4, "u", "", ""), (5, "u", "short", ""), (6, "u", "short", ""), (7, "v", long, ""), (7, "v2", long, ""), (None, "n", long, "")]
    df = spark.createDataFrame(pages, PAGES)
    path = str(tmp_path / "archive")
    write_archive(plan_records(df), path, chunk_bytes=1000)
    chunks = spark.read.parquet(path)
    assert chunks.agg(F.max(F.length("data"))).first()[0] <= 1004
    got = read_archive(spark, path).collect()
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    by = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr)
    size = lambda s: len((s or "").encode())
    want = [(i, size(h), sha(h), "revisit" if i in (2, None) else "response", {2: 1, None: 7}.get(i)) for i, _, h, _ in pages if i != 7]
    want += [(7, 1_000_000, sha(long), "response", None), (7, 1_000_000, sha(long), "revisit", 7)]
    assert by == sorted(want, key=repr)
    assert {r.url for r in got if r.page_id == 3} == {"http://b%20c%0D%0A"}
    # Chunks joined in order are the bytes of a WARC file.
    whole = b"".join(bytes(r.data) for r in sorted(chunks.collect(), key=lambda r: (r.record, r.chunk)))
    at, kinds = 0, []
    while at < len(whole):
        head = whole[at : whole.index(b"\r\n\r\n", at)].decode().split("\r\n")
        assert head[0] == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in head[1:])
        at += len("\r\n".join(head).encode()) + 4 + int(fields["Content-Length"])
        assert whole[at : at + 4] == b"\r\n\r\n"
        at += 4
        kinds.append(fields["WARC-Type"])
    assert sorted(kinds) == sorted(r.record_type for r in got)


def test_wrong_digest_fails_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "some text", "")], PAGES)
    path = str(tmp_path / "bad")
    write_archive(plan_records(df).withColumn("digest", F.lit("0" * 64)), path)
    with pytest.raises(Exception, match="match its digest"):
        read_archive(spark, path).collect()
    path = str(tmp_path / "none")
    write_archive(plan_records(df.limit(0)), path)
    assert read_archive(spark, path).count() == 0
