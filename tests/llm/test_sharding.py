"""Byte-size shards: contiguous, balanced, gapless."""

import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from kinmatch.llm.sharding import byte_shards


def test_balance_and_order(spark, documents):
    rows = [(i * 3 - 500, "é" * (i * 37 % 211)) for i in range(900)]
    got = byte_shards(documents(*rows).withColumn("part", F.lit("x")).repartition(5), shards=24).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in rows}
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.doc_id):
        by[r.shard].append(r)
    total = sum(r.size for r in got)
    assert sorted(by) == list(range(24))
    ends = None
    for shard in range(24):
        assert [r.slot for r in by[shard]] == list(range(len(by[shard])))
        assert abs(sum(r.size for r in by[shard]) - total / 24) <= max(r.size for r in got)
        assert ends is None or by[shard][0].doc_id > ends
        ends = by[shard][-1].doc_id


def test_defined_cases(spark, documents):
    rows = [(None, "a"), (1, None), (1, None), (1, "b"), (2, "x" * 500_000), (3, "")]
    got = byte_shards(documents(*rows), shards=24).collect()
    assert len(got) == 6 and {r.size for r in got if r.doc_id == 1} == {8, 9}
    assert [r.shard for r in got if r.doc_id is None] == [0] and all(0 <= r.shard < 24 for r in got)
    assert byte_shards(documents((1, "a")).limit(0)).count() == 0
