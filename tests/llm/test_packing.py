"""Packing: every id once, no gaps, target proportions, the tokenizer's own ids."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from kinmatch.llm.packing import pack, place, target_shares
from kinmatch.llm.words import WordEncoder

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def direct(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


TEXTS = ["Plain words, twice. Plain words!", "", "é É İstanbul ΣΑΣ ﬁne don't I'LL \t tab nbsp \x1cfs", "x<|endoftext|>y <|startoftext|>", "12 345 a1b2 ##$$%% 漢字 👍🏽", "é ́x", "   \n\n  "]


def test_ids_equal_the_tokenizer():
    words = WordEncoder(PATH)
    for _ in range(2):
        assert [list(map(int, ids)) for ids in words.encode(TEXTS)] == [direct(t) for t in TEXTS]


def test_special_tokens_in_other_cases_are_ordinary_text():
    texts = ["x<|ENDOFTEXT|>y", "<|EndOfText|> and <|endoftext|>", "Plain ONE < two <|STARTOFTEXT|>"]
    assert [list(map(int, ids)) for ids in WordEncoder(PATH).encode(texts)] == [direct(t) for t in texts]


def test_place_covers_the_stream_in_proportion():
    rng = np.random.default_rng(1)
    totals, weights, length = np.array([50_000, 9_000, 700, 3]), np.array([200_000, 50_000, 12_000, 1]), 512
    stream = np.full(totals.sum(), -1)
    for q, total in enumerate(totals):
        cuts = np.unique(np.concatenate(([0, total], rng.integers(0, total, total // 90))))
        first, count = cuts[:-1], np.diff(cuts)
        doc, start, size, at = place(first, count, np.full(len(first), q), weights, totals, length)
        assert np.all(at // length == (at + size - 1) // length)
        for s, p in zip(size, at):
            assert np.all(stream[p : p + s] == -1)
            stream[p : p + s] = q
        assert np.array_equal(np.bincount(doc, size, len(first)), count)
    assert not np.any(stream < 0)
    # While all queues last, each window has its shares to within two rounds' rounding.
    shares = weights / weights.sum()
    for w in range(10):
        have = np.bincount(stream[w * length : (w + 1) * length], minlength=4)
        assert np.all(np.abs(have - length * shares) <= 5)


def test_pack(spark, documents):
    rows = [(i, f"{TEXTS[i % len(TEXTS)]} word{i} " * (i % 40), "big" if i % 3 else "small") for i in range(120)] + [(500, None, None), (500, None, None), (None, "x", "y")]
    df = documents(*rows).repartition(3)
    got = pack(df, PATH, length=64).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for i, pieces in sequences.items():
        ends = 0
        for offset, length in sorted(pieces):
            assert offset == ends
            ends += length
        assert ends == 64 or i == len(sequences) - 1
    for doc_id, text, *_ in rows:
        ids = np.array([*direct(text or ""), 2], "<u4")
        pieces = sorted(docs[doc_id], key=lambda r: r.start)
        copies = 2 if doc_id == 500 else 1
        assert sum(r.length for r in pieces) == len(ids) * copies and {r.doc_tokens for r in pieces} == {len(ids)}
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces)
    assert pack(df.limit(0), PATH).count() == 0
    weighted = pack(df, PATH, length=64, weights={"big": 0.5, "small": 0.5}).where("sequence_id < 20").groupBy("queue").sum("length").collect()
    assert all(abs(n - 640) < 64 for q, n in weighted if q in ("big", "small"))


def test_small_sources_keep_their_shares(spark, documents):
    sources = [f"site{s}" for s in range(300)]
    rows = [(40 * s + d, f"word{d} text " * 6, source) for s, source in enumerate(sources) for d in range(4)]
    rows += [(20_000 + s, "one text only " * 4, f"single{s}") for s in range(100)]
    df = documents(*rows).repartitionByRange(3, "doc_id")
    got = [r.asDict() for r in pack(df, PATH, length=256).collect()]
    assert {r["queue"] for r in got} == {"*rest*"} and {r["doc_id"] for r in got} == {r[0] for r in rows}
    cells = sorted((r["sequence_id"] * 256 + r["offset"], r["length"]) for r in got)
    assert all(at + n == next_ for (at, n), (next_, _) in zip(cells, cells[1:])) and cells[0][0] == 0
    # In each quarter of the stream each source has served a quarter, to within one document.
    end = sum(cells[-1])
    for quarter in (0.25, 0.5, 0.75):
        counts = defaultdict(int)
        for r in got:
            if r["sequence_id"] * 256 + r["offset"] < quarter * end:
                counts[r["doc_id"] // 40] += r["length"]
        size = max(r["doc_tokens"] for r in got)
        assert all(abs(counts[s] - quarter * 4 * size) <= 1.5 * size for s in range(300))
        singles = sum(1 for r in got if r["doc_id"] >= 20_000 and r["start"] == 0 and r["sequence_id"] * 256 + r["offset"] < quarter * end)
        assert abs(singles - 100 * quarter) <= 20


def test_weights_of_rare_sources(spark, documents):
    rows = [(i, f"word{i} text " * 5, f"site{i % 300}") for i in range(900)] + [(2000 + i, "rare words here", "rare") for i in range(5)]
    df = documents(*rows).repartition(2)
    got = pack(df, PATH, length=64, weights={"rare": 0.25, "*rest*": 0.75}).collect()
    assert sum(r.length for r in got if r.queue == "rare" and r.sequence_id == 0) == 16
    with pytest.raises(ValueError, match="257"):
        pack(df, PATH, weights={f"site{i}": 1.0 for i in range(257)})


def test_given_shares_hold_beside_others(spark, documents):
    rows = [(i, f"word{i} text here " * 6, "common") for i in range(400)] + [(1000 + i, f"word{i} rare " * 9, "rare") for i in range(40)]
    got = pack(documents(*rows), PATH, length=256, weights={"rare": 0.5}).where("sequence_id < 3").groupBy("queue").sum("length").collect()
    assert dict(map(tuple, got)) == {"rare": 384, "common": 384}
    shares = target_shares({"a": 0.7, "b": 0.2, "c": 0.1}, {"c": 0.4, "other": 0.3})
    assert shares == pytest.approx({"a": 0.6 * 7 / 9, "b": 0.6 * 2 / 9, "c": 0.4})
    assert target_shares({"a": 0.5, "b": 0.5}, {"a": 2.0}) == {"a": 2.0, "b": 0.0} and target_shares({}, {}) == {}


def test_rounds_by_hand():
    """The closed form against the rounds, one after the other."""
    rnd = np.random.default_rng(4)
    for length in (16, 64):
        weights = rnd.integers(1, 40, 5)
        sizes = [[int(x) for x in rnd.integers(1, 90, n)] for n in rnd.integers(1, 30, 5)]
        totals = np.array([sum(s) for s in sizes], np.int64)
        stream, served_, earned = [], [0] * 5, 0
        while any(n < t for n, t in zip(served_, totals)):
            earned += 1
            for q in range(5):
                upto = min(earned * length * int(weights[q]) // int(weights.sum()), int(totals[q]))
                stream += [(q, x) for x in range(served_[q], upto)]
                served_[q] = upto
        first = np.concatenate([np.cumsum(s) - s for s in sizes])
        count = np.concatenate([np.array(s) for s in sizes])
        queue = np.repeat(np.arange(5), [len(s) for s in sizes])
        doc, start, size, at = place(first, count, queue, weights, totals, length)
        got = {}
        for d, s, n, p in zip(doc, start, size, at):
            got.update({int(p + i): (int(queue[d]), int(first[d] + s + i)) for i in range(n)})
        assert [got[i] for i in range(len(stream))] == stream and len(got) == len(stream)
