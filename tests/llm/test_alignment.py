"""Cross-tokenizer alignment against a plain-Python version."""

import hashlib
import os
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinmatch.llm import alignment
from kinmatch.llm.alignment import Aligned, Coder, byte_level, gallop, least_count, linked_ids, piece_bytes

public_tokenizers = pytest.importorskip("public_tokenizers")
FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoders():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FIRST)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=SECOND)
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    by_char = {chr(c): c for c in letters} | {chr(256 + n): c for n, c in enumerate(c for c in range(256) if c not in letters)}
    bytes_a = lambda i: bytes(by_char[c] for c in a.id_to_token(i))

    def bytes_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    return lambda t: [(i, bytes_a(i)) for i in a.encode(" " + t, add_special_tokens=False).ids], lambda t: [(i, bytes_b(i)) for i in b.encode(t)]


def by_hand(rows, encoders):
    told, having = [], Counter()
    for i, text in rows:
        sides = [e(text) for e in encoders] if text else [[], []]
        if any(b"".join(x for _, x in s) != (" " + (text or "")).encode() for s in sides):
            told.append((i, [[], []], [], []))
            continue
        spans = []
        for s in sides:
            at, mine = 0, []
            for id_, x in s:
                mine.append((id_, at, at + len(x)))
                at += len(x)
            spans.append(mine)
        links = [(p[0], q[0]) for p in spans[0] for q in spans[1] if p[1] < q[2] and q[1] < p[2]]
        ends = sorted({p[2] for p in spans[0]} & {q[2] for q in spans[1]})
        groups = [tuple([x[0] for x in s if low < x[2] <= high] for s in spans) for low, high in zip([0, *ends], ends)]
        told.append((i, spans, links, groups))
        having.update(set(links))
    best = {}
    for (a, _), n in having.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for i, spans, links, groups in told:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        n_best = sum(having[x] == best[x[0]] for x in links)
        out.append((i, len(spans[0]), len(spans[1]), len(groups), len(links), n_best, sum(having[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def run(docs, **options):
    return sorted(map(tuple, linked_ids(docs, FIRST, SECOND, **options).select(*COLUMNS).collect()), key=repr)


def test_defined_cases(spark, encoders):
    words = "Übergrößenträger naïve coöperation 東京都 🙂🙂 antidisestablishmentarianism \t\n  x"
    rows = [(1, None), (2, ""), (3, " "), (4, "<|endoftext|> and <s> </s> <unk>"), (5, "a▁b"), (6, words), (6, words), (7, words), (None, "plain words"), (8, "one two three " * 200), (9, "\x00 nul"), (10, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 50)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, node int, pair string, `a.b` int")
    expected = by_hand(rows, encoders)
    for most in (0, 50, 1 << 18):
        assert run(docs, most=most) == expected
    assert sum(r[1] > 0 for r in expected) >= 8 and (5, 0, 0, 0, 0, 0, 0, "") in expected
    assert run(docs.limit(0)) == []


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_documents(spark, encoders):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect() if r.text is None or len(r.text) < 1200]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(docs) == by_hand(rows, encoders)


def test_bytes_of_all_ids():
    a, b = Coder(FIRST), Coder(SECOND)
    assert sorted(x for x in a.bytes if len(x) == 1) == [bytes([i]) for i in range(256)]
    assert byte_level("Ġthe") == b" the" and piece_bytes("<0x0A>") == b"\n" and piece_bytes("▁é") == " é".encode()
    assert all(b.bytes) and a.size.min() > 0


def test_memory_is_bounded(monkeypatch, encoders):
    pieces, _ = alignment._encoder(FIRST, SECOND)
    monkeypatch.setattr(alignment, "MOST_PIECES", 3)
    for text in ("one two three", "four five", "one five six seven eight", "a\tb  c"):
        numbers, counts = pieces.numbers([text])
        assert [p.of(numbers).tolist() for p in pieces.pools] == [[i for i, _ in e(text)] for e in encoders]
        assert len(pieces) <= 8 and list(counts) == [len(alignment._CUT.split(text))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 6), min_size=1, max_size=90), st.integers(0, 2**30)), min_size=1, max_size=6))
def test_groups_and_links(docs):
    """Random cuts of the same bytes on both sides."""
    sizes, counts, expected = ([], []), ([], []), []
    for n, (mine, seed) in enumerate(docs):
        rnd, total, other = np.random.default_rng(seed), sum(mine), []
        while sum(other) < total:
            other.append(min(int(rnd.integers(1, 9)), total - sum(other)))
        pair = (mine, other) if seed % 2 else (other, mine)
        base = [sum(c) for c in counts]
        spans = [list(zip(np.cumsum(s) - s, np.cumsum(s))) for s in pair]
        expected += [(n, base[0] + i, base[1] + j) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]]
        for s in (0, 1):
            sizes[s].extend(pair[s])
            counts[s].append(len(pair[s]))
    found = Aligned(tuple(np.array(s) for s in sizes), tuple(np.array(c) for c in counts))
    assert sorted(zip(*map(list, found.links()))) == sorted(expected)
    ends = [np.cumsum(s) for s in sizes]
    doc, a, b = found.cuts()
    common = sorted(set(ends[0]) & set(ends[1]))
    assert list(ends[0][a]) == common == list(ends[1][b])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, unique=True), st.lists(st.integers(-1, 310), min_size=1), st.data())
def test_gallop(numbers, wanted, data):
    longer = np.array(sorted(numbers))
    x = np.array(wanted)
    low = np.array([data.draw(st.integers(0, int(np.searchsorted(longer, v)))) for v in wanted])
    found = gallop(longer, x, low, np.full(len(x), len(longer)))
    assert list(found) == list(np.searchsorted(longer, x))


def test_bound_of_the_broadcast(spark):
    counts = spark.range(1, 2000).selectExpr("id AS pair", "id AS docs", "true AS best")
    for most in (0, 5, 700, 5000):
        least = least_count(counts, most)
        assert counts.where(f"docs >= {least}").count() <= most
    assert least_count(counts.limit(0)) > 0
