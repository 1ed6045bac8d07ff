import random

import numpy as np
import pytest
import textbook
from native_lcs import lcs_native
from hypothesis import given, settings
from hypothesis import strategies as st

from kinmatch.functions import scorers
from kinmatch.functions.kernel import best_pairs, pair_scores, pairs_between, partial_scores

texts = st.text(alphabet="AB1 ,é", max_size=90)


def key(t):
    return " ".join(sorted(set(t.split())))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(texts, texts), min_size=1, max_size=20))
def test_scores_equal_textbook(pairs):
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    assert list(pair_scores(left, right, tokens=False)) == [textbook.ratio(a, b) for a, b in pairs]
    keys = pair_scores([key(a) for a in left], [key(b) for b in right], tokens=True)
    assert list(keys) == [textbook.token_set(a, b) for a, b in pairs]


def test_long_strings():
    rnd = random.Random(5)
    make = lambda n: "".join(rnd.choice("ABC ") for _ in range(n))
    left, right = [make(n) for n in (63, 64, 65, 127, 128, 129, 400)], [make(n) for n in (300, 64, 1, 129, 63, 500, 20)]
    assert list(pair_scores(left, right, False)) == [textbook.ratio(a, b) for a, b in zip(left, right)]
    left, right = [key(t) for t in left], [key(t) for t in right]
    assert list(pair_scores(left, right, True)) == [textbook.token_set(a, b) for a, b in zip(left, right)]


def _crowd(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("ABCDE1") for _ in range(rnd.randint(1, 6)))
    return sorted({key(" ".join(word() for _ in range(rnd.choice([0, 2, 4, 6, 30])))) for _ in range(n)})


@pytest.mark.parametrize("cutoff", [0.0, 40.0, 70.0])
@pytest.mark.parametrize("k", [1, 10])
def test_best_pairs_equal_brute_force(cutoff, k, monkeypatch):
    from kinmatch.functions import kernel

    monkeypatch.setattr(kernel, "PART", 97)  # several parts, so the carried bar is used
    left, right = _crowd(1, 40), _crowd(2, 400)
    order = np.random.default_rng(3).permutation(len(right))
    row, col, score = best_pairs(left, right, np.full(len(left), cutoff), order, k)
    got = {}
    for i, j, s in zip(row, col, score):
        got.setdefault(int(i), []).append((-s, int(order[j])))
    for i, a in enumerate(left):
        scores = [(-textbook.token_set(a, b), int(order[j])) for j, b in enumerate(right)]
        assert got.get(i, []) == sorted(s for s in scores if -s[0] >= cutoff)[:k]


def test_best_pairs_hold_no_more_than_the_best():
    import tracemalloc

    # Right strings of one length and mostly equal bounds: nearly all pairs are scored.
    rnd = random.Random(6)
    right = sorted({"".join(rnd.sample("ABCDEFGHIJ", 10)) for _ in range(3000)})
    order = np.arange(len(right))

    def peak(n):
        left = ["".join(rnd.sample("ABCDEFGHIJ", 10)) for _ in range(n)]
        tracemalloc.start()
        row, _, _ = best_pairs(left, right, np.zeros(n), order, 10)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most, len(row)

    small, large = peak(300), peak(1500)
    assert (small[1], large[1]) == (3000, 15_000)
    assert large[0] < 1.5 * small[0]


def test_pairs_between_equals_brute_force():
    left, right = _crowd(4, 30), _crowd(5, 200)
    order = np.arange(len(right))[::-1].copy()
    row, col, _ = pairs_between(left, right, 60.0, 99.0, order, 3)
    for i, a in enumerate(left):
        inside = sorted(int(order[j]) for j, b in enumerate(right) if 60 < textbook.token_set(a, b) < 99)
        assert sorted(int(order[j]) for j in col[row == i]) == inside[:3]


def test_weighted_pairs_between_equal_brute_force(monkeypatch):
    from kinmatch.functions import kernel

    monkeypatch.setattr(kernel, "PART", 61)
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("ABCD") for _ in range(rnd.randint(1, 6)))
    make = lambda: "  ".join(word() for _ in range(rnd.choice([0, 1, 2, 3, 4, 15])))
    left, right = [make() for _ in range(30)], [make() for _ in range(150)]
    order = np.random.default_rng(4).permutation(len(right))
    for low, high in ((60.0, 90.0), (85.0, 99.99)):
        row, col, _ = pairs_between(left, right, low, high, order, 2, weighted=True)
        for i, a in enumerate(left):
            inside = sorted(int(order[j]) for j, b in enumerate(right) if low < textbook.weighted(a, b) < high)
            assert sorted(int(order[j]) for j in col[row == i]) == inside[:2]


def test_native_agrees_with_kernel(spark):
    rnd = random.Random(7)
    make = lambda: "".join(rnd.choice("ABCD ") for _ in range(rnd.randint(0, 40)))
    pairs = spark.createDataFrame([(make(), make()) for _ in range(60)], "a string, b string")
    both = pairs.select("a", "b", lcs_native("a", "b").alias("lcs"), scorers.ratio("a", "b").alias("ratio"))
    for a, b, n, r in both.collect():
        assert n == textbook.lcs(a, b)
        assert r == textbook.ratio(a, b)


def test_symmetry_and_self(spark):
    pairs = spark.createDataFrame([("A B", "B C"), ("", "X"), ("", ""), (None, "X"), ("  \t", "X")], "a string, b string")
    got = pairs.select(
        scorers.token_set_ratio("a", "b"), scorers.token_set_ratio("b", "a"), scorers.token_set_ratio("a", "a"), scorers.ratio("a", "a")
    ).collect()
    assert [r[0] for r in got] == [r[1] for r in got]
    assert [r[2] for r in got] == [100.0, 0.0, 0.0, None, 0.0]
    assert [r[3] for r in got] == [100.0, 100.0, 100.0, None, 100.0]


def test_token_sort(spark):
    pairs = spark.createDataFrame([("B A A", "A B"), ("X", "X")], "a string, b string")
    assert [r[0] for r in pairs.select(scorers.token_sort_ratio("a", "b")).collect()] == [textbook.ratio("A A B", "A B"), 100.0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(texts, texts), min_size=1, max_size=10))
def test_partial_equals_textbook(pairs):
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    assert list(partial_scores(left, right)) == [textbook.partial(a, b) for a, b in pairs]


def test_weighted(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("ABC") for _ in range(rnd.randint(1, 5)))
    make = lambda: " ".join(word() for _ in range(rnd.choice([0, 1, 2, 3, 12])))
    df = spark.createDataFrame([(make(), make()) for _ in range(150)] + [(None, "A")], "a string, b string")
    got = df.select("a", "b", scorers.weighted_ratio("a", "b").alias("w")).collect()
    assert got[-1].w is None
    for r in got[:-1]:
        assert r.w == pytest.approx(textbook.weighted(r.a, r.b), abs=1e-9), (r.a, r.b)
