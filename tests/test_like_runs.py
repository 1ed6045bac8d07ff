"""Runs of like keys: bounds hold, few runs are looked at, and the join stays equal to brute force."""

import random

import numpy as np
import pytest
import textbook
from test_closed_keys import SCHEMA, _brute, _texts

from kinmatch.functions.runs import Index, best_in_runs, joined, summarize
from kinmatch.operators.like_runs import Runs
from kinmatch.operators.similarity_join import Grid, top_k_similar
from kinmatch.session import written


def _key(t):
    return " ".join(sorted(set(t.split())))


def _people(seed, n):
    """Names and addresses of few words, so that no word is rare."""
    rnd = random.Random(seed)
    last = ["ABBOTT", "BRENNER", "CALLOWAY", "EMMETT", "FARROW", "HOLLIS", "KELLER", "LOMBARD", "NORTON", "QUILL"]
    street = ["ALDER STREET,", "BIRCH ROAD,", "DOVE LANE,", "FOX HILL ROAD,", "IRON ST,", "MILL POND DR,", "PINE ST,"]
    town = ["PORTVALE, FL 34100", "EASTMERE, NY 06301", "NORTH DALE, CT 06302", "GRANTON, CT 06306"]
    return [f"{rnd.choice(last)} {rnd.randint(1, 83)} {rnd.choice(street)} {rnd.choice(town)}" for _ in range(n)]


def _index(keys, size):
    run = np.arange(len(keys)) // size
    half = len(keys) // size // 2 * size
    return Index(joined([summarize(keys[half:], run[half:]), summarize(keys[:half], run[:half])])), run


@pytest.mark.parametrize("size", [1, 4])
def test_no_key_scores_over_the_bound_of_its_run(size):
    right = sorted({_key(t) for _, t in _texts(5, 150)})
    index, run = _index(right, size)
    for left in {_key(t) for _, t in _texts(6, 60)} | {"W1", "ÉÉÉ ZOË", "A" * 300}:
        scores = np.array([textbook.token_set(left, x) for x in right])
        for bar in (0.0, 60.0, 90.0, 100.0):
            kept = index.run[index.reaching(left, bar - 0.01)]
            assert set(run[scores >= bar]) <= set(kept)


def test_few_runs_are_looked_at():
    right = sorted({_key(t) for t in _people(1, 6000)}, key=lambda t: t.split()[::-1])
    index, run = _index(right, 16)
    seen = 0
    left = [_key(t) for t in _people(2, 50)]
    for key in left:
        near = np.isin(run, index.run[index.nearest(key, 32)])
        bar = sorted(textbook.token_set(key, x) for x in np.array(right)[near])[-10]
        assert bar >= 80
        seen += len(index.reaching(key, bar))
    assert seen < 0.25 * len(left) * len(index.run)


def test_best_of_chosen_runs_equals_brute_force():
    right, left = [_key(t) for _, t in _texts(7, 120)], [_key(t) for _, t in _texts(8, 70)]
    run = np.arange(len(right)) // 8
    rnd = random.Random(3)
    wanted = [np.array(sorted(rnd.sample(range(run[-1] + 1), rnd.randint(1, 9)))) for _ in left]
    order = np.array(rnd.sample(range(len(right)), len(right)))
    row, col, score = best_in_runs(left, right, np.full(len(left), 40.0), order, run, wanted, 5)
    for i, x in enumerate(left):
        among = [j for j in range(len(right)) if run[j] in wanted[i]]
        least = [(-round(textbook.token_set(x, right[j]), 9), order[j]) for j in among]
        got = sorted((-round(s, 9), order[j]) for s, j in zip(score[row == i], col[row == i]))
        # Runs that other keys want may be looked at, too; none of the best of its own is lost.
        assert all(g <= e for g, e in zip(got, sorted(p for p in least if -p[0] >= 40)[:5]))
        assert all(abs(textbook.token_set(x, right[j]) - s) < 1e-9 for s, j in zip(score[row == i], col[row == i]))


@pytest.fixture(scope="module")
def sides(spark):
    left, right = _texts(1, 40), _texts(2, 200)
    frame = lambda rows: written(spark.createDataFrame([("K", i, t) for i, t in rows], SCHEMA))
    return left, right, frame(left), frame(right)


@pytest.mark.parametrize("runs", [Runs(), Runs(run=2, block=16, near=4, left=16), Runs(run=1, most=16, block=8, near=1)])
@pytest.mark.parametrize("cutoff", [0.0, 68.0])
def test_equal_to_brute_force(sides, runs, cutoff):
    left, right, a, b = sides
    got = top_k_similar(a.selectExpr("*", f"{cutoff}D AS cutoff"), b, 10, Grid(1, 1, runs=runs))
    assert sorted((r.a_id, r.b_id, round(r.stage1, 9), r.rank) for r in got.collect()) == _brute(left, right, cutoff, 10)


def test_kinds_are_kept_apart(spark):
    texts = [(i, t) for i, t in enumerate(_people(3, 60))]
    a = written(spark.createDataFrame([(k, i, t) for k in "XY" for i, t in texts[:9]], SCHEMA))
    b = written(spark.createDataFrame([(k, i, t) for k in "YZ" for i, t in texts], SCHEMA))
    got = top_k_similar(a.selectExpr("*", "50D AS cutoff"), b, 3, Grid(1, 1, runs=Runs(run=2, block=8, near=4)))
    found = sorted((r.kind, r.a_id, r.b_id, round(r.stage1, 9), r.rank) for r in got.collect())
    assert found == [("Y", *x) for x in _brute(texts[:9], texts, 50.0, 3)]


def test_large_tables_are_searched_in_runs():
    assert Grid.plan(360_000, 5_400_000, 8).runs and not Grid.plan(1000, 15_000, 8).runs
    assert Runs().sized(10**9).run * Runs().most >= 10**9
