"""Keys that leave the grid: the join stays equal to brute force."""

import random

import pytest
import textbook

from kinmatch.operators.closed_keys import Closing, split_closed
from kinmatch.operators.similarity_join import Grid, top_k_similar
from kinmatch.session import written

SCHEMA = "kind string, id long, search string"


def _texts(seed, n):
    """Names with many near copies, equal keys, a hot one, empty ones, a long one and a lone hot token."""
    rnd = random.Random(seed)
    words = ["OAKLEY", "ELMER", "PINE", "ASHTON", "MAPLEWOOD", "ST,", "RD,", "CT", "NY", "LAKESIDE", "É", "ZOË"]

    def typo(t):
        i = rnd.randrange(len(t) + 1)
        return t[:i] + rnd.choice(["", "X", "E", " "]) + t[i + rnd.choice([0, 1]) :]

    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 5))) + f" {rnd.randint(1, 40)}" for _ in range(25)]
    texts = [typo(rnd.choice(base)) if rnd.random() < 0.6 else rnd.choice(base) for _ in range(n)]
    texts += ["OAKLEY ST, CT"] * (n // 3) + ["", "  ", "CT", "ST,", "A", " ".join(f"W{i}" for i in range(120)), " ".join(f"W{i}" for i in range(2, 122))]
    return list(enumerate(texts))


def _brute(left, right, cutoff, k):
    out = []
    for i, x in left:
        scored = sorted((-textbook.token_set(x, y), j) for j, y in right)
        out += [(i, j, round(-s, 9), r + 1) for r, (s, j) in enumerate([p for p in scored if -p[0] >= cutoff][:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def sides(spark):
    left, right = _texts(1, 40), _texts(2, 200)
    frame = lambda rows: written(spark.createDataFrame([("K", i, t) for i, t in rows], SCHEMA))
    return left, right, frame(left), frame(right)


@pytest.mark.parametrize("closing", [Closing(), Closing(rare=3, bar=70.0), Closing(bar=80.0, most=60), Closing(bar=100.0), Closing(rare=10**6, bar=75.0, most=0)])
@pytest.mark.parametrize("cutoff", [0.0, 68.0])
def test_equal_to_brute_force(sides, closing, cutoff):
    left, right, a, b = sides
    got = top_k_similar(a.selectExpr("*", f"{cutoff}D AS cutoff"), b, 10, Grid(2, 2, closing=closing))
    assert sorted((r.a_id, r.b_id, round(r.stage1, 9), r.rank) for r in got.collect()) == _brute(left, right, cutoff, 10)


def test_high_bars_leave_the_grid(spark):
    # Ten right rows equal each left one, so only full scores matter.
    a = spark.range(50).selectExpr("'K' AS kind", "concat('NAME', id, ' FAMILY', id) AS token_key", "60D AS cutoff", "id AS no")
    b = spark.range(50).selectExpr("'K' AS kind", "concat('NAME', id, ' FAMILY', id) AS token_key", "transform(sequence(0, 9), i -> id * 10 + i) AS ids", "id * 10 AS no")
    rest, found = split_closed(a, b, 10, Closing())
    assert rest.count() == 0 and found.where("score = 100").count() == 50
    rest, found = split_closed(a, b, 11, Closing())
    assert rest.count() == 50 and found.count() == 0


def test_hot_keys_stay(spark):
    a = spark.createDataFrame([("K", "SMITH", 60.0, 1), ("K", "JONES X", 60.0, 2)], "kind string, token_key string, cutoff double, no long")
    b = spark.range(500).selectExpr("'K' AS kind", "concat('N', id, IF(id < 480, ' SMITH', ' JONES')) AS token_key", "array(id) AS ids", "id AS no")
    b = b.unionByName(spark.createDataFrame([("K", "JONES X", list(range(900, 910)), 900), ("K", "SMITH", list(range(910, 920)), 910)], b.schema))
    rest, _ = split_closed(a, b, 10, Closing(most=100))
    assert [r.token_key for r in rest.collect()] == ["SMITH"]


def test_bound_of_bars():
    with pytest.raises(ValueError, match="70"):
        Closing(bar=60.0)
