import math
from collections import Counter

import pytest

from kinmatch.operators.cosine import ADDRESS, GRID, NAME, CosineConfig, cosine_scores

PAIRS = [
    ("37 BIRCHWOOD ST, ELMFORD, OH 44901", "37 QUARRY ST, ELMFORD, OH 44901"),
    ("914 HOLLOW RD TRLR 6, GREENPORT, OH 4490", "914 HOLLOW RD LOT 2, GREENPORT, OH 04490"),
    ("771 CEDAR ST, WHITEBRIDGE, OH 44907", "771 CEDAR ST, ELMFORD, OH 44901"),
    ("771 CEDAR ST, ELMFORD, OH 4901", "771 CEDAR ST, ELMFORD, OH 04901-2230"),
    ("640 ASPEN  STREET, LOWFIELD, OH 04904", "640 ASPEN ST, LOWFIELD, OH 04904"),
    ("52 KESTREL RD UNIT 17, NORTHVALE, OH 4490", "52 KESTREL RD APT 17, NORTHVALE, OH 04490"),
]
# (sizes of the character n-grams, whether counts are damped)
CONFIGS = {"v1": ((2, 3, 4), False), "v2": ((2, 3, 4, 5), False), "v3": ((3, 4), False), "v4": ((2, 3), True)}


def by_hand(a, b, sizes, damped):
    """Cosine of the two strings' n-gram counts, each gram weighing more if only one string has it."""
    count = [Counter(t[i : i + n] for n in sizes for i in range(len(t) - n + 1)) for t in (" ".join(x.lower().split()) for x in (a, b))]
    weigh = lambda c, g: ((1 + math.log(c[g])) if damped else c[g]) * (1.0 if g in count[0] and g in count[1] else math.log(1.5) + 1) if g in c else 0.0
    x, y = ({g: weigh(c, g) for g in count[0] | count[1]} for c in count)
    norm = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
    return 100 * sum(x[g] * y[g] for g in x) / norm


def test_grid(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(PAIRS)], "id int, a string, b string")
    got = {(r.id, r.config): r.cosine for r in cosine_scores(df, "id", "a", "b", GRID).collect()}
    for i, pair in enumerate(PAIRS):
        for name, config in CONFIGS.items():
            assert got[i, name] == pytest.approx(by_hand(*pair, *config), abs=0.011)


def test_edges(spark):
    df = spark.createDataFrame([(0, "", "X"), (1, "ANN  LEE", "ann lee"), (2, "A", "A"), (3, "ANN LEE", "ANN RAY")], "id int, a string, b string")
    chars = {r.id: r.cosine for r in cosine_scores(df, "id", "a", "b", (ADDRESS,)).collect()}
    words = {r.id: r.cosine for r in cosine_scores(df, "id", "a", "b", (NAME,)).collect()}
    assert chars == {0: 0.0, 1: 100.0, 2: 0.0, 3: chars[3]} and 0 < chars[3] < 100
    assert words == {0: 0.0, 1: 100.0, 2: 0.0, 3: words[3]} and 0 < words[3] < 100


def test_feature_limit(spark):
    df = spark.createDataFrame([(0, "AAAB", "AAAC")], "id int, a string, b string")
    one = cosine_scores(df, "id", "a", "b", (CosineConfig("one", "char", 1, 1, max_features=1),)).first()
    assert one.cosine == 100.0  # only the most frequent gram is left
