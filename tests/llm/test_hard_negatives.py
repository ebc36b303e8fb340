import math
import random

import pytest
from pyspark.sql import functions as F

from agorametrics.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, anchors, positives=5, negatives=3):
    """The rows by lists and sorting; ``rows`` are (id, vector, label) with distinct ids."""
    x = {i: ([math.floor(256 * c) for c in v], label) for i, v, label in rows}
    out = []
    for a in anchors:
        scored = sorted((-sum(p * q for p, q in zip(x[a][0], v)), i) for i, (v, _) in x.items() if i != a)
        for s, p in [r for r in scored if x[r[1]][1] == x[a][1]][:positives]:
            inside = [(t, i) for t, i in scored if x[i][1] != x[a][1] and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(inside[:negatives])]
    return sorted(out)


def found(df, **more):
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, **more).collect())


@pytest.mark.parametrize("spread", [2, 40])
def test_against_brute_force(spark, spread, monkeypatch):
    """Few different vectors give many ties, copies and scores of zero and below."""
    monkeypatch.setattr(hard_negatives, "ROWS", 32)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "ROWS_A_TILE", 50)
    rng = random.Random(spread)
    rows = [(i, [rng.randrange(-spread, spread) / 256 for _ in range(3)], rng.randrange(3)) for i in range(-20, 180)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected = brute(rows, [i for i, _, _ in rows if i % 5 == 0])
    assert expected and found(df) == expected
    assert found(df, positives=1, negatives=20) == brute(rows, [i for i, _, _ in rows if i % 5 == 0], 1, 20)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [1.0, k / 16, 0.5], k % 2) for k in range(11)]
    odd = [(None, [1.0, 1.0, 1.0], 0), (50, None, 0), (51, [1.0, None, 1.0], 0), (52, [nan, 1.0, 1.0], 1)]
    odd += [(53, [inf, 1.0, 1.0], 1), (54, [1.0, 1.0, 1.0], None), (55, [], 0), (60, [1.0], 0)]
    df = spark.createDataFrame(good + odd, SCHEMA).withColumn("x", F.lit("clash")).withColumn("tile", F.lit(1))
    assert found(df) == brute(good, [0, 5, 10])
    assert found(df.limit(0)) == [] and found(df.where("vec_id >= 50")) == []
    assert found(df.where("vec_id < 5 and label = 0")) == []  # no row of another label


def test_rows_that_repeat_an_id(spark):
    """An anchor that stands twice counts once; other repeated rows count each."""
    rows = [(0, [1.0], 1), (0, [0.5], 1), (3, [1.0], 1), (7, [0.75], 2), (7, [0.75], 2)]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert got == [(0, 3, 1, 7, 32768, 24576), (0, 3, 2, 7, 32768, 24576)]


def test_packed_keys_sort_as_their_parts():
    rng = random.Random(5)
    big = 1 << 62
    parts = [(rng.choice([-big, -1, 0, 1, big]), rng.randrange(-big, big), rng.randrange(2), rng.randrange(-9, 9)) for _ in range(300)]
    assert all(hard_negatives.unpack(hard_negatives.pack(*p)) == p for p in parts)
    assert sorted(parts, key=lambda p: hard_negatives.pack(*p)) == sorted(parts, key=lambda p: (p[0], -p[1], *p[2:]))
