import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from agorametrics.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def with_values(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        [5.0, 4.0, 3.0, 2.0, 1.0],
        [1e8, 1.0, 1e-4, 1e-8],
        [2.0, 2.0, 2.0, 1.0, 1.0],
        [3.0, 3.0, 3.0],
        [4.0, 0.0, 0.0, 0.0],
        [0.0, 0.0],
        [7.0],
        [1.0, 0.0, -1.0],
        np.linspace(1, 2, 64).tolist(),
        [1.0 + 1e-13, 1.0, 0.5],
    ],
)
def test_components_equal_those_of_lapack(values):
    v = with_values(np.array(values))
    for wanted in (1, 3, len(values)):
        wanted = min(wanted, len(values))
        found, vectors = whitening.largest_components(v, wanted)
        scale = max(map(abs, values)) or 1.0
        assert np.allclose(found, np.sort(values)[::-1][:wanted], atol=1e-13 * scale * len(values), rtol=0)
        assert np.allclose(vectors.T @ vectors, np.eye(wanted), atol=1e-12)
        assert np.abs(v @ vectors - vectors * found).max() <= 1e-12 * scale * len(values)


def test_polar_factor():
    a = with_values(np.array([3.0, 1e-3, -2.0, -1e-9]))
    u = whitening.polar_factor(a)
    assert np.allclose(u @ u, np.eye(4), atol=1e-12) and np.allclose(u @ a, (u @ a).T, atol=1e-12)
    assert round(np.trace(u)) == 0


def brute(rows):
    """By LAPACK: {(id, component): (n, deviation, |whitened|, explained)}."""
    x = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array(sums) / n
    v = (np.array(fit) - mean).T @ (np.array(fit) - mean) / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    out = {}
    for i, c in x:
        white = np.abs((np.array(c) - mean) @ vectors / np.sqrt(values))
        dev = sum((n * a - s) ** 2 for a, s in zip(c, sums))
        out |= {(i, k + 1): (n, dev, white[k], values[k] / np.trace(v)) for k in range(len(values))}
    return out


def test_query_equals_brute_force(spark, duck, sf):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    expected = brute(rows)
    got = queries.op13_whitening(spark, sf).collect()
    assert len(got) == len(expected) == 4 * len(rows)
    for r in got:
        n, deviation, white, explained = expected[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"]) == pytest.approx(white, abs=1e-8) and r["explained"] == pytest.approx(explained, rel=1e-9)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_one_sign_for_all_rows(spark, duck, sf):
    rows = dict(duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall())
    got = [r for r in queries.op13_whitening(spark, sf).collect() if r["component"] == 1]
    white = np.array([r["whitened"] for r in got])
    x = np.array([[math.floor(256 * c) for c in rows[r["vec_id"]]] for r in got])
    line, *_ = np.linalg.lstsq(x - x.mean(axis=0), white, rcond=None)
    assert np.allclose((x - x.mean(axis=0)) @ line, white - white.mean(), atol=1e-6)


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [0.0, 1.0], None), (4, [0.5, 3.0], 1)]
    odd = [(5, None, 0), (6, [nan, 1.0], 0), (7, [None, 1.0], 0), (8, [-float("inf"), 1.0], 0), (9, [], 0), (10, [1.0], 0)]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumn("x", F.lit("clash")).withColumn("whitened", F.lit(1))
    got = whitening.whitened(df).collect()
    assert sorted(((r["vec_id"], r["component"]) for r in got), key=str) == sorted(
        [(i, k) for i in (1, 1, None, 4) for k in (1, 2)], key=str
    )
    expected = brute([(i, v) for i, v, _ in rows])
    for r in got:
        want = expected[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == want[:2] == (3, want[1]) and abs(r["whitened"]) == pytest.approx(want[2])
    assert whitening.whitened(df.limit(0)).count() == 0 and whitening.whitened(df.where("vec_id = 5")).count() == 0


def test_without_variance(spark):
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, SCHEMA)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 6
    flat = [(k, [k / 4, 1.0, 1.0], 0) for k in range(5)]
    got = whitening.whitened(spark.createDataFrame(flat, SCHEMA)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got)
    assert all(r["explained"] == pytest.approx(1.0) for r in got if r["component"] == 1) and got[0]["identity_error"] < 1e-12


def test_deviation_beyond_a_long():
    x = np.array([[1 << 40, 0], [0, 1]])
    assert whitening.deviations(x, 10, np.array([5, 5])) == [None, 50]
    assert whitening.deviations(np.array([[3 << 28, 0]]), 1, np.array([0, 1])) == [(3 << 28) ** 2 + 1]
