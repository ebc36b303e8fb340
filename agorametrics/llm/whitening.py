"""Embedding whitening; the components come from a QDWH spectral divide-and-conquer.

Spark makes the list of different vectors, their sums and their covariance, centred before it is
multiplied: tasks hold one matrix of the dimension each, and a tree adds these up. The covariance,
whose size is that of the dimension whatever the number of rows, is then divided: the polar factor
U of V - s I, by QR-based dynamically weighted Halley steps, gives the projector (U + I) / 2 on
the eigenvectors above s. An orthogonal basis of its range and of the rest cuts V into two smaller
blocks, and so on until blocks are single components, or multiples of the identity, whose every
basis is one. Only blocks that hold wanted components are divided. The projection of
the wanted components is broadcast with the plan and each row is whitened where it is.

Defined cases: rows with a null vector, or null or non-finite entries, are left out, as are vectors
of another length than the most frequent; null or repeated ids keep their rows; equal vectors
count once in the fit; ``whitened`` is null on components without variance (to double precision),
``explained`` if there is no variance at all, ``deviation`` if it doesn't fit a long,
``identity_error`` if no component has variance; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametrics.llm.vectors import matrix, whole_vectors
from agorametrics.plans.tables import write_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMPONENTS = 4
EPS = np.finfo(np.float64).eps
STEPS = 40
SEED = 7


class Fit(NamedTuple):
    """What is fitted: n vectors, sums, the falling eigenvalues, components as columns, the trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH; ``a`` must not be singular."""
    m = len(a)
    x = a / np.linalg.norm(a)
    r = np.linalg.qr(x, mode="r")
    # A lower bound of the smallest singular value.
    least = 1.0 / np.linalg.norm(np.linalg.solve(r, np.eye(m)))
    for _ in range(STEPS):
        if abs(1.0 - least) <= 4 * EPS:
            break
        square = least * least
        d = np.cbrt(4.0 * (1.0 - square) / square**2)
        root = np.sqrt(1.0 + d)
        a_ = root + np.sqrt(8.0 - 4.0 * d + 8.0 * (2.0 - square) / (square * root)) / 2.0
        b = (a_ - 1.0) ** 2 / 4.0
        c = a_ + b - 1.0
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(m)]))
        x = (b / c) * x + (a_ - b / c) / np.sqrt(c) * (q[:m] @ q[m:].T)
        x = (x + x.T) / 2.0
        least = min(1.0, least * (a_ + b * square) / (1.0 + c * square))
    return x


def divide(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span the eigenvectors above some value, and k.

    None if no value tells eigenvalues apart.
    """
    m, size = len(a), np.linalg.norm(a)
    mean = np.trace(a) / m
    spread = np.linalg.norm(a - mean * np.eye(m))
    for at in (float(np.median(np.diag(a))), mean, mean + 0.1 * spread / m, mean - 0.1 * spread / m):
        shifted = a - at * np.eye(m)
        try:
            projector = (polar_factor(shifted) + np.eye(m)) / 2.0
        except np.linalg.LinAlgError:  # the value is an eigenvalue
            continue
        k = round(float(np.trace(projector))) if np.isfinite(projector).all() else 0
        if 0 < k < m and np.linalg.norm(projector @ projector - projector) <= 1e-8 * m:
            random = np.random.default_rng(SEED).standard_normal((m, m))
            start = np.hstack([projector @ random[:, :k], random[:, k:] - projector @ random[:, k:]])
            basis, _ = np.linalg.qr(start)
            first = np.linalg.qr(projector @ basis[:, :k])[0]
            basis, _ = np.linalg.qr(np.hstack([first, basis[:, k:]]))
            if np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k]) <= 1e-10 * size:
                return basis, k
    return None


def largest_components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and their eigenvectors."""
    scale = np.linalg.norm(v)
    values, vectors = [], []
    todo = [(np.eye(len(v)), wanted)]
    while todo:
        basis, need = todo.pop()
        block = basis.T @ v @ basis
        block = (block + block.T) / 2.0
        m = len(block)
        alike = m == 1 or np.linalg.norm(block - np.trace(block) / m * np.eye(m)) <= 8 * EPS * m * scale
        cut = None if alike else divide(block)
        if cut is None:
            order = np.argsort(-np.diag(block), kind="stable")[:need]
            values += np.diag(block)[order].tolist()
            vectors += [basis[:, j] for j in order]
            continue
        own, k = cut
        if need > k:
            todo.append((basis @ own[:, k:], need - k))
        todo.append((basis @ own[:, :k], min(need, k)))
    vectors = np.array(vectors).T.reshape(len(v), -1)
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _added(vectors: DataFrame, part) -> np.ndarray | None:
    """The sum over all vectors of ``part(matrix of some rows)``, added up in the tasks and a tree."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                more = part(matrix(batch.column("x")))
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_pydict({"kind": [total.dtype.str], "total": [total.tobytes()]})

    sums = vectors.mapInArrow(each, "kind string, total binary").rdd
    sums = sums.map(lambda r: np.frombuffer(r.total, dtype=r.kind).copy())
    return sums.treeAggregate(None, *[lambda a, b: b if a is None else a if b is None else a + b] * 2)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Fits the components of ``vectors`` (x), each different one counting once."""
    vectors = write_once(vectors.select("x").distinct(), "fit-list")
    counted = _added(vectors, lambda x: np.append(x.sum(axis=0), len(x)))
    if counted is None:
        return None
    n, sums = int(counted[-1]), counted[:-1]
    mean, width = sums / n, len(sums)

    def products(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return (centred.T @ centred).ravel()

    v = _added(vectors, products).reshape(width, width) / n
    values, vecs = largest_components(v, min(components, width))
    trace = float(np.trace(v))
    values = np.where(values > 64 * EPS * width * max(trace, 0.0), values, 0.0)
    real = vecs[:, values > 0] / np.sqrt(values[values > 0])
    if not real.shape[1]:
        return Fit(n, sums, values, vecs, trace, None)

    def of_whitened(x: np.ndarray) -> np.ndarray:
        white = (x - mean) @ real
        return np.append((white.T @ white).ravel(), white.sum(axis=0))

    k = real.shape[1]
    total = _added(vectors, of_whitened) / n
    covariance = total[: k * k].reshape(k, k) - np.outer(total[k * k :], total[k * k :])
    return Fit(n, sums, values, vecs, trace, float(np.abs(covariance - np.eye(k)).max()))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Per row the exact sum of (n * x - S)^2; None beyond a long."""
    rough = ((float(n) * x - sums) ** 2).sum(axis=1)
    if not len(rough) or rough.max() < 2.0**61:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    total = [int(s) for s in sums]
    exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, total, strict=True)) for row in x]
    return [e if e < 1 << 63 else None for e in exact]


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row and component."""
    rows = whole_vectors(embeddings, "vec_id")
    found = fit(rows, components)
    schema = "vec_id long, deviation long, whitened array<double>"
    if found is None:
        rows, found = rows.limit(0), Fit(0, np.zeros(0), np.zeros(0), np.zeros((0, 0)), 0.0, None)
    n, sums, values, vecs, trace, error = found
    mean = sums / max(n, 1)
    with np.errstate(divide="ignore"):
        scales = np.where(values > 0, 1.0 / np.sqrt(values), np.nan)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                white = (x - mean) @ vecs * scales
                white = [[None if np.isnan(w) else w for w in row] for row in white.tolist()] if np.isnan(scales).any() else white.tolist()
                cols = [batch.column("vec_id"), pa.array(deviations(x, n, sums), pa.int64()), pa.array(white, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "deviation", "whitened"])

    share = [float(e / trace) if trace > 0 else None for e in values]
    out = rows.mapInArrow(each, schema).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*map(F.lit, share)).cast("array<double>"), F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
