"""Embedding rows as vectors of whole numbers, for the operators on embeddings."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 256


def whole_vectors(embeddings: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``x``, the vector with each component c as floor(256 * c).

    Rows whose vector is null, or holds null or non-finite entries, are left out. So are rows whose
    vector is not of the most frequent length (the longest of equals), which one inner product
    could not take.
    """
    broken = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = embeddings.select(*columns, F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & ~broken)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = common["n"] if common else 0
    x = F.transform("v", lambda c: F.floor(F.lit(float(SCALE)) * c))
    return rows.where((F.size("v") == length) & (F.size("v") > 0)).select(*columns, x.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length as a matrix."""
    if not len(column):
        return np.zeros((0, 0), dtype=np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
