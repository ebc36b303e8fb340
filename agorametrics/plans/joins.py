"""Joins that stay even when one key holds a large share of the rows.

Where both sides of a join are shuffled for it, the adaptive skew join splits a hot key
and plain ``join`` is enough. It cannot when the other side comes out of an aggregation
or a join on the same key; these helpers are for that case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametrics.plans.hot_keys import MIN_HOT_ROWS, copy_to_pieces, cut_rows, hot_keys
from agorametrics.plans.tables import write_once

# Rows of a few numbers each: a few megabytes.
MAX_BROADCAST_ROWS = 100_000


def join_dimension(
    rows: DataFrame,
    dimension: DataFrame,
    key: str,
    spread_by: str,
    max_rows: int = MAX_BROADCAST_ROWS,
    hot_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Inner join with a narrow ``dimension`` that has one row per key.

    A dimension of at most ``max_rows`` is broadcast, which moves no rows. A larger one is
    shuffled, with the hot keys of ``rows`` cut into pieces.
    """
    if dimension.limit(max_rows + 1).count() <= max_rows:
        return rows.join(F.broadcast(dimension), key)
    return join_cut(rows, dimension, key, spread_by, hot_rows)


def join_cut(
    rows: DataFrame, dimension: DataFrame, key: str, spread_by: str, hot_rows: int = MIN_HOT_ROWS
) -> DataFrame:
    """Inner join with one row per key; hot keys of ``rows`` are cut into pieces."""
    hot = write_once(hot_keys(rows, key, min_rows=hot_rows), "hot-keys")
    if hot.isEmpty():
        return rows.join(dimension, key)
    cut = cut_rows(rows, key, spread_by, hot)
    return cut.join(copy_to_pieces(dimension, key, hot), [key, "piece"]).drop("piece")


def few_rows_with(few: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left join of a few rows (a written top list) with a dimension of any size.

    The dimension is filtered by the broadcast keys where it is read, instead of being
    shuffled for a handful of rows.
    """
    found = dimension.join(F.broadcast(few.select(key)), key, "left_semi")
    return few.join(F.broadcast(found), key, "left")
