"""Spreading keys that hold a large share of all rows over several tasks.

A single join is left to the adaptive skew join. These helpers are for partitionings
that are kept and joined again and again, where a hot key would slow down every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot above total / MAX_HOT_KEYS rows, so there are fewer hot keys than this.
MAX_HOT_KEYS = 1000
# ... but never below this many rows, which one task handles with ease.
MIN_HOT_ROWS = 1_000_000


def hot_keys(
    df: DataFrame, key: str, max_keys: int = MAX_HOT_KEYS, min_rows: int = MIN_HOT_ROWS
) -> DataFrame:
    """Keys above the limit with the number of pieces to cut each into.

    Fewer than ``max_keys`` keys can each hold more than ``total / max_keys`` rows, so
    the result is safe to broadcast whatever the size of ``df``.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("rows"))
    total = df.agg(F.count("*")).scalar()
    limit = F.greatest(total / F.lit(max_keys), F.lit(float(min_rows)))
    return (
        counts.withColumn("limit", limit)
        .where(F.col("rows") > F.col("limit"))
        .select(key, F.ceil(F.col("rows") / F.col("limit")).cast("int").alias("pieces"))
    )


def cut_rows(df: DataFrame, key: str, spread_by: str, hot: DataFrame) -> DataFrame:
    """Add ``piece``: rows of a hot key are spread by the hash of another column."""
    pieces = F.coalesce(F.col("pieces"), F.lit(1))
    return (
        df.join(F.broadcast(hot), key, "left")
        .withColumn("piece", F.pmod(F.xxhash64(spread_by), pieces).cast("int"))
        .drop("pieces")
    )


def copy_to_pieces(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Add ``piece``: one copy of each row of ``df`` per piece of its key."""
    last = F.coalesce(F.col("pieces"), F.lit(1)) - 1
    return (
        df.join(F.broadcast(hot), key, "left")
        .withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
        .drop("pieces")
    )
