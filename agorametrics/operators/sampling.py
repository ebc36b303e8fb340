"""Random picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def random_row(df: DataFrame, seed: int | None = None, key: str | None = None) -> DataFrame:
    """One row picked uniformly; no row from an empty DataFrame.

    With ``key`` and ``seed`` the pick depends on the values of that column only: the row with
    the smallest hash of seed and key. Each task keeps a single candidate, so the pick never
    sorts the data.
    """
    if key is None or seed is None:
        return df.orderBy(F.rand(seed)).limit(1)
    text = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))
    return df.orderBy(F.md5(text.cast("binary")), key).limit(1)


def random_message(messages: DataFrame, seed: int | None = None) -> DataFrame:
    return random_row(messages, seed, "id")


def random_quote(quotes: DataFrame, seed: int | None = None) -> DataFrame:
    return random_row(quotes.select("quote"), seed, "quote")
