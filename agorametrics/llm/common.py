"""Small things that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of the white-space kind, and the separators between them.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

# What may be sent to every executor at once.
BROADCAST_BYTES = 8 << 20


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else.

    ``lower`` does the same on ASCII text and is much faster than ``translate``.
    """
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(slow)


def text_key(text: Column) -> Column:
    """Tells apart rows that share a doc_id; with doc_id it names a row."""
    return F.xxhash64(text)


def word_count(text: Column) -> Column:
    """Number of white-space words; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    return inner_size(parts)


def inner_size(parts: Column) -> Column:
    """Size of a split text without the empty strings at its two ends."""
    ends = (F.get(parts, F.lit(0)) == "").cast("long") + (
        (F.size(parts) > 1) & (F.element_at(parts, -1) == "")
    ).cast("long")
    return F.size(parts).cast("long") - ends


def row_struct(docs: DataFrame) -> DataFrame:
    """All columns in one struct, so that added columns can have any name."""
    return docs.select(F.struct("*").alias("row"))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Equal doc_id, nulls included, and equal text key."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])
