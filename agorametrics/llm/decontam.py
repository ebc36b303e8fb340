"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is 13 consecutive words of an item. Since all of its words must occur, one of them is
a sufficient prefix: the rarest over all documents. Words are counted once for that. Then each
word of each document is looked up among these anchors; a hit fixes where the window would
begin, the bounds of the text are checked, and the words are compared. All of this happens in
the row of the document, so nothing but true occurrences is shuffled.

Defined cases: null and empty texts have no words and are never contaminated; items without a
word have no window; equal windows of several items count for all of them; windows of items
with a null item_id are hit like any other, only the null is not among the items; texts of any
length are taken whole; rows that agree in doc_id and text get the same result; empty tables
give no hits; other columns, of any name, are only kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorametrics.llm.common import BROADCAST_BYTES, ascii_lower, inner_size, same_row, text_key
from agorametrics.plans.tables import write_once

WINDOW = 13
# Everything but letters, digits and what is not ASCII; A-Z are lower-cased later on.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# A document is contaminated if at least one word in so many is hit.
HIT_SHARE = 20


def _words(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), SEPARATORS)


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, length, items): each different window and the items that hold it."""
    words = F.filter(F.split(ascii_lower(F.coalesce("text", F.lit(""))), SEPARATORS), lambda w: w != "")
    items = benchmark.select("item_id", words.alias("words"))
    last = F.greatest(F.size("words") - window, F.lit(0))
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(0), last))
    cut = F.slice("words", F.col("start") + 1, window)
    each = items.select("item_id", "words", F.explode(starts).alias("start")).select(
        "item_id", F.array_join(cut, " ").alias("window"), F.size(cut).alias("length")
    )
    return each.groupBy("window", "length").agg(F.collect_set("item_id").alias("items"))


def _small(df: DataFrame, size: Column) -> int:
    """In how many parts of at most the broadcast bound ``df`` goes."""
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return max(1, math.ceil(total / BROADCAST_BYTES))


def anchored(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """``windows`` with the ``anchor``, its rarest word, and the anchor's ``offset``.

    Words are compared in Unicode lower case here, which can only make an anchor fit more often.
    Windows with a word that no document has are left out.
    """
    words = windows.select(
        "window", "length", "items", F.posexplode(F.split("window", " ")).alias("offset", "word")
    ).withColumn("anchor", F.lower("word"))
    vocabulary = write_once(words.select("anchor").distinct(), "item-words")
    said = docs.select(F.explode(_words("text")).alias("word")).select(F.lower("word").alias("anchor"))
    if _small(vocabulary, F.octet_length("anchor") + 16) == 1:
        counts = said.join(F.broadcast(vocabulary), "anchor").groupBy("anchor").agg(F.count("*").alias("uses"))
    else:
        counts = said.groupBy("anchor").agg(F.count("*").alias("uses")).join(vocabulary, "anchor")
    counts = write_once(counts, "item-word-uses")
    rarest = F.min(F.struct("uses", "anchor", "offset")).alias("rarest")
    found = words.join(counts, "anchor").groupBy("window", "length").agg(
        rarest, F.count("*").alias("known"), F.first("items").alias("items")
    )
    return found.where("known = length").select(
        "window", "length", "items", F.col("rarest.anchor"), F.col("rarest.offset")
    )


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, start, length, items) of every window in every document."""
    windows = write_once(item_windows(benchmark, window), "item-windows")
    index = write_once(anchored(windows, docs), "item-anchors")
    size = F.octet_length("window") + F.octet_length("anchor") + 8 * F.size("items") + 64
    parts = _small(index, size)
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), _words("text").alias("words"))
    said = keyed.select("doc_id", "text_key", "words", F.posexplode("words").alias("at", "word"))
    said = said.withColumn("anchor", F.lower("word"))
    start = F.col("at") - F.col("offset")
    cut = F.slice("words", start + 1, F.col("length"))
    fits = (
        (start >= 0)
        & (start + F.col("length") <= F.size("words"))
        & (ascii_lower(F.array_join(cut, " ")) == F.col("window"))
    )
    found = None
    # One pass over the documents for each part of the index that can be broadcast.
    for part in range(parts):
        own = index.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part)
        hits = said.join(F.broadcast(own), "anchor").where(fits)
        hits = hits.select("doc_id", "text_key", start.alias("start"), "length", "items")
        found = hits if found is None else found.unionByName(hits)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, n_hit, items) of the documents with a hit; items as sorted strings."""
    spans = F.array_sort(F.collect_set(F.struct("start", "length")))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
            (
                acc["words"]
                + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(acc["end"], s["start"]))
            ).alias("words"),
        ),
        lambda acc: acc["words"],
    )
    items = F.array_distinct(F.flatten(F.collect_set("items")))
    items = F.array_sort(F.transform(items, lambda i: i.cast("string")))
    return occurrences(docs, benchmark, window).groupBy("doc_id", "text_key").agg(
        covered.alias("n_hit"), items.alias("items")
    )


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (HIT_SHARE * n_hit >= n_words)


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, items, contaminated) per row of ``docs``."""
    hits = write_once(contamination(docs, benchmark, window), "item-hits")
    rows = docs.select(
        "doc_id", text_key(F.col("text")).alias("text_key"), inner_size(_words("text")).alias("n_words")
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.join(hits, same_row(rows, hits), "left").select(
        rows["doc_id"],
        rows["text_key"],
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        is_contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    hits = write_once(contamination(docs, benchmark, window), "item-hits")
    # In a struct, since the columns of ``docs`` can have any name.
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").alias("_id"),
        text_key(F.col("text")).alias("_key"),
    )
    same = rows["_id"].eqNullSafe(hits["doc_id"]) & (rows["_key"] == hits["text_key"])
    # Only rows with hits count their words, and only those can go.
    n_words = inner_size(F.split(F.coalesce(F.col("row.text"), F.lit("")), SEPARATORS))
    bad = F.when(F.col("n_hit").isNull(), F.lit(False)).otherwise(is_contaminated(F.col("n_hit"), n_words))
    return rows.join(hits, same, "left").where(~bad).select("row.*")
