"""Line dedup: three-line windows that occur again are removed where they occur again.

Every window of three consecutive lines is hashed to 128 bits. Of the windows with equal
hashes, the one with the smallest (doc_id, text key, line) stays; the lines that any other one
covers are merged into ranges and cut out. A line can only go where an equal line stands
earlier, so every different line survives somewhere.

Defined cases: null text stays null; texts of fewer than three lines have no window and stay;
windows of three blank lines don't count; null doc_ids order last; rows that agree in doc_id
and text are one row to this operator and get the same result; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorametrics.llm.common import same_row, text_key
from agorametrics.plans.tables import write_once

WINDOW = 3


def _windows(lines: Column) -> Column:
    def window(i: Column) -> Column:
        parts = [F.get(lines, i + k) for k in range(WINDOW)]
        return F.struct(
            i.alias("line"),
            F.xxhash64(*parts).alias("h1"),
            F.xxhash64(F.lit("second"), *parts).alias("h2"),
            F.trim(F.concat(*parts)).alias("content"),
        )

    last = F.size(lines) - WINDOW
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), window))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line) of every window that repeats an earlier one."""
    lines = F.split("text", "\n")
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), lines.alias("lines"))
    every = keyed.select("doc_id", "text_key", F.inline(_windows(F.col("lines"))))
    every = write_once(every.where("content != ''").drop("content"), "line-windows")
    place = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_key", "line")
    seen = every.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(place).alias("first"))
    # Written, so that the join below shuffles both sides and a hot window can be split.
    seen = write_once(seen.where("times > 1").select("h1", "h2", "first"), "line-repeats")
    first = F.col("first")
    is_first = (
        F.col("doc_id").eqNullSafe(first["doc_id"])
        & (F.col("text_key") == first["text_key"])
        & (F.col("line") == first["line"])
    )
    return every.join(seen, ["h1", "h2"]).where(~is_first).select("doc_id", "text_key", "line")


def _kept_lines(lines: Column, starts: Column) -> Column:
    """``lines`` without the ranges [s, s + 3) of the sorted ``starts``."""
    last = F.size(starts) - 1
    begins = F.filter(starts, lambda s, i: (i == 0) | (F.get(starts, i - 1) + WINDOW < s))
    ends = F.filter(starts, lambda s, i: (i == last) | (s + WINDOW < F.get(starts, i + 1)))
    gaps = F.arrays_zip(
        F.concat(F.array(F.lit(0)), F.transform(ends, lambda e: e + WINDOW)).alias("a"),
        F.concat(begins, F.array(F.size(lines))).alias("b"),
    )
    return F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["a"] + 1, g["b"] - g["a"])))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) per row of ``docs``."""
    removed = (
        repeated_windows(docs)
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_set("line")).alias("starts"))
    )
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    found = keyed.join(removed, same_row(keyed, removed), "left").select(
        keyed["doc_id"], "text", "starts", F.split("text", "\n").alias("lines")
    )
    cut = F.col("starts").isNotNull()
    kept = F.when(cut, _kept_lines(F.col("lines"), F.col("starts")))
    return found.withColumn("kept", kept).select(
        "doc_id",
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.when(cut, F.size("lines") - F.size("kept")).otherwise(0).cast("long").alias("n_removed"),
        F.when(cut, F.array_join("kept", "\n")).otherwise(F.col("text")).alias("text"),
    )
