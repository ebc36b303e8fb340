"""Quality rules whose cutoffs are certified on labelled holdouts.

A rule rejects a text whose measure lies above a cutoff. Labelled good texts of a stratum (a
language) are dealt into two halves by their id. The first half proposes sets of cutoffs, from
mild to strict, without the rules that catch next to nothing there. On the second half each set's
false rejections get an exact (Clopper-Pearson) upper bound, at a confidence shared by all sets
and strata (Bonferroni). Of the sets whose bound is within the limit, the one that separates the
first half best is taken, the mildest of equals.
A stratum where no set can be certified has no rules.

Defined cases: null and empty texts have no words, fail the base rule and are rejected; a null
lang is a stratum; label rows that repeat a doc_id count once, bad if any says so; documents that
repeat a doc_id are each judged by their text; empty tables give no rows or no rules.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorametrics.llm.common import BROADCAST_BYTES, row_struct
from agorametrics.plans.tables import write_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_WORDS = 10
MOST_REPEATED = 20  # percent
WINDOW = 5
SYMBOLS = "#*$%&|<>"

# Measures of the rules; each is higher for worse texts.
RULES = ("symbols", "shouting", "exclaims", "repeats", "same_lines", "long_words")
# Shares of good texts that a set of cutoffs may reject in the first half; 0 is the largest value
# seen and a margin.
SETS = (0.0, 0.0005, 0.001, 0.0025, 0.005)
MARGIN = 1.05
MOST_FALSE = 0.01
CONFIDENCE = 0.95
# A false rejection costs as much as so many bad texts that stay.
FALSE_COST = 20
# A rule that catches fewer bad texts of the first half than this is left out of a set.
LEAST_CAUGHT = 5

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_exclaims long"


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five that occur twice or more."""
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    end = total = 0
    for at, w in enumerate(windows):
        if w in twice:
            total += at + WINDOW - max(end, at)
            end = at + WINDOW
    return total


def measured(text: str) -> tuple[int, ...]:
    """The counts of one text; words are cut at ASCII white space only, as bytes are."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    blanks = sum(map(raw.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")))
    lines = [line for line in raw.split(b"\n") if not line.isspace() and line]
    return (
        len(words),
        len(text) - blanks,
        sum(raw.count(c.encode()) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        sum(1 for w in text.split() if len(w) > 1 and w.isupper()),
        raw.count(b"!"),
    )


def counts(text: Column) -> Column:
    """The counts of each text as a struct; null counts as empty."""
    names = [c.split()[0] for c in COUNTS.split(", ")]

    @F.pandas_udf(COUNTS)
    def each(texts: pd.Series) -> pd.DataFrame:
        rows = [measured(t) for t in texts]
        return pd.DataFrame(np.array(rows, dtype=np.int64).reshape(-1, len(names)), columns=names)

    return each(F.coalesce(text, F.lit("")))


def base_failed(c: Column) -> Column:
    return (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])


def measures(c: Column) -> Column:
    words = F.greatest(c["n_words"], F.lit(1))
    named = {
        "symbols": c["n_symbols"] / words,
        "shouting": c["n_upper"] / words,
        "exclaims": c["n_exclaims"] / words,
        "repeats": c["n_repeat_words"] / words,
        "same_lines": c["n_dup_lines"] / words,
        "long_words": c["word_chars"] / words,
    }
    return F.struct(*(named[r].alias(r) for r in RULES))


def upper_bound(k: int, n: int, risk: float) -> float:
    """The Clopper-Pearson upper bound of a rate after ``k`` of ``n``, wrong with chance ``risk``."""
    if n == 0 or k >= n:
        return 1.0
    i = np.arange(k + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i])
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        at_most = np.exp(logs + i * math.log(p) + (n - i) * math.log1p(-p)).sum() if p < 1 else 0.0
        low, high = (p, high) if at_most > risk else (low, p)
    return high


def _stratum(lang: Column) -> Column:
    return F.coalesce(lang, F.lit(""))


def _fails(measure: Column, cutoffs: Column) -> Column:
    out = F.lit(False)
    for rule in RULES:
        out = out | (measure[rule] > cutoffs[rule])
    return out


def _useful(known: DataFrame, sets: DataFrame) -> DataFrame:
    """``sets`` without the rules that catch too little in the first half to be worth a risk."""
    of = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    over = lambda r: F.col("measure")[r] > F.col("cutoffs")[r]
    seen = known.where("first").join(sets, "stratum").groupBy("stratum", "strict").agg(
        F.first("cutoffs").alias("cutoffs"),
        *(of(~F.col("good") & over(r)).alias(f"caught_{r}") for r in RULES),
        *(of(F.col("good") & over(r)).alias(f"false_{r}") for r in RULES),
    )

    def kept(rule: str) -> Column:
        caught, false = F.col(f"caught_{rule}"), F.col(f"false_{rule}")
        worth = (caught >= LEAST_CAUGHT) & (caught >= FALSE_COST * false)
        return F.when(worth, F.col("cutoffs")[rule]).otherwise(F.lit(float("inf"))).alias(rule)

    return seen.select("stratum", "strict", F.struct(*map(kept, RULES)).alias("cutoffs"))


def certified_cutoffs(judged: DataFrame, labels: DataFrame, most_false: float = MOST_FALSE, confidence: float = CONFIDENCE) -> DataFrame:
    """(stratum, cutoffs, bound) of the strata with a certified set.

    ``judged`` has (doc_id, stratum, failed, measure); texts that fail the base rule teach nothing.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(
        (F.min("quality") == 1).alias("good")
    )
    known = judged.where("not failed").join(known, "doc_id")
    half = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    known = write_once(known.select("stratum", "measure", "good", half.alias("first")), "quality-labels")
    proposals = []
    of_rule = lambda rule: F.when(F.col("good") & F.col("first"), F.col("measure")[rule])
    grouped = known.groupBy("stratum").agg(
        *(F.max(of_rule(r)).alias(f"max_{r}") for r in RULES),
        *(
            F.percentile_approx(of_rule(r), [1 - s for s in SETS[1:]], 100_000).alias(f"cut_{r}")
            for r in RULES
        ),
    )
    for k in range(len(SETS)):
        cut = (
            (lambda r: F.col(f"max_{r}") * MARGIN)
            if k == 0
            else (lambda r, k=k: F.get(f"cut_{r}", F.lit(k - 1)))
        )
        proposals.append(F.struct(F.lit(k).alias("strict"), F.struct(*(cut(r).alias(r) for r in RULES)).alias("cutoffs")))
    sets = write_once(grouped.select("stratum", F.inline(F.array(*proposals))), "quality-sets")
    sets = write_once(_useful(known, sets), "quality-sets")
    # A stratum has a few sets, so this stays small; Spark picks the join by its written size.
    tried = known.join(sets, "stratum").withColumn("hit", _fails(F.col("measure"), F.col("cutoffs")))
    of = lambda c: F.sum(c.cast("long"))
    tried = tried.groupBy("stratum", "strict").agg(
        of(F.col("good") & ~F.col("first") & F.col("hit")).alias("k"),
        of(F.col("good") & ~F.col("first")).alias("n"),
        of(F.col("good") & F.col("first") & F.col("hit")).alias("false"),
        of(~F.col("good") & F.col("first") & F.col("hit")).alias("caught"),
    )
    tests = max(1, tried.count())
    risk = (1 - confidence) / tests

    @F.pandas_udf("double")
    def bound(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([upper_bound(int(a), int(b), risk) for a, b in zip(k, n, strict=True)], dtype="float64")

    safe = tried.withColumn("bound", bound("k", "n")).where(F.col("bound") <= most_false)
    gain = F.col("caught") - FALSE_COST * F.col("false")
    best = safe.groupBy("stratum").agg(F.max(F.struct(gain, -F.col("strict"), "strict", "bound")).alias("best"))
    best = best.select("stratum", "best.strict", "best.bound")
    return write_once(best.join(sets, ["stratum", "strict"]).select("stratum", "cutoffs", "bound"), "quality-cutoffs")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, ..., base_failed, kept) per row of ``docs``."""
    rows = docs.select("doc_id", _stratum(F.col("lang")).alias("stratum"), counts(F.col("text")).alias("counts"))
    rows = write_once(rows, "quality-counts")
    known = rows.select(
        "doc_id", "stratum", "counts", base_failed(F.col("counts")).alias("failed"), measures(F.col("counts")).alias("measure")
    )
    cutoffs = certified_cutoffs(known, labels)
    fails = F.coalesce(_fails(F.col("measure"), F.col("cutoffs")), F.lit(False))
    return known.join(cutoffs, "stratum", "left").select(
        "doc_id",
        *(F.col("counts")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        F.col("failed").alias("base_failed"),
        (~F.col("failed") & ~fails).alias("kept"),
    )


def _measured(counted: DataFrame) -> DataFrame:
    """(doc_id, stratum, failed, measure) from (doc_id, stratum, counts)."""
    c = F.col("counts")
    return counted.select("doc_id", "stratum", base_failed(c).alias("failed"), measures(c).alias("measure"))


def passed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Only labelled texts are counted for the cutoffs; then each text once, where it is filtered.
    """
    ids = labels.where("quality is not null and doc_id is not null").select("doc_id").distinct()
    ids = write_once(ids, "quality-labelled")
    small = 16 * ids.count() <= BROADCAST_BYTES
    seen = docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
    seen = seen.select("doc_id", _stratum(F.col("lang")).alias("stratum"), counts(F.col("text")).alias("counts"))
    cutoffs = certified_cutoffs(write_once(_measured(seen), "quality-counts"), labels)
    row = F.col("row")
    rows = row_struct(docs).withColumn("stratum", _stratum(row["lang"])).join(cutoffs, "stratum", "left")
    # One condition, so that the texts are counted once.
    c = counts(row["text"])
    fails = base_failed(c) | F.coalesce(_fails(measures(c), F.col("cutoffs")), F.lit(False))
    return rows.where(~fails).select("row.*")
