"""Toxicity by a grammar of weighted finite-state transducers.

A clause is read word by word. The lexical transducer turns a word into a tag with a weight
(insult, threat, target, negation, report). Three more are composed behind it: negation turns an
attack within a few words after a negation into "negated", reported speech turns one after a
reporting verb into "reported", target turns one after an addressed person into "aimed". What
comes out, summed by tag over all clauses, is the only input of a score.

Insult words come from a short list and from labels: word beginnings that stand in significantly
more toxic than clean texts. The weight of each tag is fitted by logistic regression on a bounded
sample of labelled rows; insults, threats and aimed attacks never lower a score, and a tag that no
sampled text has keeps its fixed weight, on the scale of the fitted insults. The score never sees
labels, lang, source or doc_id.

Defined cases: null and empty texts have no clause and get the score of a text without attacks;
without labels of both classes the fixed weights below hold; equal texts score alike.
"""

from __future__ import annotations

import math
import re
import sys
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametrics.plans.tables import write_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What the grammar knows beforehand. Negations and reports are frequent function words.
INSULTS = {"idiot": 2.0, "moron": 2.0, "stupid": 1.5, "loser": 1.5, "scum": 2.0, "pathetic": 1.5}
THREATS = {"kill you": 3.0, "hurt you": 2.5, "destroy you": 2.0, "you will die": 2.0}
TARGETS = frozenset("you your he she they them this these du dich ihr sie tu vous te usted ustedes".split())
NEGATIONS = frozenset("not never isn't aren't wasn't nicht kein nie pas jamais nunca".split())
REPORTS = frozenset("said says called wrote quoted sagte schrieb dit écrit dijo escribió".split())
NEGATION_REACH = 3

TAGS = ("insult", "threat", "aimed", "negated", "reported")
# Tags whose weight is never below zero.
ATTACKS = ("insult", "threat", "aimed")
# Used as they are only where there is nothing to learn from.
FIXED_WEIGHTS = (-3.0, (2.0, 2.5, 3.0, -0.5, 0.2))

# Bounds of the sample that the lexicon and the weights are learned from.
MAX_TOXIC = 4000
MAX_CLEAN = 8000
STEM_LENGTHS = range(3, 9)
# A stem needs this precision, and a one-sided chance, over all candidates, below MAX_CHANCE.
MIN_PRECISION = 0.9
MAX_CHANCE = 0.05
MAX_STEMS = 5000
MAX_WEIGHT = 6.0

CLAUSE_ENDS = re.compile(r"[.!?;:\n]+")
TOKENS = re.compile(r"[\w']+")


@dataclass(frozen=True)
class Transducer:
    """Reads tags and writes tags; where no arc fits, a tag passes and the state falls back."""

    arcs: dict[tuple[int, str], tuple[int, str]] = field(default_factory=dict)
    falls: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, tag: str) -> tuple[int, str]:
        return self.arcs.get((state, tag)) or (self.falls.get(state, state), tag)


def negation(reach: int = NEGATION_REACH) -> Transducer:
    """States count down the words that a negation still reaches."""
    arcs = {(s, "negation"): (reach, "other") for s in range(reach + 1)}
    for state in range(1, reach + 1):
        arcs |= {(state, tag): (state - 1, "negated") for tag in ("insult", "threat")}
    return Transducer(arcs, {s: s - 1 for s in range(1, reach + 1)})


def reported_speech() -> Transducer:
    arcs = {(s, "report"): (1, "other") for s in (0, 1)}
    return Transducer(arcs | {(1, tag): (1, "reported") for tag in ("insult", "threat", "negated")})


def target() -> Transducer:
    arcs = {(s, "target"): (1, "other") for s in (0, 1)}
    return Transducer(arcs | {(1, tag): (1, "aimed") for tag in ("insult", "threat")})


class Grammar:
    """The lexical transducer and those composed behind it."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.lengths = sorted({len(s) for s in stems})
        self.chain = (negation(), reported_speech(), target())
        threats = "|".join(re.escape(t) for t in sorted(THREATS, key=len, reverse=True))
        starts = "|".join(re.escape(s) for s in sorted(stems, key=len, reverse=True))
        self.threat = re.compile(rf"\b(?:{threats})\b")
        self.attack = re.compile(rf"\b(?:{threats})\b|\b(?:{starts})" if starts else self.threat.pattern)

    def lexical(self, word: str) -> tuple[str, float]:
        if word in NEGATIONS:
            return "negation", 0.0
        if word in REPORTS:
            return "report", 0.0
        for n in self.lengths:
            if (weight := self.stems.get(word[:n])) is not None and len(word) >= n:
                return "insult", weight
        return ("target" if word in TARGETS else "other"), 0.0

    def clause(self, text: str) -> list[tuple[str, float]]:
        """(tag, weight) of each attack in a clause in lower case."""
        at = {m.start(): THREATS[m.group()] for m in self.threat.finditer(text)}
        states, out = [0] * len(self.chain), []
        for word in TOKENS.finditer(text):
            tag, weight = ("threat", at[word.start()]) if word.start() in at else self.lexical(word.group())
            for k, machine in enumerate(self.chain):
                states[k], tag = machine.step(states[k], tag)
            if tag in TAGS:
                out.append((tag, weight))
        return out

    def features(self, text: str) -> list[float]:
        """Summed weight for each tag, damped so that long texts don't gain by length alone."""
        sums = dict.fromkeys(TAGS, 0.0)
        text = text.lower()
        if self.attack.search(text):
            for clause in CLAUSE_ENDS.split(text):
                if self.attack.search(clause):
                    for tag, weight in self.clause(clause):
                        sums[tag] += weight
        return [math.log1p(sums[tag]) for tag in TAGS]


def features(docs: DataFrame, stems: dict[str, float]) -> DataFrame:
    """(doc_id, features) per row of ``docs``."""

    @F.pandas_udf("array<double>")
    def each(texts: pd.Series) -> pd.Series:
        grammar = Grammar(stems)
        return texts.map(grammar.features)

    return docs.select("doc_id", each(F.coalesce("text", F.lit(""))).alias("features"))


def sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    """(text, toxic) of a bounded, hash-ordered sample of the labelled rows."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")
    )
    order = F.xxhash64(F.lit("sample"), "doc_id")
    parts = [
        known.where(F.col("toxic") == value).orderBy(order, "doc_id").limit(most)
        for value, most in ((1, max_toxic), (0, max_clean))
    ]
    chosen = write_once(parts[0].unionByName(parts[1]), "toxic-ids")
    # Bounded by the two parameters.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return write_once(rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic"), "toxic-sample")


def learned_stems(train: DataFrame) -> dict[str, float]:
    """Word beginnings, and words, that tell toxic from clean texts, with their log odds."""
    totals = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return dict(INSULTS)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0)))
    each = train.select("doc_id", "toxic", F.explode(words).alias("word"))
    sizes = F.array(*(F.lit(n) for n in STEM_LENGTHS))
    stems = F.array_union(
        F.array("word"),
        F.transform(
            F.filter(sizes, lambda n: n < F.length("word")), lambda n: F.substring("word", F.lit(1), n)
        ),
    )
    stems = F.filter(stems, lambda s: F.length(s) >= STEM_LENGTHS[0])
    each = each.select("doc_id", "toxic", F.explode(stems).alias("stem")).distinct()
    counts = each.groupBy("stem").agg(
        F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")
    )
    counts = counts.where(F.col("toxic") >= 2)
    counts = write_once(counts, "toxic-stems")
    candidates = max(1, counts.count())
    # With no clean text having the stem, the chance that all of n texts are toxic is base^n; some
    # clean ones add the ways to place them.
    base = toxic / (toxic + clean)
    n = F.col("toxic") + F.col("clean")
    chance = F.col("toxic") * math.log(base) + F.col("clean") * F.log(n + 1)
    good = (F.col("toxic") / n >= MIN_PRECISION) & (chance < math.log(MAX_CHANCE / candidates))
    odds = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5) * (clean + 1) / (toxic + 1))
    best = counts.where(good).select("stem", F.least(odds, F.lit(MAX_WEIGHT)).alias("weight"), chance.alias("chance"))
    rows = best.orderBy("chance", "stem").limit(MAX_STEMS).collect()
    found = {r["stem"]: r["weight"] for r in rows}
    # A stem that begins with another found one adds nothing.
    shortest = {
        s: w for s, w in found.items() if not any(s[:n] in found for n in STEM_LENGTHS if n < len(s))
    }
    refuted = {r["stem"] for r in counts.where(F.col("stem").isin(*INSULTS) & (F.col("clean") > F.col("toxic"))).collect()}
    return {s: w for s, w in INSULTS.items() if s not in refuted} | shortest


@dataclass(frozen=True)
class Model:
    stems: dict[str, float]
    intercept: float
    weights: tuple[float, ...]


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Learns from ``labels`` (doc_id, toxic); leave out of it what is held out."""
    train = sample(docs, labels, max_toxic, max_clean)
    stems = learned_stems(train)
    if train.select("toxic").distinct().count() < 2:
        return Model(stems, *FIXED_WEIGHTS)
    rows = features(train.select(F.struct("doc_id", "toxic").alias("doc_id"), "text"), stems)
    rows = rows.select(
        F.col("doc_id.toxic").cast("double").alias("label"), array_to_vector("features").alias("features")
    )
    rows = write_once(rows, "toxic-features")
    # Finite, since Spark scales the bounds by deviations, which are zero for an unseen tag.
    least = [0.0 if tag in ATTACKS else -100.0 for tag in TAGS]
    found = LogisticRegression(
        family="binomial",
        regParam=1e-4,
        standardization=False,
        maxIter=200,
        lowerBoundsOnCoefficients=DenseMatrix(1, len(TAGS), least),
    ).fit(rows)
    values = vector_to_array("features")
    seen = rows.agg(*(F.max(F.get(values, F.lit(k)) > 0).alias(tag) for k, tag in enumerate(TAGS))).first()
    fixed = FIXED_WEIGHTS[1]
    scale = max(1.0, float(found.coefficients[0]) / fixed[0])
    weights = (float(w) if seen[tag] else f * scale for tag, w, f in zip(TAGS, found.coefficients, fixed, strict=True))
    return Model(stems, float(found.intercept), tuple(weights))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_tags) per row of ``docs``."""
    stems, intercept, weights = model.stems, model.intercept, np.array(model.weights)

    @F.pandas_udf("double")
    def each(texts: pd.Series) -> pd.Series:
        grammar = Grammar(stems)
        if not len(texts):
            return pd.Series([], dtype="float64")
        values = np.array([grammar.features(t) for t in texts])
        return pd.Series(1.0 / (1.0 + np.exp(-np.clip(intercept + values @ weights, -30, 30))))

    return docs.select("doc_id", each(F.coalesce("text", F.lit(""))).alias("score"))
