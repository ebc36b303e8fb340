import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from agorametrics.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), failed)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_query_against_brute_force(spark, sf, texts):
    rows = queries.op9_quality_rules(spark, sf).collect()
    assert {r["doc_id"]: tuple(r[c] for c in NAMES) for r in rows} == {k: brute(t) for k, t in texts.items()}
    assert not any(r["kept"] for r in rows if r["base_failed"])


def test_random_texts():
    rng = random.Random(9)
    for _ in range(500):
        text = "".join(rng.choice(["a ", "b ", "c\n", "\x0b", "\x1c", " ", "é#", "!", "\r", "|"]) for _ in range(rng.randrange(60)))
        assert quality.measured(text)[:5] == brute(text)[:5]


def test_upper_bound_is_exact():
    for k, n, risk in ((0, 50, 0.05), (3, 40, 0.01), (10, 10_000, 0.001)):
        p = quality.upper_bound(k, n, risk)
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(tail - risk) < 1e-6
    assert quality.upper_bound(5, 5, 0.05) == 1.0 and quality.upper_bound(0, 0, 0.05) == 1.0


def test_cutoffs_are_certified_and_keep_good_texts(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(6000):
        bad = i % 6 == 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(20)]
        rows.append((i, " ".join(w + "###" * bad for w in words), "few" if i % 100 == 1 else "en"))
        labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    found = {r["doc_id"]: r["kept"] for r in quality.judged(docs, known).collect()}
    good = [found[i] for i, q in labels if q == 1]
    assert sum(good) / len(good) > 0.99
    assert not any(found[i] for i, q in labels if q == 0 and i % 100 != 1)
    counts = docs.select("doc_id", F.col("lang").alias("stratum"), quality.counts(F.col("text")).alias("c"))
    judged = counts.select("doc_id", "stratum", quality.base_failed(F.col("c")).alias("failed"), quality.measures(F.col("c")).alias("measure"))
    cut = quality.certified_cutoffs(judged, known).collect()
    assert [r["stratum"] for r in cut] == ["en"] and cut[0]["bound"] <= quality.MOST_FALSE
    passed = quality.passed(docs, known)
    assert passed.columns == docs.columns
    assert {r["doc_id"] for r in passed.collect()} == {i for i, kept in found.items() if kept}


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, None)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        rows = quality.judged(odd, known).collect()
        texts = [r["text"] for r in odd.collect()]
        assert sorted(tuple(r[c] for c in NAMES) for r in rows) == sorted(map(brute, texts))
        passed = quality.passed(odd, known)
        assert passed.columns == odd.columns and passed.count() == sum(r["kept"] for r in rows)
    assert quality.judged(empty, labels).count() == 0 and quality.passed(empty, labels).count() == 0
