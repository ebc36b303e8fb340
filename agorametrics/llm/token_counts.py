"""Token counts by a two-tier lookup of pre-token lengths, map-side only.

A tokenizer encodes each pre-token by itself, so a text's count is the sum over its pre-tokens.
Tier one is a broadcast table of frequent pre-tokens and their lengths, made from a bounded
sample of texts; it only saves work. Tier two is a cache in each worker, filled by encoding what
the table lacks with the library. Nothing is shuffled. Where a text could be normalised or cut
otherwise than by the pattern here (characters beyond Latin, special strings), the library
encodes the whole text.

Defined cases: null counts as empty, with no tokens; any text length is counted whole.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Pre-tokens of lower-cased text, as the tokenizer file states them. Fixed value. Over ASCII and
# the Latin letters below, [^\W\d_] is \p{L} and [0-9] with the superscripts and fractions \p{N}.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W0-9_²³¹¼½¾]+|[0-9²³¹¼½¾]|[^\sa-zß-öø-ÿªµº0-9²³¹¼½¾]+"
# Texts of these characters are cut by the pattern above: ASCII without control characters other
# than white space, and Latin-1 from the no-break space on. All are in composed form.
PLAIN = r"[\t\n\r\x20-\x7e\xa0-\xff]*"
SPECIAL = "<|"
SAMPLE_TEXTS = 1000
SAMPLE_BYTES = 1 << 14
TABLE_SIZE = 50_000
CACHE_SIZE = 200_000
# Texts that are cut and looked up together, and pieces that are encoded together.
GROUP = 100
PIECES = 2000
LIMIT = 2048


class Counts:
    """Counts tokens of texts in one worker."""

    def __init__(self, path: str, table: dict[str, int]):
        # One thread: Spark's tasks use the cores, and each thread would keep memory of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.table, self.cache = table, {}
        self.pieces = re.compile(PRE_TOKEN).findall
        self.plain = re.compile(PLAIN).fullmatch

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def pre_tokens(self, text: str) -> list[str] | None:
        """None if the text has to be encoded as a whole."""
        if SPECIAL in text or not self.plain(text):
            return None
        return self.pieces(text.lower())

    def learn(self, texts: list[list[str] | None]) -> None:
        """Encodes what neither tier knows of a batch, each piece once."""
        if len(self.cache) > CACHE_SIZE:
            self.cache.clear()
        new = set()
        for pieces in texts:
            if pieces:
                new.update(pieces)
        new = [p for p in new if p not in self.table and p not in self.cache]
        for at in range(0, len(new), PIECES):
            part = new[at : at + PIECES]
            got = self.tokenizer.encode_batch(part, add_special_tokens=False)
            self.cache.update((p, len(e.ids)) for p, e in zip(part, got, strict=True))

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.pre_tokens(t) for t in texts]
        self.learn(cut)
        table, cache = self.table, self.cache
        out = []
        for text, pieces in zip(texts, cut, strict=True):
            if pieces is None:
                out.append(self.whole(text))
            else:
                out.append(sum(n if (n := table.get(p)) is not None else cache[p] for p in pieces))
        return out


def frequent_lengths(docs: DataFrame, path: str, texts: int = SAMPLE_TEXTS, size: int = TABLE_SIZE) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of at most ``texts`` texts of a bounded size.

    They are read from the first partitions that have them and counted on the driver: at most
    ``texts * SAMPLE_BYTES`` bytes.
    """
    some = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select("text").take(texts)
    counts, seen = Counts(path, {}), Counter()
    for row in some:
        seen.update(counts.pre_tokens(row["text"]) or ())
    top = [p for p, _ in seen.most_common(size)]
    counts.learn([top])
    return {p: counts.cache[p] for p in top}


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))

    @F.pandas_udf("long")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = Counts(path, table.value)
        for texts in batches:
            # In small groups, so that the lists of pieces stay small.
            values = texts.tolist()
            parts = (counts.count(values[at : at + GROUP]) for at in range(0, len(values), GROUP))
            yield pd.Series([n for part in parts for n in part], dtype="int64")

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), each("text").alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
