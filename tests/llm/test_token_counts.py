import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from agorametrics.llm import queries
from agorametrics.llm.token_counts import Counts, token_counts

PATH = public_tokenizers.path(queries.TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def size(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_query_against_library(spark, sf, texts, library):
    rows = queries.op8_token_counts(spark, sf).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {k: size(library, t) for k, t in texts.items()}
    for r in rows:
        assert r["n_bytes"] == len(texts[r["doc_id"]].encode()) and r["over_limit"] == (r["n_tokens"] > 2048)


def test_random_characters(library):
    rng = random.Random(4)
    counts = Counts(PATH, {"the": 1})
    plain = [chr(c) for c in range(256)]
    odd = ["<|endoftext|>", "<|", "<|STARTOFTEXT|>", "ı", "İ", "Σ", "ς", "é", "漢字", "١", " ", "😀", "'s", "'LL", "'", "_", "ﬁ", "퟿"]
    texts = plain + [f"a{c}b {c}{c} 1{c}" for c in plain] + odd
    texts += ["".join(rng.choice(plain) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(rng.choice(plain + odd) for _ in range(rng.randrange(40))) for _ in range(500)]
    for text, n in zip(texts, counts.count(texts), strict=True):
        assert n == size(library, text), repr(text)


def test_odd_rows(odd, empty, library):
    rows = token_counts(odd, PATH).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(size(library, r["text"]) for r in odd.collect())
    assert token_counts(empty, PATH).count() == 0
