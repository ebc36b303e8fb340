import zlib

import pytest

from agorametrics.llm import queries, toxicity
from agorametrics.llm.toxicity import Grammar


@pytest.fixture(scope="module")
def grammar():
    return Grammar({"idiot": 2.0, "lowei": 3.0})


def test_clauses(grammar):
    tags = lambda text: [t for t, _ in grammar.clause(text)]
    assert tags("what an idiot") == ["insult"]
    assert tags("you are an idiot") == ["aimed"]
    assert tags("you are not an idiot") == ["negated"]
    assert tags("not one of all the words is idiot") == ["insult"]
    assert tags("he said you are an idiot") == ["reported"]
    assert tags("he said you are not an idiot") == ["reported"]
    assert tags("i will kill you") == ["threat"]
    assert tags("loweischaft und anidiot") == ["insult"]


def test_features_are_by_clause(grammar):
    together = grammar.features("you idiot. lowei")
    assert together[toxicity.TAGS.index("aimed")] > 0 and together[toxicity.TAGS.index("insult")] > 0
    assert grammar.features("") == [0.0] * 5 and grammar.features("never mind you") == [0.0] * 5


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    found = {r["doc_id"]: r for r in queries.op2_toxicity(spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = [r for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(found[r["doc_id"]]["held_out"] for r in held)
    right = sum(found[r["doc_id"]]["predicted"] == r["toxic"] for r in held)
    toxic = [found[r["doc_id"]]["predicted"] for r in held if r["toxic"]]
    assert right / len(held) > 0.97 and sum(toxic) / len(toxic) > 0.85


def test_attacks_never_lower_a_score(spark):
    insults = [(k, f"you are an idiot number {k}", 1) for k in range(30)]
    # German articles are no threats, and clean texts with a threat don't turn it around.
    clean = [(100 + k, f"die Katze und die Maus {k}" + " i could kill you" * (k % 2), 0) for k in range(60)]
    rows = spark.createDataFrame(insults + clean, "doc_id long, text string, toxic int")
    model = toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    weights = dict(zip(toxicity.TAGS, model.weights, strict=True))
    assert all(weights[tag] >= 0 for tag in toxicity.ATTACKS) and weights["reported"] > 0
    texts = spark.createDataFrame([(1, "die Katze"), (2, "you idiot"), (3, "i could kill you")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(texts, model).collect()}
    assert score[2] >= 0.5 > score[1] and score[3] >= score[1]


def test_unseen_tags_keep_their_weight(spark):
    rows = [(k, "you are an idiot" if k % 2 else f"nothing but words {k}", k % 2) for k in range(60)]
    rows = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    weights = dict(zip(toxicity.TAGS, model.weights, strict=True))
    assert weights["threat"] >= toxicity.FIXED_WEIGHTS[1][1] and weights["negated"] < 0


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    for docs, known in ((odd, labels), (odd, labels.limit(0)), (empty, labels)):
        model = toxicity.fit(docs, known)
        rows = toxicity.scored(docs, model).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
