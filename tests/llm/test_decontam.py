import random
import re

from agorametrics.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        ws, hit, found = words(text), set(), set()
        for item_id, item in items:
            iw = words(item)
            if not iw:
                continue
            n = min(13, len(iw))
            for s in range(len(iw) - n + 1):
                for at in range(len(ws) - n + 1):
                    if ws[at : at + n] == iw[s : s + n]:
                        hit |= set(range(at, at + n))
                        if item_id is not None:
                            found.add(str(item_id))
        bad = bool(hit) and 20 * len(hit) >= len(ws)
        out.append((doc_id, len(ws), len(hit), sorted(found), bad))
    return sorted(out, key=str)


def collected(df):
    rows = df.select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    return sorted((tuple(r) for r in rows), key=str)


def cases():
    rng = random.Random(11)
    vocabulary = ["Ab", "cé", "É", "d", "e9", "straße"]
    text = lambda n: rng.choice(["", " ", "-"]) + " ".join(rng.choice(vocabulary) for _ in range(n)) + rng.choice(["", ".", "\n"])
    items = [(i, text(rng.randrange(1, 18))) for i in range(6)] + [(7, None), (8, "..."), (None, "Ab d"), (9, "only once"), (1, "second Row")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(40)]
    docs += [(100 + i, f"{text(8)} {items[i][1]}, {text(5)}") for i in range(6)]
    docs += [(200, None), (201, ""), (202, " - "), (None, "x only ONCE"), (203, "x only ONCE"), (203, "x only ONCE"), (203, "other")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert collected(decontam.judged(df, bench)) == brute(docs, items)
    kept = decontam.decontaminated(df, bench).collect()
    assert sorted(map(str, (r["doc_id"] for r in kept))) == sorted(str(r[0]) for r in brute(docs, items) if not r[4])


def test_in_several_parts(spark, monkeypatch):
    """A benchmark beyond the broadcast bound goes in parts, with the same result."""
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 300)
    docs, items = cases()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert collected(decontam.judged(df, bench)) == brute(docs, items)


def test_plan_has_no_python_and_verifies_in_the_row(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    plan = decontam.occurrences(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hash" not in plan and "Python" not in plan


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "no id but words"), (2, None)], "item_id long, text string")
    rows = decontam.judged(odd, bench).collect()
    assert len(rows) == odd.count() and sum(r["contaminated"] for r in rows) == 2
    kept = decontam.decontaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert decontam.judged(empty, bench).count() == 0
    assert decontam.judged(odd, bench.limit(0)).where("n_hit > 0").count() == 0
