from agorametrics.llm.line_dedup import dedup_lines


def brute(docs):
    """docs: [(doc_id, text)] in order of doc_id."""
    seen, out = set(), {}
    for doc_id, text in docs:
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if not "".join(window).strip(" "):
                continue
            if window in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(window)
        out[doc_id] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return out


def test_against_brute_force(spark):
    import random

    rng = random.Random(3)
    docs = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randrange(12)))) for i in range(60)]
    docs += [(100, "\n".join("a" * 40)), (101, "x\n\n\n\n\n\ny"), (102, "x\n\n\n\n\n\ny")]
    found = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in found} == brute(docs)


def test_every_line_survives_somewhere(spark, texts, sf):
    found = dedup_lines(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    before = {line for t in texts.values() for line in t.split("\n")}
    assert before - {""} == {line for r in found for line in r["text"].split("\n")} - {""}


def test_odd_rows(odd, empty, long_text):
    rows = dedup_lines(odd).collect()
    assert len(rows) == odd.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append((r["text"], r["n_removed"]))
    assert by_id[1] == [("one two three four five\nsix seven eight\nnine ten eleven", 0)] * 2
    assert by_id[2] == [("", 0)] and by_id[3] == [(None, 0)]
    assert by_id[5] == [(long_text, 0)] and by_id[6] == [("", 8000)]
    assert dedup_lines(empty).count() == 0
