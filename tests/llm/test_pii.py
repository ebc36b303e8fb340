import hashlib
import random
import re

from agorametrics.llm import pii, queries

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return {
        k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if holds(k, m.group())]
        for k, p in BASE.items()
    }


def near(text, start, end):
    return text[max(start - 40, 0) : max(start - 40, 0) + end - start + 80].lower()


def iban_at(text, start):
    """The end of an iban that begins here, or None."""
    for size, codes in pii.IBAN_LENGTHS.items():
        if text[start : start + 2] in codes.split() and re.match("[0-9]{2}", text[start + 2 : start + 4]):
            end, left = start + 4, size - 4
            while left and (m := re.compile(" ?[A-Z0-9]").match(text, end)):
                end, left = m.end(), left - 1
            if not left and not re.match("[A-Za-z0-9]", text[end : end + 1]):
                return end
    return None


def brute_added(text):
    """Ibans and secrets, character by character."""
    text, found, at = text or "", {"iban": [], "secret": []}, 0
    while at < len(text):
        end = None if at and re.match("[A-Za-z0-9]", text[at - 1]) else iban_at(text, at)
        if end:
            packed = text[at:end].replace(" ", "")
            number = "".join(str(int(c, 36)) for c in packed[4:] + packed[:4])
            around = near(text, at, end)
            against = re.search("serial|tracking|\\bsku\\b|licen[cs]e", around)
            backed = re.search("iban|account|bank|konto|compte|cuenta", around)
            if int(number) % 97 == 1 and (backed or not against):
                found["iban"].append(f"iban:{at}:{end}")
        at = end or at + 1
    for m in re.finditer("[A-Za-z0-9_+/-]+", text):
        run = m.group()
        enough = len(re.findall("[A-Za-z]", run)) >= 3 and len(re.findall("[0-9]", run)) >= 3
        around = near(text, m.start(), m.end())
        if 20 <= len(run) <= 512 and enough and re.search(pii.CONTEXT["secret"], around):
            if not re.search(pii.AGAINST["secret"], around):
                found["secret"].append(f"secret:{m.start()}:{m.end()}")
    return found


def compare(rows, texts):
    for r in rows:
        expected = brute(texts[r["doc_id"]])
        assert {k: r[f"n_{k}"] for k in BASE} == {k: len(v) for k, v in expected.items()}
        joined = ",".join(s for k in BASE for s in expected[k])
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        added = brute_added(texts[r["doc_id"]])
        assert {k: r[f"n_{k}"] for k in added} == {k: len(v) for k, v in added.items()}
        every = [s for found in (expected, added) for spans in found.values() for s in spans]
        assert r["spans"] == ",".join(every) and r["personal"] == bool(every)


def test_query_against_brute_force(spark, sf, texts):
    rows = queries.op7_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    compare(rows, texts)


def test_random_texts(spark, tmp_path):
    rng = random.Random(2)
    alphabet = ["a", "B", "@", ".", "-", "+", "1", "0", "5", "25", "255.", "256", " ", "(", ")", "_", "%", "é", "😀", "\n", "4111 1111 1111 1111", "a@b.c", "10.0.0.1", "+1 (2) 345-678-90"]
    texts = {i: "".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for i in range(1500)}
    texts |= {2000: None, 2001: "", 2002: "1" * 50_000, 2003: "a" * 50_000 + "@b", 2004: "x@" + "a." * 30_000 + "a", 2005: "1.1.1.1" * 300, 2006: "0001.2.3.4 00000000000000000000000000000001.2.3.4 99999999999999999999.1.1.1"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    compare(queries.op7_pii(spark, str(tmp_path)).collect(), texts)


def test_added_kinds_in_random_texts(spark, tmp_path):
    rng = random.Random(5)
    key = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"
    alphabet = ["token = ", "api key: ", '"', key, "é" * 30, " ", "commit ", "checksum ", "author ", "a/b-c_d+1", "\n", "A" * 19, "123", "x" * 500]
    alphabet += ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82WEST12345698765432", " EUR", " 00 BIC", "serial ", "bank ", "FR14", "NO93 8601 1117 947", "😀"]
    texts = {i: "".join(rng.choice(alphabet) for _ in range(rng.randrange(9))) for i in range(1500)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op7_pii(spark, str(tmp_path)).collect()
    compare(rows, texts)
    assert sum(r["n_iban"] for r in rows) > 100 and sum(r["n_secret"] for r in rows) > 100


def test_context_decides(spark):
    key = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"
    rows = [
        (1, f'token = "{key}" la'),
        (2, f"see {key} la"),
        (3, f"token of commit {key}"),
        (4, "pay DE89370400440532013000 EUR"),
        (5, "DE89 3704 0044 0532 0130 00 BIC"),
        (6, "serial DE89370400440532013000"),
        (7, "serial of the account DE89370400440532013000"),
        (8, "DE8937040044053201300"),
    ]
    found = pii.found_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: ([(s["start"], s["end"]) for s in r["secret"]], [(s["start"], s["end"]) for s in r["iban"]]) for r in found.collect()}
    assert [got[i][0] for i in (1, 2, 3)] == [[(9, 49)], [], []]
    assert [got[i][1] for i in (4, 5, 6, 7, 8)] == [[(4, 26)], [(0, 27)], [], [(22, 44)], []]


def test_iban_and_context(spark):
    rows = [
        (1, "pay to account DE89 3704 0044 0532 0130 00 please"),
        (2, "GB82WEST12345698765432"),
        (3, "GB82WEST12345698765433"),
        (4, "call me: +1 212 555 0100"),
        (5, "xx +1 212 555 0100"),
    ]
    found = {r["doc_id"]: r for r in pii.found_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s["start"], s["end"]) for s in found[1]["iban"]] == [(15, 42)]
    assert len(found[2]["iban"]) == 1 and not found[3]["iban"]
    assert found[4]["phone"][0]["score"] > found[5]["phone"][0]["score"]
    assert found[1]["iban"][0]["score"] == 1.0


def test_redaction(spark):
    rows = [(1, "mail é a.b@c.de now, 4111 1111 1111 1111."), (2, None), (3, "plain")]
    found = pii.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in found} == {1: "mail é <email> now, <card>.", 2: "", 3: "plain"}


def test_odd_rows(odd, empty):
    assert pii.found_spans(odd).count() == odd.count()
    assert pii.found_spans(empty).count() == 0
