import re

import pytest

from agorametrics.llm import queries, url_rules

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for rule in RULES:
        on, _, start = rule.partition("/")
        if (host == on or host.endswith("." + on)) and path.startswith("/" + start):
            best = rule if best is None or len(rule) > len(best) else best
    return host, path, best


def test_given_rules(spark, sf):
    rows = queries.op3_url_filters(spark, sf).collect()
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in rows:
        assert (r["host"], r["path"], r["rule"]) == brute(urls[r["page_id"]])
        if r["rule"]:
            assert r["verdict"] == RULES[r["rule"]]
    assert len(rows) == len(urls)


@pytest.fixture(scope="module")
def sites(spark):
    pages, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        host = "spam.example.org" if bad else "good.example.org"
        pages.append((i, f"http://{host}/es/{i}", None))
        labels.append((i, 0 if bad else 1, 0))
    pages += [(1000, "https://m.spam.example.org/es/9?x=1", None), (1001, "https://spam.example.org/fr/1", None)]
    pages += [(1002, None, None), (1003, "nothing", None), (1004, "", None), (None, "http://EXAMPLE.net/en/#x", None)]
    pages += [(1002, None, None), (1005, "HTTP://net?x/", None), (1006, "http://É.NET/", None), (1007, "http://a.org/" + "x/" * 20000, None)]
    spark_pages = spark.createDataFrame(pages, "page_id long, url string, html string")
    return spark_pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_mined_rules(sites):
    pages, labels = sites
    rows = url_rules.judged(pages, labels).collect()
    assert len(rows) == pages.count()
    for r in rows:
        if r["page_id"] is not None and r["page_id"] < 600:
            assert r["verdict"] == ("block" if r["page_id"] % 3 == 0 else "allow")
    by_id = {r["page_id"]: r for r in rows}
    assert by_id[1000]["verdict"] == "block" and by_id[1000]["mined"]
    assert (by_id[1001]["rule"], by_id[1001]["verdict"]) == ("org/fr/", "allow")
    assert (by_id[1002]["host"], by_id[1002]["path"], by_id[1002]["verdict"]) == ("", "", "allow")
    assert by_id[1003]["host"] == "" and by_id[None]["rule"] == "example.net/en/"
    assert by_id[1005]["host"] == "net" and by_id[1005]["rule"] is None
    assert by_id[1006]["host"] == "É.net" and by_id[1006]["rule"] == "net/"
    mined = url_rules.mined_rules(url_rules.with_parts(pages), labels).collect()
    assert ["h:spam"] in [r["tokens"] for r in mined]
    assert not any(len(r["tokens"]) > 1 and "h:spam" in r["tokens"] for r in mined)


def test_empty_tables(sites):
    pages, labels = sites
    assert url_rules.judged(pages, labels.limit(0)).count() == pages.count()
    assert url_rules.judged(pages.limit(0), labels).count() == 0
