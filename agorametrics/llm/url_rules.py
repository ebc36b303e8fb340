"""URL filters: given host rules first, else association rules mined from labelled urls.

A url is a set of tokens (host labels, path segments, query names). FP-growth finds the token
combinations that are frequent among labelled urls together with the class "bad"; the rules
"combination -> bad" that hold often enough and surely enough are kept, without those that a
shorter rule implies. An inverted index from each rule's rarest token finds the urls a rule may
fit; all of its tokens are then compared.

Defined cases: a null url, or one without "://", has empty host, path and tokens: only the
verdict "allow" remains; labels or pages without rows, or without both classes, give no mined
rules; repeated urls get equal verdicts; pages with equal page_id are judged one by one.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorametrics.plans.tables import write_once

# (verdict, host, path). Fixed values.
GIVEN_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.8
MIN_ROWS = 20
MAX_TOKENS = 3
BAD = "=bad"
# A rule is a few short tokens: a few megabytes at most. Larger sets are joined by shuffle.
BROADCAST_RULES = 20_000


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")


def with_parts(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path, query)."""
    rest = F.coalesce(after_scheme(F.col("url")), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return pages.select("page_id", "url").select(
        "page_id",
        "url",
        F.translate(host, string.ascii_uppercase, string.ascii_lowercase).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1).alias("query"),
    )


def tokens() -> Column:
    """Distinct tokens of a url; numbers in paths count as one token."""
    labels = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("h:"), x))
    segment = lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"[0-9]+", "#"))
    segments = F.transform(F.split("path", "/"), segment)
    names = F.transform(
        F.regexp_extract_all("query", F.lit(r"(?:^|&)([^=&]+)"), 1),
        lambda x: F.concat(F.lit("q:"), x),
    )
    every = F.array_distinct(F.concat(labels, segments, names))
    return F.filter(every, lambda x: F.length(x) > 2)


def mined_rules(
    parts: DataFrame,
    labels: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_rows: int = MIN_ROWS,
    max_tokens: int = MAX_TOKENS,
) -> DataFrame:
    """(tokens, confidence, rows) of the rules "tokens -> bad"; bad is label quality 0."""
    known = labels.where("quality is not null").select(
        F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad")
    )
    known = known.groupBy("page_id").agg(F.max("bad").alias("bad"))
    items = F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens"))
    baskets = parts.select("page_id", tokens().alias("tokens")).join(known, "page_id")
    baskets = write_once(baskets.select(items.alias("items")), "url-baskets")
    total = baskets.count()
    if total == 0:
        return baskets.select("items", F.lit(0.0), F.lit(0)).toDF("tokens", "confidence", "rows").limit(0)
    support = max(min_support, min(1.0, min_rows / total))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(
        (F.size("consequent") == 1)
        & (F.get("consequent", F.lit(0)) == BAD)
        & (F.size("antecedent") <= max_tokens)
    )
    found = found.select(
        F.array_sort("antecedent").alias("tokens"),
        "confidence",
        (F.col("support") * total).cast("long").alias("rows"),
    )
    # Without the rules that a shorter one implies: its tokens are a subset.
    found = write_once(found, "url-rules")
    short = found.select(F.col("tokens").alias("short"))
    shorter = short.withColumn("token", F.get("short", F.lit(0)))
    implied = (
        found.select("tokens", F.explode("tokens").alias("token"))
        .join(shorter, "token")
        .where((F.size("short") < F.size("tokens")) & (F.size(F.array_except("short", "tokens")) == 0))
        .select("tokens")
        .distinct()
    )
    return found.join(implied, "tokens", "left_anti")


def matches(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined): the surest mined rule that each url fits."""
    urls = parts.groupBy("url").agg(*(F.first(c).alias(c) for c in ("host", "path", "query")))
    urls = urls.select("url", tokens().alias("tokens"))
    words = rules.select(F.explode("tokens").alias("token"), "tokens", "confidence")
    common = words.groupBy("token").agg(F.count("*").alias("uses"))
    # Each rule stands in the index under the token that the fewest rules use.
    index = (
        words.join(common, "token")
        .groupBy("tokens", "confidence")
        .agg(F.min(F.struct("uses", "token"))["token"].alias("token"))
        .withColumnRenamed("tokens", "rule_tokens")
    )
    index = write_once(index, "url-index")
    small = index.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    hits = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(
        F.broadcast(index) if small else index, "token"
    )
    hits = hits.where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    best = F.max(F.struct("confidence", F.array_join("rule_tokens", " ").alias("name")))
    return hits.groupBy("url").agg(best["name"].alias("mined"))


def given_rule(rules=GIVEN_RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    host, path = F.col("host"), F.col("path")
    for what, on, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == on) | host.endswith(f".{on}")) & path.startswith(start)
        rule = F.when(fits, F.lit(on + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, labels: DataFrame, rules=GIVEN_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) per page."""
    parts = with_parts(pages)
    mined = write_once(matches(parts, mined_rules(parts, labels)), "url-matches")
    rule, verdict = given_rule(rules)
    return parts.join(mined, "url", "left").select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(
            verdict, F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
        ).alias("verdict"),
        "mined",
    )
