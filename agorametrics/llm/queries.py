"""Check queries of the operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agorametrics.llm import (
    decontam,
    hard_negatives,
    line_dedup,
    mixing,
    pii,
    prefix_tree,
    quality,
    sharding,
    simhash,
    token_counts,
    toxicity,
    url_rules,
    whitening,
)

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, folder, "documents"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.scored(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judged(table(spark, folder, "pages"), table(spark, folder, "labels"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_map(table(spark, folder, "documents")).drop("place")


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.judged(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.found_spans(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(pii.span_text(pii.BASE), 256).alias("base_sha256"),
        pii.span_text(pii.KINDS).alias("spans"),
        pii.span_text(pii.KINDS, scores=True).alias("scored_spans"),
        (sum(F.size(k) for k in pii.KINDS) > 0).alias("personal"),
    )


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents")).drop("parts")


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(
        table(spark, folder, "embeddings"), is_anchor=F.col("vec_id") % 50 == 0, label=moved
    )


def op12_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_tree.near_duplicates(table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


LINE_DEDUP_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
w AS (
  SELECT a.doc_id, a.i, a.line AS x, b.line AS y, c.line AS z
  FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i = a.i + 1
  JOIN l c ON a.doc_id = c.doc_id AND c.i = a.i + 2
  WHERE trim(a.line || b.line || c.line) <> ''
),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, i) AS n FROM w),
gone AS (SELECT DISTINCT doc_id, i + k.o AS i FROM r, (SELECT unnest([0, 1, 2]) AS o) k WHERE n > 1),
kept AS (
  SELECT l.doc_id, count(gone.i) AS n_removed,
    string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL) AS text
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(len(d.lines), 0)::BIGINT AS n_lines,
  coalesce(kept.n_removed, 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

SHARDING_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS place
  FROM documents
),
steps AS (SELECT place, bytes, depth, place >> (60 - depth) AS prefix FROM d, (SELECT unnest(range(61)) AS depth)),
buckets AS (
  SELECT depth, prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
  FROM steps GROUP BY ALL HAVING sum(bytes) <= {sharding.LIMIT_BYTES}
),
found AS (
  SELECT place, min(steps.depth) AS depth FROM steps
  JOIN buckets ON steps.depth = buckets.depth AND steps.prefix = buckets.prefix GROUP BY place
)
SELECT d.doc_id, d.bytes,
  CASE WHEN coalesce(found.depth, 60) = 0 THEN ''
    ELSE lpad(bin(d.place >> (60 - coalesce(found.depth, 60))), coalesce(found.depth, 60)::INT, '0') END AS shard,
  coalesce(found.depth, 60)::INT AS depth, shard_bytes, shard_rows, found.depth IS NULL AS oversized
FROM d LEFT JOIN found ON d.place = found.place
LEFT JOIN buckets ON buckets.depth = found.depth AND buckets.prefix = d.place >> (60 - found.depth)
"""

DECONTAMINATION_SQL = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
),
starts AS (
  SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS s
  FROM items WHERE len(words) > 0
),
windows AS (
  SELECT DISTINCT item_id, least(len(words), 13) AS n, array_to_string(words[s : s + 12], ' ') AS w FROM starts
),
sizes AS (SELECT DISTINCT n FROM windows),
runs AS (
  SELECT doc_id, n, i, array_to_string(words[i : i + n - 1], ' ') AS w
  FROM (SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM low, sizes WHERE len(words) >= n)
),
hits AS (SELECT doc_id, runs.n, i, item_id FROM runs JOIN windows ON runs.w = windows.w AND runs.n = windows.n),
covered AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM hits) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1
)
SELECT low.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM low LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

HARD_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
p AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
),
positives AS (
  SELECT * FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
),
found AS (
  SELECT anchor_id, positives.other AS positive_id, n.other AS negative_id,
    positives.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positives.other ORDER BY n.score DESC, n.other) AS rank
  FROM positives JOIN p n USING (anchor_id)
  WHERE NOT n.same AND 50 * positives.score <= 100 * n.score AND 100 * n.score <= 95 * positives.score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score
FROM found WHERE rank <= 3
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_toxicity,
        op3_url_filters,
        op4_simhash,
        op5_sharding,
        op6_decontamination,
        op7_pii,
        op8_token_counts,
        op9_quality_rules,
        op10_mixing,
        op11_hard_negatives,
        op12_ngram_join,
        op13_whitening,
    )
}
ORACLES = {
    "op1_line_dedup": LINE_DEDUP_SQL,
    "op5_sharding": SHARDING_SQL,
    "op6_decontamination": DECONTAMINATION_SQL,
    "op11_hard_negatives": HARD_NEGATIVES_SQL,
}
