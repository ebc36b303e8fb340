from collections import Counter

from brute import near_groups

import corpus_pipeline
from agorametrics.llm import decontam, quality, queries


def test_stages_on_the_small_tables(spark, sf):
    docs = queries.table(spark, sf, "documents")
    columns, kept = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    judged = {r["doc_id"]: r["kept"] for r in quality.judged(docs, queries.table(spark, sf, "labels")).collect()}
    out = stages["quality_rules"](spark, docs, sf)
    assert out.columns == columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(k for k in kept if judged[k])

    heads = sorted(g[0] for g in near_groups({k: r["text"] for k, r in kept.items() if judged[k]}, empty_link=True))
    alone = stages["near_dedup"](spark, out, sf)
    assert alone.columns == columns
    assert sorted(r["doc_id"] for r in alone.collect()) == heads

    bad = {r["doc_id"] for r in decontam.judged(alone, queries.table(spark, sf, "benchmark")).collect() if r["contaminated"]}
    clean = stages["decontamination"](spark, alone, sf)
    assert clean.columns == columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(set(heads) - bad)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*queries.table(spark, sf, "documents").columns, "shard"]
    rows = out.collect()
    assert rows and sum(len(r["text"].encode()) for r in rows) > 0
    size = Counter()
    for r in rows:
        size[r["shard"]] += len(r["text"].encode())
    assert max(size.values()) <= 1 << 20


def test_odd_and_empty_tables(spark, odd, empty, tmp_path):
    folder = str(tmp_path)
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
        docs.collect()
