import hashlib

from agorametrics.llm import sharding


def places(rows):
    out = []
    for doc_id, text in rows:
        key = f"{'' if doc_id is None else doc_id}:{text or ''}"
        out.append(int(hashlib.md5(key.encode()).hexdigest()[:15], 16))
    return out


def brute(rows, limit):
    """Splits buckets bit by bit."""
    spots = list(zip(places(rows), (len((t or "").encode()) for _, t in rows), strict=True))
    out = {}

    def split(members, depth):
        if sum(spots[i][1] for i in members) <= limit or depth == 60:
            for i in members:
                out[i] = f"{spots[i][0]:060b}"[:depth]
            return
        for bit in (0, 1):
            if part := [i for i in members if spots[i][0] >> (59 - depth) & 1 == bit]:
                split(part, depth + 1)

    split(range(len(rows)), 0)
    return sorted(out[i] for i in range(len(rows)))


def test_against_splitting(spark, texts, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for limit in (100, 3000, 20_000, 1 << 30):
        found = sharding.shard_map(docs, limit).collect()
        assert sorted(r["shard"] for r in found) == brute(list(texts.items()), limit)
        for r in found:
            assert r["oversized"] or r["shard_bytes"] <= limit


def test_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for limit in (10, 200, 400_000):
        found = sharding.with_shard(odd, limit)
        assert set(found.columns) == set(odd.columns)
        assert sorted(r["shard"] for r in found.collect()) == brute(rows, limit)
    assert sharding.shard_map(empty).count() == 0 and sharding.with_shard(empty).count() == 0


def test_files(spark, odd, tmp_path):
    again = sharding.write_shards(odd, str(tmp_path / "out"), 400_000)
    drop = lambda df: sorted(map(str, df.select("doc_id", "text", "shard").collect()))
    assert drop(again) == drop(sharding.with_shard(odd, 400_000))
