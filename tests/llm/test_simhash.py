import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from agorametrics.llm import queries, simhash
from agorametrics.llm.components import components


def brute_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(values, distance=4):
    """values: {key: fingerprint}; the smallest key of each key's component."""
    parent = {k: k for k in values}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(values)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if bin(values[a] ^ values[b]).count("1") <= distance and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in keys}


def test_query_against_brute_force(spark, sf, texts):
    rows = queries.op4_simhash(spark, sf).collect()
    prints = {k: brute_fingerprint(t) for k, t in texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_groups(prints)


def flipped(rng, value, most):
    for b in rng.sample(range(64), rng.randrange(most + 1)):
        value ^= 1 << b
    return value


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize(("dense", "blocks"), [(1000, None), (2, 6), (5, 5), (0, 7)])
def test_links_of_dense_groups(spark, dense, blocks):
    """Clusters, chains and lone values; small bounds send groups to the longer keys."""
    rng = random.Random(5)
    values = {0, (1 << 64) - 1}
    for _ in range(5):
        centre = rng.getrandbits(64)
        values |= {flipped(rng, centre, 7) for _ in range(60)}
        chain = centre
        for _ in range(20):
            chain = flipped(rng, chain, 5)
            values.add(chain)
    values |= {rng.getrandbits(64) for _ in range(100)}
    fps = {signed(v): v for v in values}
    df = spark.createDataFrame([(k, 1 + k % 3) for k in fps], "fp long, copies long")
    rows = simhash.linked(df, dense=dense, blocks=blocks).collect()
    groups, expected = defaultdict(set), defaultdict(set)
    for r in rows:
        groups[r["component"]].add(r["fp"])
    for k, v in brute_groups(fps).items():
        expected[v].add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_masks_leave_out_any_distance():
    for blocks in simhash.BLOCKS:
        every = [m & ((1 << 64) - 1) for m in simhash.masks(blocks)]
        rng = random.Random(blocks)
        for _ in range(200):
            change = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(change & m == 0 for m in every)


def test_components_of_a_long_chain(spark):
    order = list(range(300))
    random.Random(1).shuffle(order)
    edges = list(zip(order, order[1:])) + [(1000, 1001), (1001, 1002)]  # noqa: B905
    rows = components(spark.createDataFrame(edges, "src long, dst long")).collect()
    found = {r["vertex"]: r["component"] for r in rows}
    assert set(found.values()) == {0, 1000} and len(found) == 303


def test_odd_rows(odd, empty, long_text):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    zero = [r for r in rows if r["fp"] == 0]
    assert {r["doc_id"] for r in zero} == {2, 3, 4, None} and {r["component_id"] for r in zero} == {2}
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, 2, 5, 7, None], key=str)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_repeated_rows_are_one(spark, odd):
    docs = odd.select("doc_id", "text").where(F.col("doc_id") == 1)
    assert simhash.one_of_each(docs.unionByName(docs)).count() == 1


def test_groups_that_share_or_lack_ids(spark):
    """Equal ids on unlinked texts lose no group; near copies without ids are one group."""
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    docs = spark.createDataFrame([(5, a), (7, a), (5, b), (12, b)], "doc_id long, text string")
    kept = simhash.one_of_each(docs).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(5, a), (5, b)]

    words = [f"w{i}" for i in range(200)]
    near = [" ".join([*words[:-1], last]) for last in ("x", "y", "z")]
    prints = [brute_fingerprint(t) for t in near]
    assert len(set(prints)) > 1 and all(bin(prints[0] ^ p).count("1") <= 4 for p in prints)
    docs = spark.createDataFrame([(None, t) for t in near], "doc_id long, text string")
    assert simhash.one_of_each(docs).count() == 1
