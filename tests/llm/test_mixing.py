import random
import re
from collections import Counter, defaultdict

import pytest

from agorametrics.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Shares, capped and shared again until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def brute_seats(targets, seats):
    names = sorted(targets, key=lambda s: (s is None, s or ""))
    won = Counter()
    for _ in range(seats):
        won[max(names, key=lambda s: (targets[s] / (2 * won[s] + 1), -names.index(s)))] += 1
    return won


def sizes_of(texts):
    out = Counter()
    for source, text in texts:
        out[source] += len(WORD.findall(text or ""))
    return dict(out)


def test_targets_and_taken(spark, sf, duck):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = sizes_of(duck.execute("SELECT source, text FROM documents").fetchall())
    targets = brute_targets(sizes)
    source = dict(duck.execute("SELECT doc_id, source FROM documents").fetchall())
    rows = mixing.mixed(docs).collect()
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 0.5
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in rows)


@pytest.mark.parametrize("seats", [1, 7, 50, 333])
def test_quotas_are_highest_quotients(spark, seats):
    targets = {"a": 500.0, "b": 31.0, "c": 30.0, "d": 12.5, "e": 12.5, "f": 0.0, "g": 1.0}
    total = sum(targets.values())
    rows = [(i, targets[s]) for i, s in enumerate(sorted(targets))]
    shares = spark.createDataFrame(rows, "rank int, target double")
    found = mixing.quotas(shares, total / seats, shards=5).collect()
    held = defaultdict(dict)
    for r in found:
        assert r["blocks"] >= 0
        held[r["shard"]][r["rank"]] = r["blocks_before"] + r["blocks"]
    for shard, blocks in held.items():
        expected = brute_seats({s: t for s, t in targets.items() if t > 0}, seats * (shard + 1) // 5)
        assert {k: v for k, v in blocks.items() if v} == {i: expected[s] for i, s in enumerate(sorted(targets)) if expected[s]}


def brute_parts(placed, targets, ends, first, block):
    """{(source, start, size): words by (round, shard)}, drawing block by block, word by word.

    ``placed`` has (source, start, size).
    """
    out = defaultdict(Counter)
    for s in targets:
        rows = sorted(r for r in placed if r[0] == s and r[2])
        length = sum(r[2] for r in rows)
        assert [r[1] for r in rows] == [sum(q[2] for q in rows[:k]) for k in range(len(rows))]
        owner = [r for r in rows for _ in range(r[2])]
        full = length // block
        order = sorted(range(full), key=lambda k: (mixing.STRIDE * k + first[s]) % max(full, 1)) + [full]
        left, drawn, round_ = min(round(targets[s]), 3 * length), 0, 0
        while left:
            for k in order:
                words = owner[k * block : (k + 1) * block if k < full else length][:left]
                shard = min(sum(1 for e in ends[s] if e <= drawn // block), 7)
                for row in words:
                    out[row][round_, shard] += 1
                left, drawn = left - len(words), drawn + len(words)
            round_ += 1
    return out


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_blocks_are_drawn_and_dealt_out(spark, block):
    """Sources of 500 words and less beside large ones get their targets to the word."""
    rng = random.Random(block)
    sizes = {"big": 9000, "large": 7000, "mid": 500, "small": 40, "tiny": 1, None: 300}
    rows = []
    for s, total in sizes.items():
        while total:
            n = min(total, rng.randrange(1, 400))
            rows.append((len(rows), " ".join("w" for _ in range(n)), s))
            total -= n
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sources, by_shard = mixing.plan(mixing._sized(docs), block=block)
    known = {r["source"]: r for r in sources.collect()}
    targets = brute_targets(sizes)
    assert sum(r["blocks"] for r in by_shard.collect()) == max(1, round(sum(sizes.values()) / block))
    line = mixing._on_the_line(mixing._sized(docs), sources, mixing.SEED)
    placed = {r["doc_id"]: (r["source"], r["start"], r["size"]) for r in line.collect()}
    ends = {s: r["shard_ends"] or [] for s, r in known.items()}
    expected = brute_parts(list(placed.values()), targets, ends, {s: r["first"] for s, r in known.items()}, block)
    taken = Counter()
    for r in mixing.mixed(docs, block=block).collect():
        words = Counter()
        for p in r["parts"]:
            words[p["round"], p["shard"]] += p["words"]
            assert 0 <= p["from"] and p["from"] + p["words"] <= r["size"]
        assert words == expected[placed[r["doc_id"]]] and r["taken"] == sum(words.values()) <= 3 * r["size"]
        # Parts side by side are one.
        same = [(a, b) for a, b in zip(r["parts"], r["parts"][1:]) if a["round"] == b["round"]]
        assert all(a["shard"] != b["shard"] or a["from"] + a["words"] < b["from"] for a, b in same)
        taken[rows[r["doc_id"]][2]] += r["taken"]
    assert {s: taken[s] for s in sizes} == {s: min(round(targets[s]), 3 * sizes[s]) for s in sizes}
    assert taken["mid"] > 0 and taken["tiny"] > 0


def test_shards_fill_by_their_quotas(spark, sf):
    """Each shard's words of a source are its quota of blocks, to within a block or two."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    block = 64
    sources, by_shard = mixing.plan(mixing._sized(docs), block=block)
    rank = {r["source"]: r["rank"] for r in sources.collect()}
    quota = {(r["rank"], r["shard"]): r["blocks"] for r in by_shard.collect()}
    out = mixing.mixture(docs, block=block, shard="shard")
    assert out.columns == [*docs.columns, "shard"]
    words = Counter()
    for r in out.collect():
        words[rank[r["source"]], r["shard"]] += len(WORD.findall(r["text"]))
    for key, blocks in quota.items():
        assert abs(words[key] - blocks * block) <= 2 * block


def test_mixture_matches_taken(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixed(docs).collect() if r["taken"]}
    out = mixing.mixture(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    words = Counter()
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["text"] in whole[r["doc_id"]]
    assert dict(words) == taken


def test_odd_rows(odd, empty):
    rows = mixing.mixed(odd).collect()
    assert len(rows) == odd.count()
    sizes = sizes_of((r["source"], r["text"]) for r in odd.collect())
    assert sum(r["target"] for r in rows if r["doc_id"] in (5,)) == pytest.approx(brute_targets(sizes)["a"])
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mixture(odd).columns == odd.columns
    assert mixing.mixed(empty).count() == 0 and mixing.mixture(empty).count() == 0
    none = odd.where("doc_id in (2, 3, 4)")
    assert [r["taken"] for r in mixing.mixed(none).collect()] == [0, 0, 0] and mixing.mixture(none).count() == 0
