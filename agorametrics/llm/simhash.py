"""SimHash near-duplicates: pigeonhole blocks, then the Hamming distance.

Texts become 64-bit fingerprints, and equal ones are one from then on. For distance d, the 64
bits are cut into more than d blocks; two close fingerprints agree on all but d of them, so every
choice of the other blocks is a key to join on. Groups of a key are not paired off:

1. Each group's most frequent fingerprint is its centre, and the others are compared with it.
   This joins nearly all of a group of near copies at a cost linear in the rows.
2. Only groups whose members still lie in different components are looked at again, and only the
   members outside the centre's component are compared with those of other components. Links
   inside a component would change nothing.
3. Where more than ``DENSE`` members of a group are outside, these fingerprints get more and
   longer keys instead, and 1 and 2 are repeated for them.

So the components are those of all links, without ever listing the pairs of a dense group.

Defined cases: null and empty texts, and those of white space, have fingerprint zero and link like
any other; texts of fewer words than a shingle are one shingle; null doc_ids link, and name a
component only if no other member has an id; an empty table gives no rows.
"""

from __future__ import annotations

import math
import sys
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorametrics.llm.common import text_key
from agorametrics.llm.components import components
from agorametrics.plans.tables import write_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 4
SEED = 42
DISTANCE = 4
DENSE = 1000
# Numbers of blocks to choose from: more blocks give more keys of more bits each.
BLOCKS = (6, 7, 8, 10, 12)
# Chance mates that a fingerprint may have over all keys before longer keys are taken.
MATES = 8
# Shingles that are counted at once.
CHUNK = 1 << 16


def fingerprint(text: bytes | None, size: int = WORDS) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    # On bytes, lower() and split() know ASCII only, which is what is asked for.
    words = (text or b"").lower().split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    joined = b" ".join(words)
    last = ends[min(size, len(words)) - 1 :].tolist()
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(last), CHUNK):
        spans = zip(starts[at : at + CHUNK], last[at : at + CHUNK])  # noqa: B905
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(last), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, text_key, fp) with the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, size) for t in texts], dtype=np.uint64).view(np.int64))

    text = F.col("text")
    return docs.select("doc_id", text_key(text).alias("text_key"), each(text.cast("binary")).alias("fp"))


def masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """Signed masks, one for each choice of all but ``distance`` of the blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    own = [sum(1 << b for b in range(edges[k], edges[k + 1])) for k in range(blocks)]
    every = (sum(c) for c in combinations(own, blocks - distance))
    return [m - (1 << 64) if m >> 63 else m for m in every]


def choose_blocks(rows: int, distance: int = DISTANCE) -> int:
    for blocks in BLOCKS:
        if blocks > distance:
            bits = 64 * (blocks - distance) // blocks
            if rows * math.comb(blocks, distance) / 2**bits <= MATES:
                return blocks
    return BLOCKS[-1]


def _keyed(fps: DataFrame, blocks: int, distance: int) -> DataFrame:
    """A row (choice, bits) for each key of each row of ``fps``."""
    keys = [
        F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits"))
        for k, m in enumerate(masks(blocks, distance))
    ]
    return fps.select("*", F.inline(F.array(*keys)))


def _close(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def _star_links(fps: DataFrame, blocks: int, distance: int) -> DataFrame:
    """Links from each key's most frequent fingerprint; also writes nothing for lone members."""
    keyed = _keyed(fps, blocks, distance)
    groups = keyed.groupBy("choice", "bits").agg(
        F.count("*").alias("members"), F.max_by("fp", "copies").alias("centre")
    )
    groups = write_once(groups.where("members > 1").drop("members"), "block-centres")
    found = keyed.join(groups, ["choice", "bits"]).where(
        (F.col("fp") != F.col("centre")) & _close(F.col("fp"), F.col("centre"), distance)
    )
    links = found.select(F.col("fp").alias("src"), F.col("centre").alias("dst"))
    return write_once(links.distinct(), "star-links")


def _cross_links(
    fps: DataFrame, blocks: int, distance: int, dense: int | None
) -> tuple[DataFrame, DataFrame | None]:
    """Links between components, and the fingerprints of groups that are too dense for it.

    ``fps`` has (fp, copies, component).
    """
    keyed = _keyed(fps, blocks, distance)
    groups = keyed.groupBy("choice", "bits").agg(
        F.count("*").alias("members"),
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.max_by("component", "copies").alias("hub"),
    )
    # Two members have been compared already, as centre and other.
    groups = write_once(groups.where("members > 2 and low < high").drop("low", "high"), "block-groups")
    inside = write_once(keyed.join(groups, ["choice", "bits"]), "block-members")
    outside = inside.where("component != hub")
    rest = None
    if dense is not None:
        crowd = outside.where(F.col("members") > dense).groupBy("choice", "bits").count()
        crowd = write_once(crowd.where(F.col("count") > dense).select("choice", "bits"), "block-crowds")
        if not crowd.isEmpty():
            rest = inside.join(crowd, ["choice", "bits"], "left_semi").select("fp", "copies", "component").distinct()
            rest = write_once(rest, "block-rest")
            outside = outside.join(crowd, ["choice", "bits"], "left_anti")
    a = outside.select("choice", "bits", F.col("fp").alias("fp_a"), F.col("component").alias("src"))
    b = inside.select("choice", "bits", "fp", F.col("component").alias("dst"), "hub")
    pairs = a.join(
        b,
        (a["choice"] == b["choice"])
        & (a["bits"] == b["bits"])
        & (F.col("src") != F.col("dst"))
        & ((F.col("dst") == F.col("hub")) | (F.col("fp_a") < F.col("fp")))
        & _close(F.col("fp_a"), F.col("fp"), distance),
    )
    return write_once(pairs.select("src", "dst").distinct(), "cross-links"), rest


def _relabelled(fps: DataFrame, links: DataFrame) -> DataFrame:
    """``fps`` with ``component`` replaced by the component over ``links`` between components."""
    if links.isEmpty():
        return fps
    merged = components(links).withColumnRenamed("component", "merged")
    out = fps.join(merged, fps["component"] == merged["vertex"], "left").select(
        "fp", "copies", F.coalesce("merged", "component").alias("component")
    )
    return write_once(out, "components")


def linked(fps: DataFrame, distance: int = DISTANCE, dense: int = DENSE, blocks: int | None = None) -> DataFrame:
    """(fp, copies, component) of the different fingerprints ``fps`` (fp, copies)."""
    blocks = blocks or choose_blocks(fps.count(), distance)
    known = fps.withColumn("component", F.col("fp"))
    todo = fps
    while True:
        links = _star_links(todo, blocks, distance)
        names = known.select("fp", "component")
        if not links.isEmpty():
            ends = (
                links.join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst").where("a != b")
            )
            known = _relabelled(known, ends.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        more = known if todo is fps else known.join(todo.select("fp"), "fp", "left_semi")
        last = blocks >= BLOCKS[-1]
        links, rest = _cross_links(more, blocks, distance, None if last else dense)
        known = _relabelled(known, links)
        if rest is None:
            return known
        todo, blocks = rest.select("fp", "copies"), BLOCKS[-1]


def _grouped(docs: DataFrame, size: int, distance: int) -> DataFrame:
    """(doc_id, text_key, fp, component, component_id) per row of ``docs``."""
    rows = write_once(fingerprints(docs, size), "fingerprints")
    fps = rows.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    fps = write_once(fps, "different")
    found = linked(fps.select("fp", "copies"), distance)
    named = found.join(fps.select("fp", "least"), "fp")
    ids = write_once(named.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
    named = found.select("fp", "component").join(ids, "component")
    named = write_once(named.select("fp", "component", "component_id"), "fingerprint-ids")
    return rows.join(named, "fp").select("doc_id", "text_key", "fp", "component", "component_id")


def close_texts(docs: DataFrame, size: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """(text_key, component) of the different texts of ``docs``."""
    texts = write_once(fingerprints(docs, size).select("text_key", "fp").distinct(), "text-fingerprints")
    fps = write_once(texts.groupBy("fp").agg(F.count("*").alias("copies")), "different")
    return texts.join(linked(fps, distance), "fp").select("text_key", "component")


def near_duplicates(docs: DataFrame, size: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, text_key, fp, component_id) per row of ``docs``."""
    return _grouped(docs, size, distance).drop("component")


def one_of_each(docs: DataFrame, size: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest doc_id.

    Groups are told apart by their links, not by ids, which may repeat or be null.
    """
    return heads_only(docs, write_once(_grouped(docs, size, distance), "near-duplicates"))


def heads_only(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one row of each ``component`` of ``found`` (doc_id, text_key, component).

    The smallest doc_id stays, null last; of rows with that doc_id, the one with the smallest text
    key; of rows that agree in both, one.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("head")
    heads = found.groupBy("component").agg(first).select("head.doc_id", "head.text_key")
    times = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("times"))
    heads = write_once(
        heads.alias("h")
        .join(times.alias("t"), F.expr("h.doc_id <=> t.doc_id and h.text_key = t.text_key"))
        .select("h.doc_id", "h.text_key", "times"),
        "heads",
    )
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("_id"), text_key(F.col("text")).alias("_key")
    )
    kept = rows.join(heads, rows["_id"].eqNullSafe(heads["doc_id"]) & (rows["_key"] == heads["text_key"]))
    single = kept.where("times = 1").select("row.*")
    if heads.where("times > 1").isEmpty():
        return single
    twice = kept.where("times > 1").dropDuplicates(["_id", "_key"]).select("row.*")
    return single.unionByName(twice)
