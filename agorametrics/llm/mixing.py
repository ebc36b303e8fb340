"""Mixing sources to target weights with blocks of equal size, apportioned by Sainte-Laguë.

Sources in code point order, null last, weigh 5, 2, 1, repeating, and share all words; a target
stops at three times its source's words, and the excess is shared again by weight. The words
are allocated in blocks: the next block goes to the source with the highest quotient
target / (2k + 1), k its blocks so far. Quotients are only listed where the last block can be:
a source's blocks differ from its exact share by a known bound, so all sources together list
a few rows each. Allocating for the first 1, 2, ... shards' blocks gives each shard its quotas.

A source's documents stand on a line in seeded order, which is cut into blocks. The blocks are
drawn in a seeded order, all of them before any is drawn again, until the source has its target; the
last one is cut where that is reached. So each source gives its target to the word, however small.
The quotas deal the drawn blocks out to the shards in turn. Blocks side by side that go to the same
shard in the same round are one part, so a document is only cut where its blocks part ways, and is
never taken more than three times.

Defined cases: null and empty texts have no words and are not taken; a null source is a source;
rows that are equal have places of their own; very long texts are cut into as many parts as they
have blocks at most; extra columns of any name stay; an empty table, or one without words, gives
zero targets; sizes and orders don't depend on partitions, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agorametrics.llm.common import WORD, row_struct, text_key, word_count
from agorametrics.plans.tables import write_once

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
SHARDS = 8
SEED = 20240229
# Words of a block.
BLOCK = 4096
# Steps from block to block in the order of drawing; a prime, so it meets every block.
STRIDE = 2654435761
# Rows that share one sorted run of a source's line.
ROWS_A_BUCKET = 16_384
LEAST_BUCKETS = 64


def source_sizes(sized: DataFrame) -> DataFrame:
    """(source, source_size, source_rows) from (source, size)."""
    return sized.groupBy("source").agg(
        F.sum("size").cast("long").alias("source_size"), F.count("*").alias("source_rows")
    )


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` with rank, weight, total and target. One row per source meets in one task."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy(F.lit(0))
    rank = (F.row_number().over(by_name) - 1).cast("int")
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), F.col("rank") % len(WEIGHTS)).cast("double")
    known = sources.withColumn("rank", rank).withColumn("weight", weight)
    known = known.withColumn("total", F.sum("source_size").over(every))
    known = known.withColumn("most", F.col("source_size") * float(MOST_TIMES))
    # By how much of a share they can take, sources reach their limit one after the other.
    order = W.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), "rank")
    full = F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    known = known.withColumn("level", (F.col("total") - full) / open_weight)
    known = known.withColumn("place", F.row_number().over(order))
    stops = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("place", "level"))
    known = known.withColumn("stop", F.min(stops).over(every))
    target = F.when(
        F.col("stop").isNull() | (F.col("place") < F.col("stop.place")), F.col("most")
    ).otherwise(F.col("stop.level") * F.col("weight"))
    return known.select(
        "source", "source_size", "source_rows", "rank", "weight", "total", target.alias("target")
    )


def quotas(shares: DataFrame, block: int, shards: int = SHARDS) -> DataFrame:
    """(rank, shard, blocks_before, blocks): each source's blocks in each shard."""
    total, sources = (shares.agg(F.sum("target"), F.count("*"))).first()
    if not total:
        return shares.select(
            "rank", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("blocks_before"), F.lit(0).cast("long").alias("blocks")
        ).limit(0)
    house = max(1, round(total / block))
    seats = F.floor(F.lit(house) * F.col("upto") / shards)
    each = shares.where("target > 0").select(
        "rank", "target", F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("upto")
    ).withColumn("seats", seats)
    share = F.col("target") / F.lit(total)
    fewest = F.greatest(F.lit(0), F.floor(share * (F.col("seats") - sources / 2) - 0.5))
    most = F.floor(share * (F.col("seats") + sources / 2) + 0.5) + 1
    each = each.withColumn("fewest", fewest.cast("long")).withColumn("most", most.cast("long"))
    each = each.withColumn("left", F.col("seats") - F.sum("fewest").over(W.partitionBy("upto")))
    listed = each.select(
        "rank", "upto", "target", "left", F.explode(F.sequence("fewest", F.col("most"))).alias("k")
    ).withColumn("quotient", F.col("target") / (2 * F.col("k") + 1))
    highest = W.partitionBy("upto").orderBy(F.col("quotient").desc(), "rank")
    won = listed.withColumn("at", F.row_number().over(highest)).where("at <= left")
    won = won.groupBy("rank", "upto").agg(F.count("*").alias("won"))
    held = each.join(won, ["rank", "upto"], "left").select(
        "rank", "upto", (F.col("fewest") + F.coalesce("won", F.lit(0))).alias("upto_blocks")
    )
    before = F.coalesce(
        F.lag("upto_blocks").over(W.partitionBy("rank").orderBy("upto")), F.lit(0)
    )
    held = held.withColumn("blocks_before", before.cast("long"))
    return held.select(
        "rank",
        (F.col("upto") - 1).alias("shard"),
        "blocks_before",
        (F.col("upto_blocks") - F.col("blocks_before")).cast("long").alias("blocks"),
    )


def plan(sized: DataFrame, shards: int = SHARDS, seed: int = SEED, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The sources with their targets, what is taken and the shards' ends, and the quotas by shard.

    ``shard_ends`` holds, for each shard, how many of the source's blocks it and those before it get.
    """
    shares = write_once(targets(source_sizes(sized)), "mix-targets")
    by_shard = write_once(quotas(shares, block, shards), "mix-quotas")
    ends = F.array_sort(F.collect_list(F.struct("shard", (F.col("blocks_before") + F.col("blocks")).alias("upto"))))
    ends = by_shard.groupBy("rank").agg(F.transform(ends, lambda e: e["upto"]).alias("shard_ends"))
    taken = F.least(F.round("target"), F.col("source_size") * MOST_TIMES).cast("long")
    first = F.pmod(F.xxhash64(F.lit(seed), "rank"), F.lit(STRIDE))
    known = shares.join(ends, "rank", "left").select(
        "source", "source_size", "source_rows", "rank", "target", taken.alias("source_taken"), first.alias("first"), "shard_ends"
    )
    return write_once(known, "mix-sources"), by_shard


def _on_the_line(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """``rows`` (row, source, size, doc_id, text_key) with the source's columns and ``start``.

    A line is cut into buckets by the seeded hash that orders it, so no task sorts a source.
    """
    most = sources.agg(F.max("source_rows")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, most // ROWS_A_BUCKET)
    spot = F.xxhash64(F.lit(seed), "doc_id", "text_key")
    bucket = F.floor((spot.cast("double") / 2.0**64 + 0.5) * buckets).cast("int")
    # A source is a name, so there are few of them; past the bound Spark shuffles instead.
    known = sources.select(
        F.col("source").alias("known"), "source_size", "target", "source_taken", "first", "shard_ends", "rank"
    )
    small = sources.count() <= 100_000
    found = rows.join(F.broadcast(known) if small else known, rows["source"].eqNullSafe(F.col("known")))
    found = found.drop("known").withColumn("spot", spot).withColumn("bucket", bucket)
    sums = found.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    before = W.partitionBy("rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(
        "rank", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("bucket_start")
    )
    starts = write_once(starts, "mix-starts")
    line = W.partitionBy("rank", "bucket").orderBy("spot", "doc_id", "text_key")
    upto = F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0))
    placed = found.withColumn("upto", upto).join(starts, ["rank", "bucket"])
    return placed.withColumn("start", F.col("bucket_start") + F.col("upto") - F.col("size"))


def _drawn(number: Column, block: int) -> Column:
    """The place of a block in the order of drawing; what is left behind the last full block is last."""
    full = F.floor(F.col("source_size") / block)
    drawn = F.pmod(F.lit(STRIDE) * number + F.col("first"), F.greatest(full, F.lit(1)))
    return F.when(number >= full, full).otherwise(drawn)


def _shard(words_before: Column, block: int, shards: int) -> Column:
    """The shard of a block that is drawn after so many words of its source."""
    ends = F.coalesce(F.col("shard_ends"), F.array().cast("array<long>"))
    passed = F.size(F.filter(ends, lambda e: e <= F.floor(words_before / block)))
    return F.least(passed, F.lit(shards - 1)).cast("int")


def _parts(block: int = BLOCK, shards: int = SHARDS) -> Column:
    """What is taken of a document: an array of (round, from, words, shard), in that order."""
    size, start = F.col("size"), F.col("start")
    length = F.greatest(F.col("source_size"), F.lit(1))
    rounds, rest = F.floor(F.col("source_taken") / length), F.col("source_taken") % length
    full = F.floor(F.col("source_size") / block)
    number = lambda at: F.least(F.floor(at / block), full)
    long = lambda c: c.cast("long")

    def piece(round_: Column, k: Column) -> Column:
        """Block ``k``'s share of the document in one round; the last round stops within a block."""
        drawn = _drawn(k, block)
        left = F.when(round_ < rounds, length).otherwise(rest) - drawn * block
        first = F.greatest(start, k * block)
        upto = F.least(start + size, F.when(k < full, (k + 1) * block).otherwise(length), k * block + F.greatest(left, F.lit(0)))
        return F.struct(
            long(round_).alias("round"),
            long(first - start).alias("from"),
            long(F.greatest(upto - first, F.lit(0))).alias("words"),
            _shard(round_ * length + drawn * block, block, shards).alias("shard"),
        )

    blocks = F.sequence(long(number(start)), long(number(start + size - 1)))
    every = F.flatten(
        F.transform(F.sequence(F.lit(0).cast("long"), long(rounds)), lambda r: F.transform(blocks, lambda k: piece(r, k)))
    )
    kept = F.filter(every, lambda p: p["words"] > 0)

    def joined(done: Column, p: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        beside = (last["round"] == p["round"]) & (last["shard"] == p["shard"]) & (last["from"] + last["words"] == p["from"])
        longer = F.struct(
            last["round"].alias("round"), last["from"].alias("from"), (last["words"] + p["words"]).alias("words"), last["shard"].alias("shard")
        )
        merged = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        return F.when(F.coalesce(beside, F.lit(False)), merged).otherwise(F.concat(done, F.array(p)))

    none = F.array().cast("array<struct<round:bigint,from:bigint,words:bigint,shard:int>>")
    return F.when(size > 0, F.aggregate(kept, none, joined)).otherwise(none)


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "source", word_count(F.col("text")).alias("size"))


def mixed(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken, parts) per row of ``docs``."""
    rows = write_once(_sized(docs), "mix-rows")
    sources, _ = plan(rows, shards, seed, block)
    placed = _on_the_line(rows, sources, seed).withColumn("parts", _parts(block, shards))
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "parts")


def _cut_text(text: Column, begin: Column, words: Column) -> Column:
    """``words`` words from word ``begin`` on, with the white space between them."""
    pieces = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    return F.array_join(F.slice(pieces, begin.cast("int") + 1, words.cast("int")), "")


def mixture(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, block: int = BLOCK, shard: str | None = None
) -> DataFrame:
    """The mix itself with the columns of ``docs``: a row for each part taken.

    Parts that don't hold all words have the text of their words, and n_chars, if there is such
    a column, follows. ``shard`` names a column, added or replaced, with the part's shard.
    """
    sources, _ = plan(_sized(docs), shards, seed, block)
    rows = row_struct(docs).select(
        "row",
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.source").alias("source"),
        text_key(F.col("row.text")).alias("text_key"),
        word_count(F.col("row.text")).alias("size"),
    )
    placed = _on_the_line(rows, sources, seed)
    parts = placed.select("row", "size", F.explode(_parts(block, shards)).alias("part"))
    whole = F.col("part.words") == F.col("size")
    text = F.when(whole, F.col("row.text")).otherwise(
        _cut_text(F.col("row.text"), F.col("part.from"), F.col("part.words"))
    )
    parts = parts.select("row", whole.alias("whole"), text.alias("text"), F.col("part.shard").alias("shard"))
    out = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out["n_chars"] = F.when(F.col("whole"), out["n_chars"]).otherwise(F.char_length("text").cast(kind))
    if shard is not None:
        out[shard] = F.col("shard")
    return parts.select(*(c.alias(name) for name, c in out.items()))
