"""Sharding by extendible hashing.

A row's place is a 60-bit hash of its doc_id and text. The directory is a tree over the bits of
that hash from the left: a bucket whose bytes fit the limit is a shard, an oversized one is
split on its next bit. Sizes are summed per cell, a prefix some bits finer than the shards will
be, and all levels above the cells come from those sums; cells that are still too large are
counted again some bits deeper, until nothing is oversized.

Defined cases: null text has no bytes; null doc_ids hash like any other value; rows that agree
in doc_id and text stay together, since no bit tells them apart, so a shard is only over the
limit if it holds one such row or equal ones (``oversized``); an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorametrics.llm.common import row_struct
from agorametrics.plans.tables import write_once

BITS = 60
FINER = 4
DEEPER = 8
LIMIT_BYTES = 1 << 20


def place(doc_id: Column, text: Column) -> Column:
    key = F.concat(
        F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))
    )
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _cut(place: Column, depth: int) -> Column:
    return F.shiftright(place, BITS - depth)


def _cells(sizes: DataFrame, above: int, depth: int, limit: int) -> DataFrame:
    """(cell, depth, bytes, rows): per cell of ``depth`` bits the bucket it falls in.

    The bucket is the first level from ``above`` on that fits; its depth is null where even the
    cell itself is too large.
    """
    cells = sizes.groupBy(_cut(F.col("place"), depth).alias("cell")).agg(
        F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")
    )
    cells = write_once(cells, "shard-cells")
    levels = F.explode(F.sequence(F.lit(above), F.lit(depth))).alias("depth")
    steps = cells.select("cell", "bytes", "rows", levels)
    prefix = F.expr(f"shiftright(cell, {depth} - depth)").alias("prefix")
    buckets = (
        steps.groupBy("depth", prefix)
        .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        .where(F.col("bytes") <= limit)
    )
    buckets = write_once(buckets, "shard-buckets")
    # Both sides grow with the shards, and their files are far smaller than their rows in memory.
    fits = (
        steps.select("cell", "depth", prefix)
        .join(buckets.hint("merge"), ["depth", "prefix"])
        .groupBy("cell")
        .agg(F.min(F.struct("depth", "bytes", "rows")).alias("bucket"))
    )
    found = cells.select("cell").join(fits, "cell", "left").select("cell", "bucket.*")
    return write_once(found, "shard-map")


def directory(sizes: DataFrame, limit: int = LIMIT_BYTES) -> list[tuple[int, DataFrame]]:
    """Maps from cells to buckets, as (bits, map), from the coarse to the fine.

    ``sizes`` has (place, bytes, rows). A place is looked up in the first map; if its bucket is
    null there, in the next.
    """
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + FINER)
    above, maps = 0, []
    while True:
        cells = _cells(sizes, above, depth, limit)
        maps.append((depth, cells))
        open_cells = cells.where("depth is null").select("cell")
        if depth == BITS or open_cells.isEmpty():
            return maps
        inside = sizes.withColumn("cell", _cut(F.col("place"), depth))
        sizes = write_once(inside.join(open_cells, "cell", "left_semi").drop("cell"), "shard-open")
        above, depth = depth + 1, min(BITS, depth + DEEPER)


def _assigned(rows: DataFrame, maps: list[tuple[int, DataFrame]], limit: int) -> DataFrame:
    """``rows`` (with place) and the columns shard, depth, shard_bytes, shard_rows, oversized."""
    found = [F.lit(None).cast(t) for t in ("int", "long", "long")]
    for k, (bits, cells) in enumerate(maps):
        names = [f"cell{k}", f"depth{k}", f"bytes{k}", f"rows{k}"]
        # Only places that the maps before left open look further; the others are spread over
        # keys that no map has.
        spread = -1 - F.pmod(F.col("place"), F.lit(1 << 20))
        at = F.when(found[0].isNull(), _cut(F.col("place"), bits)).otherwise(spread)
        rows = rows.withColumn(names[0], at).join(cells.toDF(*names), names[0], "left").drop(names[0])
        found = [F.coalesce(a, F.col(b)) for a, b in zip(found, names[1:], strict=True)]
    depth = F.coalesce(found[0], F.lit(BITS))
    rows = rows.withColumn("_depth", depth)
    bits = F.lpad(F.bin(F.expr(f"shiftright(place, {BITS} - _depth)")), F.col("_depth"), F.lit("0"))
    return rows.select(
        *(c for c in rows.columns if c in ("row", "doc_id", "bytes", "place")),
        F.when(F.col("_depth") == 0, F.lit("")).otherwise(bits).alias("shard"),
        F.col("_depth").alias("depth"),
        found[1].alias("shard_bytes"),
        found[2].alias("shard_rows"),
        found[0].isNull().alias("oversized"),
    )


def _sizes(docs: DataFrame) -> DataFrame:
    return docs.select(
        place(F.col("doc_id"), F.col("text")).alias("place"),
        text_bytes(F.col("text")).alias("bytes"),
        F.lit(1).cast("long").alias("rows"),
    )


def shard_map(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """(doc_id, bytes, place, shard, depth, shard_bytes, shard_rows, oversized) per row.

    shard_bytes and shard_rows are null for the oversized.
    """
    rows = docs.select("doc_id", *_columns())
    rows = write_once(rows, "shard-rows")
    return _assigned(rows, directory(rows.withColumn("rows", F.lit(1).cast("long")), limit), limit)


def _columns() -> list[Column]:
    return [
        place(F.col("doc_id"), F.col("text")).alias("place"),
        text_bytes(F.col("text")).alias("bytes"),
    ]


def with_shard(docs: DataFrame, limit: int = LIMIT_BYTES, name: str = "shard") -> DataFrame:
    """``docs`` with the bits of its shard in the column ``name``, which replaces one of that name."""
    sizes = write_once(_sizes(docs), "shard-rows")
    rows = row_struct(docs)
    rows = rows.withColumn("place", place(F.col("row.doc_id"), F.col("row.text")))
    found = _assigned(rows, directory(sizes, limit), limit)
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c != name]
    return found.select(*kept, F.col("shard").alias(name))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES) -> DataFrame:
    """One folder of Parquet per shard under ``path``; returns what was written, read again."""
    out = with_shard(docs, limit)
    out.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
    schema = out.schema
    return docs.sparkSession.read.schema(schema).parquet(path)
