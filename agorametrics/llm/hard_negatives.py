"""Hard negatives by a secondary-sort shuffle.

An anchor's rows are ordered by falling score, ties by id. Its first rows of the same label are its
positives; each opens a window of scores, and the first rows of other labels inside the window are
that positive's hard negatives.

All rows are scored against the anchors in blocks of rows and blocks of anchors, twice. A block of
rows gives, for each anchor, only what can still count: first its best rows of the same label, then,
with the positives known, the best rows of other labels in each of the anchor's windows. What is
left is packed into keys (anchor, falling score, kind, id) and shuffled by
``repartitionAndSortWithinPartitions``, so an anchor's rows arrive in order. The iterator over them
opens a window when a positive passes and emits negatives as they come; it holds the open windows
of one anchor and nothing else.

Defined cases: rows with a null id, label or vector, or with null or non-finite components, take
no part, and neither do vectors of another length than the most frequent; an anchor without rows of
its label, or without rows in a window, gives no rows for it; positives of negative score have no
window. Of rows that share an anchor's id the smallest (label, vector) is the anchor; rows with the
anchor's id are never its positives or negatives; rows that repeat any other id count each. Labels
are only compared. An empty table gives no rows. Products are exact while scores stay below 2^53.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorametrics.llm.common import BROADCAST_BYTES
from agorametrics.llm.vectors import matrix, whole_vectors
from agorametrics.plans.tables import write_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

POSITIVES = 5
NEGATIVES = 3
# A negative's score lies between these shares of the positive's, as (numerator, denominator).
LOW, HIGH = (50, 100), (95, 100)
ROWS = 4096
ANCHORS = 512
# Rows that meet one copy of the anchors.
ROWS_A_TILE = 1 << 16

BLOCK = "tile int, ids binary, labels binary, x binary, kind string, windows binary"
RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)
# Kinds of a packed key; of equal scores, positives come first.
POSITIVE, NEGATIVE = 0, 1
_KEY = ">QQBQ"
_SIGN = 1 << 63


def pack(anchor: int, score: int, kind: int, row: int) -> bytes:
    """A key whose bytes sort by anchor, falling score, kind and id."""
    return struct.pack(_KEY, anchor + _SIGN, _SIGN - 1 - score, kind, row + _SIGN)


def unpack(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, row = struct.unpack(_KEY, key)
    return anchor - _SIGN, _SIGN - 1 - score, kind, row - _SIGN


def _packed(rows: DataFrame, size: int, tiles: int) -> DataFrame:
    """Blocks of up to ``size`` rows (vec_id, label, x, maybe windows), made where the rows are."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("tile", pa.int32()), *((c, pa.binary()) for c in ("ids", "labels", "x")), ("kind", pa.string()), ("windows", pa.binary())]
        )
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = matrix(part.column("x"))
                x = x.astype(np.result_type(np.min_scalar_type(x.min()), np.min_scalar_type(x.max()), np.int8))
                ids = part.column("vec_id").to_numpy()
                windows = b""
                if "windows" in batch.schema.names:
                    windows = matrix(part.column("windows")).astype(np.int64).tobytes()
                row = {
                    "tile": hash((int(ids[0]), int(ids[-1]))) % tiles,
                    "ids": ids.astype(np.int64).tobytes(),
                    "labels": part.column("label").to_numpy().astype(np.int64).tobytes(),
                    "x": x.tobytes(),
                    "kind": x.dtype.str,
                    "windows": windows,
                }
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return rows.mapInArrow(blocks, BLOCK)


def _scores(row) -> tuple[np.ndarray, ...]:
    """(ids, labels, anchor ids, anchor labels, scores by anchor and row) of two blocks."""
    ids, labels = (np.frombuffer(b, dtype=np.int64) for b in (row.ids, row.labels))
    anchors, of = (np.frombuffer(b, dtype=np.int64) for b in (row.a_ids, row.a_labels))
    x = np.frombuffer(row.x, dtype=row.kind).reshape(len(ids), -1).astype(np.float64)
    a = np.frombuffer(row.a_x, dtype=row.a_kind).reshape(len(anchors), -1).astype(np.float64)
    return ids, labels, anchors, of, (a @ x.T).astype(np.int64)


def first_rows(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` rows by falling score, ties by id."""
    places = np.arange(len(scores))
    if len(scores) > most:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        places = np.flatnonzero(scores >= least)
    return places[np.lexsort((ids[places], -scores[places]))[:most]]


def _best_positives(rows: Iterator, most: int) -> Iterator[tuple[bytes, None]]:
    for row in rows:
        ids, labels, anchors, of, scores = _scores(row)
        for k, anchor in enumerate(anchors):
            own = np.flatnonzero((labels == of[k]) & (ids != anchor))
            for j in own[first_rows(scores[k, own], ids[own], most)]:
                yield pack(int(anchor), int(scores[k, j]), POSITIVE, int(ids[j])), None


def _best_negatives(rows: Iterator, most: int, low: tuple, high: tuple) -> Iterator[tuple[bytes, None]]:
    for row in rows:
        ids, labels, anchors, of, scores = _scores(row)
        windows = np.frombuffer(row.a_windows, dtype=np.int64).reshape(len(anchors), -1)
        for k, anchor in enumerate(anchors):
            others = np.flatnonzero((labels != of[k]) & (ids != anchor))
            found, of_others = set(), scores[k, others]
            for positive in np.unique(windows[k]):
                if positive < 0:
                    continue
                inside = (low[0] * positive <= low[1] * of_others) & (high[1] * of_others <= high[0] * positive)
                inside = others[inside]
                found.update(inside[first_rows(scores[k, inside], ids[inside], most)].tolist())
            for j in found:
                yield pack(int(anchor), int(scores[k, j]), NEGATIVE, int(ids[j])), None


def _in_order(keys: RDD, parts: int) -> RDD:
    """``keys`` partitioned by anchor and sorted by all that they pack."""

    def of_anchor(key: bytes) -> int:
        return int.from_bytes(key[:8], "big") * 0x9E3779B97F4A7C15 >> 40 & 0xFFFFFF

    return keys.repartitionAndSortWithinPartitions(parts, of_anchor)


def _first_of_each(keys: Iterator, most: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, positive, score) of the first ``most`` keys of each anchor."""
    now, n = None, 0
    for key, _ in keys:
        anchor, score, _, row = unpack(key)
        now, n = anchor, n + 1 if anchor == now else 1
        if n <= most:
            yield anchor, row, score


def emitted(keys: Iterator, most: int, low: tuple, high: tuple) -> Iterator[tuple]:
    """Streams over sorted keys; a positive opens a window, negatives are emitted as they pass."""
    now, windows = None, []
    for key, _ in keys:
        anchor, score, kind, row = unpack(key)
        if anchor != now:
            now, windows = anchor, []
        if kind == POSITIVE:
            windows.append([row, score, 0])
            continue
        for window in windows:
            positive, of, n = window
            if n < most and low[0] * of <= low[1] * score and high[1] * score <= high[0] * of:
                window[2] = n + 1
                yield anchor, positive, n + 1, row, of, score


def _with_anchors(blocks: DataFrame, anchors: DataFrame, tiles: int) -> DataFrame:
    """Each block of rows beside each block of anchors; the anchors are copied to each tile."""
    names = [F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "x", "kind", "windows")]
    copies = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), *names)
    held = anchors.agg(F.sum(F.octet_length("x") + F.octet_length("ids") * 7)).first()[0] or 0
    small = held * tiles <= BROADCAST_BYTES
    return blocks.join(F.broadcast(copies) if small else copies.hint("merge"), "tile")


def hard_negatives(
    embeddings: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: tuple[int, int] = LOW,
    high: tuple[int, int] = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` tells the anchors, and ``label`` the label, from vec_id and label.
    """
    spark = embeddings.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    label = F.col("label") if label is None else label
    rows = embeddings.where("vec_id is not null and label is not null")
    rows = rows.select("vec_id", label.cast("long").alias("label"), "embedding")
    rows = whole_vectors(rows, "vec_id", "label")
    anchors = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row"))
    anchors = write_once(anchors.select("vec_id", "row.label", "row.x"), "anchors")

    tiles = max(1, rows.count() // ROWS_A_TILE)
    blocks = write_once(_packed(rows, ROWS, tiles), "row-blocks")
    pairs = _with_anchors(blocks, _packed(anchors, ANCHORS, tiles), tiles)
    keys = pairs.rdd.mapPartitions(lambda it: _best_positives(it, positives))
    first = _in_order(keys, parts).mapPartitions(lambda it: _first_of_each(it, positives))
    found = spark.createDataFrame(first, "vec_id long, positive long, score long", verifySchema=False)
    found = write_once(found, "positives")

    scores = found.groupBy("vec_id").agg(F.array_sort(F.collect_list("score")).alias("windows"))
    full = F.concat("windows", F.array_repeat(F.lit(-1).cast("long"), F.lit(positives) - F.size("windows")))
    known = anchors.join(scores.select("vec_id", full.alias("windows")), "vec_id")
    pairs = _with_anchors(blocks, write_once(_packed(known, ANCHORS, tiles), "anchor-blocks"), tiles)
    keys = pairs.rdd.mapPartitions(lambda it: _best_negatives(it, negatives, low, high))
    opened = found.rdd.map(lambda r: (pack(r.vec_id, r.score, POSITIVE, r.positive), None))
    ordered = _in_order(keys.union(opened), parts)
    out = ordered.mapPartitions(lambda it: emitted(it, negatives, low, high))
    return spark.createDataFrame(out, RESULT, verifySchema=False)
