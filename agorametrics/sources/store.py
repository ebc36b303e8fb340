"""The stored tables: one parquet table of additive facts, partitioned by table, batch and month.

Every ingest run or micro-batch writes all its tables in one job, to
``facts/kind=<table>/batch=<batch>/year=.../month=...``, by dynamic partition overwrite: a batch
that is written again replaces itself, and touches nothing else. What a failed job wrote stays in
hidden folders until the job commits, so counts and the offsets behind them show up together.
Readers add the batches up; month filters prune folders, and files are sorted by user. Batches are
numbered or named by whoever writes them; a store has one writer at a time.

Compaction, repopulation, the username snapshot and the reset replace whole tables. They are
staged in full before they replace anything; the step between is not atomic, so run them while
nobody reads, and again if they fail.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agorametrics import fixed_values as fixed
from agorametrics import schemas
from agorametrics.functions.months import from_month, month_keys, utc_wall
from agorametrics.operators.facts import newest_copies
from agorametrics.operators.members import latest_usernames
from agorametrics.plans.tables import write_once

STATS = "user_stats_monthly"
EDGES = "user_reactions_monthly"
ALL_TIME = "user_reactions"
MAPPING = "user_mapping"
MESSAGES = "messages"
OFFSETS = "scan_offsets"
RPM_CHANGES = "rpm_changes"

# How the columns of each table are called in the facts.
_NAMES = {
    STATS: {"author_id": "a", "total_messages": "n", "total_reactions": "reactions"},
    EDGES: {"giver_id": "a", "receiver_id": "b", "reaction_count": "n"},
    ALL_TIME: {"giver_id": "a", "receiver_id": "b", "reaction_count": "n"},
    MAPPING: {"author_id": "a", "username": "content", "last_updated": "ts"},
    OFFSETS: {"channel_id": "a", "last_scanned": "ts"},
    RPM_CHANGES: {"ratios": "x", "authors": "n"},
    MESSAGES: {"id": "a", "author_id": "b", "reaction_count": "n", "fetched_at": "seen"}
    | {c: c for c in ("content", "ts", "reply_to_id", "reply_to_author", "reply_to_content")},
}
# Ids that are searched for; files have bloom filters on them, so a search reads only row groups
# that hold the id.
_LOOKED_UP = ("a", "b")
_MONTHLY = {STATS, EDGES, MESSAGES, RPM_CHANGES}
_STORED = T.StructType([*schemas.FACTS.fields, *schemas.FACT_KEYS.fields])
MESSAGE_COLUMNS = [f.name for f in schemas.MESSAGES.fields if f.name != "id"]
# Facts that one task sorts and writes, some 200 bytes each.
TASK_ROWS = 500_000
_BATCH = re.compile(r"[A-Za-z0-9_.\-]+")


def as_facts(table: str, rows: DataFrame) -> DataFrame:
    """``rows`` of one table as facts, to be written with those of others."""
    names = {stored: F.col(c) for c, stored in _NAMES[table].items() if c in rows.columns}
    values = [names.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.FACTS.fields]
    keys = [F.lit(0).alias("year"), F.lit(0).alias("month")]
    if table in _MONTHLY:
        keys = month_keys(F.col("ts")) if table == MESSAGES else [F.col("year"), F.col("month")]
    return rows.select(*values, F.lit(table).alias("kind"), *keys)


class Store:
    """All stored tables below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.facts = root.rstrip("/") + "/facts"

    def write(self, facts: DataFrame, batch: str, **observed: Column) -> dict[str, int]:
        """Write a batch of facts in one job; returns the ``observed`` aggregates of what was written.

        The facts are counted first, so they should come from written tables.
        """
        return self._write(facts, batch, self.facts, "dynamic", observed)

    def put(self, table: str, rows: DataFrame, batch: str) -> None:
        """Write ``rows`` as the batch's part of one table."""
        self.write(write_once(as_facts(table, rows), "staged"), batch)

    def replace(self, tables: dict[str, DataFrame], batch: str) -> None:
        """Replace all that ``tables`` hold; the rows may come from what they replace."""
        if not _BATCH.fullmatch(batch):
            raise ValueError(f"unusable batch name {batch!r}")
        staged = {table: write_once(as_facts(table, rows), "staged") for table, rows in tables.items()}
        for table, facts in staged.items():
            self._write(facts.drop("kind"), batch, f"{self.facts}/kind={table}", "static", {})

    @staticmethod
    def _write(facts: DataFrame, batch: str, path: str, mode: str, observed: dict[str, Column]) -> dict[str, int]:
        if not _BATCH.fullmatch(batch):
            raise ValueError(f"unusable batch name {batch!r}")
        keys = [c for c in ("kind", "batch", "year", "month") if c in [*facts.columns, "batch"]]
        # Few files per month, and several tasks for a month with many rows: facts are mostly nulls, so
        # a task's share goes by rows, not by the bytes shuffled. What is observed comes after the last
        # shuffle, where a repeated task counts once.
        tasks = max(1, -(-facts.count() // TASK_ROWS))
        rows = facts.withColumn("batch", F.lit(batch)).repartitionByRange(tasks, *keys, "a", "b")
        rows = rows.sortWithinPartitions(*keys, "a")
        seen = None
        if observed:
            seen = Observation()
            rows = rows.observe(seen, *(c.alias(name) for name, c in observed.items()))
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*keys)
        for name in _LOOKED_UP:
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
        writer.parquet(path)
        return seen.get if seen else {}

    def batches(self, table: str) -> DataFrame:
        """All rows as written, with their batch; monthly tables with year and month."""
        try:
            reader = self.spark.read.schema(_STORED).option("basePath", self.facts)
            rows = reader.parquet(f"{self.facts}/kind={table}")
        except AnalysisException:  # nothing written yet
            rows = self.spark.createDataFrame([], _STORED)
        months = ["year", "month"] if table in _MONTHLY else []
        return rows.select(*(F.col(stored).alias(c) for c, stored in _NAMES[table].items()), *months, "batch")

    def next_batch(self) -> str:
        """A number for the next scheduled batch; the same again if that one is not written."""
        numbers = self.batches(OFFSETS).where(F.col("batch").rlike("^[0-9]{8}$"))
        last = numbers.agg(F.max("batch")).first()[0]
        return f"{int(last or 0) + 1:08d}"

    def reset(self) -> None:
        """Empty the author months and the all-time reactions; all else stays."""
        self.replace({table: self.batches(table).limit(0) for table in (STATS, RPM_CHANGES, ALL_TIME)}, "reset")

    def _sums(self, table: str, *keys: str) -> DataFrame:
        sums = [c for c, stored in _NAMES[table].items() if stored in ("n", "reactions")]
        return self.batches(table).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))

    def user_stats_monthly(self) -> DataFrame:
        return self._sums(STATS, "author_id", "year", "month")

    def user_reactions_monthly(self) -> DataFrame:
        return self._sums(EDGES, "giver_id", "receiver_id", "year", "month")

    def user_reactions(self) -> DataFrame:
        return self._sums(ALL_TIME, "giver_id", "receiver_id")

    def user_mapping(self) -> DataFrame:
        return latest_usernames(self.batches(MAPPING))

    def messages(
        self,
        columns: Sequence[str] = MESSAGE_COLUMNS,
        ids: DataFrame | None = None,
        since: tuple[int, int] | None = None,
    ) -> DataFrame:
        """One row per id; of an id in several batches the copy fetched last counts.

        Ask for the ``columns`` needed only: the others are then not read. ``ids(id)``, a
        written table of a few rows, picks messages where they are read; ``since`` is the first
        (year, month) to read.
        """
        rows = self.batches(MESSAGES)
        if since is not None:
            rows = rows.where(from_month(*since))
        if ids is not None:
            rows = rows.join(ids.select("id"), "id", "left_semi")
        order = F.struct("fetched_at", "batch").alias("order")
        kept = dict.fromkeys(["id", *columns])
        return newest_copies(rows.select(*kept, order), "order").select(*kept)

    def scan_offsets(self) -> DataFrame:
        """Last scanned time per channel over all batches."""
        return self.batches(OFFSETS).groupBy("channel_id").agg(F.max("last_scanned").alias("last_scanned"))

    def metadata(self) -> DataFrame:
        """The offsets as a key/value table."""
        return self.scan_offsets().select(
            F.concat(F.lit(fixed.OFFSET_KEY_PREFIX), F.col("channel_id").cast("string")).alias("key"),
            F.date_format(utc_wall(F.col("last_scanned")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias(
                "value"
            ),
        )

    def _summed(self) -> dict[str, DataFrame]:
        return {
            STATS: self.user_stats_monthly(),
            EDGES: self.user_reactions_monthly(),
            ALL_TIME: self.user_reactions(),
            MAPPING: self.user_mapping(),
            MESSAGES: self.messages([*MESSAGE_COLUMNS, "fetched_at"]),
            OFFSETS: self.scan_offsets(),
            RPM_CHANGES: self.batches(RPM_CHANGES).groupBy("year", "month").agg(
                F.sum("ratios").alias("ratios"), F.sum("authors").alias("authors")
            ),
        }

    def compact(self) -> None:
        """Add all batches up into one, in place, under the number of the last; ingest goes on behind it."""
        self.replace(self._summed(), f"{int(self.next_batch()) - 1:08d}")

    def compacted(self, root: str) -> Store:
        """A copy with all batches added up into one, at another root, to go on with."""
        copy = Store(self.spark, root)
        copy.replace(self._summed(), f"{int(self.next_batch()) - 1:08d}")
        return copy
