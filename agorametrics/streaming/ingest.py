"""Ingest of raw messages into the store, as scheduled batches or as a stream.

Both count a message once it is a day old, so that reactions had time to arrive, and
both write the same tables through :func:`write_facts`.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from agorametrics import fixed_values as fixed
from agorametrics.operators import facts, inflation
from agorametrics.operators.members import cleaned_usernames, latest_usernames, refresh_due
from agorametrics.plans.joins import join_dimension
from agorametrics.plans.tables import write_once
from agorametrics.sources import store as tables
from agorametrics.sources.store import Store


# Tags of the counts and the tables they belong to.
_TABLES = {"stats": tables.STATS, "edges": tables.EDGES, "all_time": tables.ALL_TIME}


def _utc(time: dt.datetime) -> dt.datetime:
    if time.tzinfo is None:
        raise ValueError("the time needs a time zone")
    return time.astimezone(dt.timezone.utc)


class Ingested(NamedTuple):
    """What a batch wrote: its name, and its quality messages with their reactions."""

    batch: str
    total_messages: int
    total_reactions: int


def write_facts(
    messages: DataFrame,
    store: Store,
    batch: str,
    self_id: int | None = None,
    offsets: Callable[[DataFrame], DataFrame] | None = None,
    originals: DataFrame | None = None,
) -> Ingested:
    """Counts, reaction edges, quality messages and offsets of one batch, written by one job.

    So is what the batch changes in the monthly mean of the authors' ratios, for which only the
    authors that it counts are looked up.

    ``messages`` may hold several copies of an id; the newest counts. It is read once: what the
    tables need of it is written to an intermediate table, and all else comes from that.
    ``offsets`` makes the channels' offsets from the message facts. With ``originals``, messages
    carry ``reply_to_id`` in place of ``reference``, and quality messages look up there what they
    reply to. The totals are observed while the batch is written.
    """
    reply = "reference" if originals is None else "reply_to_id"
    seen = write_once(facts.message_facts(messages, self_id, reply), "message-facts")
    newest = facts.newest_copies(seen)
    quality = newest.where("quality is not null").select("quality.*")
    if originals is not None:
        quality = write_once(quality, "quality")
        quality = write_once(facts.resolve_references(quality, facts.originals_of(quality, originals)), "replies")
    quality = quality.select("*", *facts.reply_columns(F.col("reference")))
    counts = write_once(facts.tagged_counts(newest), "counts")
    added = facts.stats_of(counts)
    # What the batch itself left in an earlier try is not there before it.
    before = store.batches(tables.STATS).where(F.col("batch") != batch)
    changes = write_once(inflation.rpm_changes(before, added), "changes")
    rows = counts.replace(_TABLES, subset=["tag"]).withColumnRenamed("tag", "kind")
    rows = rows.unionByName(tables.as_facts(tables.RPM_CHANGES, changes), allowMissingColumns=True)
    rows = rows.unionByName(tables.as_facts(tables.MESSAGES, quality))
    if offsets is not None:
        rows = rows.unionByName(tables.as_facts(tables.OFFSETS, offsets(seen)))
    of_quality = F.col("kind") == tables.MESSAGES
    totals = store.write(
        rows,
        batch,
        total_messages=F.count_if(of_quality),
        total_reactions=F.coalesce(F.sum(F.when(of_quality, F.col("n"))), F.lit(0)),
    )
    return Ingested(batch, totals["total_messages"], totals["total_reactions"])


def ingest_increment(
    raw: DataFrame,
    channels: DataFrame,
    store: Store,
    as_of: dt.datetime,
    self_id: int | None = None,
    originals: DataFrame | None = None,
) -> Ingested:
    """Ingest what became a day old since the last run.

    Batches are numbered; a batch and the offsets it reaches are written by one job. So after a run
    that failed, the next one, with the same or a later ``as_of``, starts from the same offsets and
    has the same number: it replaces what the failed one may have left. A repeated run, or one for
    an earlier time than the last, finds nothing beyond the offsets.
    """
    cutoff = _utc(as_of) - dt.timedelta(days=1)
    channels = write_once(channels, "channels")
    scanned = facts.unscanned(raw, channels, store.scan_offsets(), cutoff)
    offsets = lambda seen: facts.next_offsets(seen, channels, cutoff)
    return write_facts(scanned, store, store.next_batch(), self_id, offsets, originals)


def refresh_usernames(members: DataFrame, store: Store, as_of: dt.datetime) -> str | None:
    """Bring the usernames of all members up to date, at most once a day.

    The new snapshot holds the members of now and those who left, so readers read that one only.
    Returns its label, or None if the last refresh was less than a day ago.
    """
    as_of = _utc(as_of)
    label = as_of.strftime("%Y%m%dT%H%M%S.%f")
    seconds = store.batches(tables.MAPPING).agg(F.max("last_updated").cast("double")).first()[0]
    last = None if seconds is None else dt.datetime.fromtimestamp(seconds, dt.timezone.utc)
    if not refresh_due(last, as_of):
        return None
    known = store.batches(tables.MAPPING).drop("batch")
    snapshot = latest_usernames(known.unionByName(cleaned_usernames(members, as_of)))
    store.replace({tables.MAPPING: snapshot}, label)
    return label


def repopulate(raw: DataFrame, channels: DataFrame, store: Store, as_of: dt.datetime) -> str:
    """Count what has been ingested so far anew and replace the stored months by that.

    These are the messages of readable channels up to each channel's offset, so the next
    increment goes on behind them. Bots are left out, and what came before the fixed date is
    dropped. All-time reactions and quality messages stay as they are. The messages are read once:
    both counts come from what is written of them.
    """
    label = "repopulated-" + _utc(as_of).strftime("%Y%m%dT%H%M%S.%f")
    done = write_once(facts.readable_channels(channels).join(store.scan_offsets(), "channel_id"), "channels")
    readable = join_dimension(raw, done, "channel_id", "id")
    readable = readable.where(F.col("created_at") <= F.col("last_scanned")).drop("last_scanned")
    seen = facts.message_facts(readable, reply="id", skip_bots=True).drop("quality", "channel_id")
    newest = facts.newest_copies(write_once(seen, "message-facts"))
    newest = newest.where(F.col("created_at") > F.lit(fixed.REPOPULATE_START))
    counts = write_once(facts.tagged_counts(newest, all_time=False), "repopulated")
    stats, edges = facts.stats_of(counts), facts.edges_of(counts)
    changes = inflation.rpm_changes(stats.limit(0), stats)
    store.replace({tables.STATS: stats, tables.RPM_CHANGES: changes, tables.EDGES: edges}, label)
    return label


def settled_messages(
    stream: DataFrame, delay: str = fixed.SETTLING_DELAY, pane: str = "1 hour"
) -> DataFrame:
    """Messages of a stream once they are older than the delay, one row per id.

    A message is held in a pane of event time and released when the watermark passes
    the end of the pane; copies that arrive meanwhile replace each other, and later ones
    are dropped. The state holds one delay of messages, not the history.
    """
    columns = [c for c in stream.columns if c != "id"]
    newest = F.max_by(F.struct(*columns), "fetched_at").alias("copy")
    return (
        stream.withWatermark("created_at", delay)
        .groupBy(F.window("created_at", pane), "id")
        .agg(newest)
        .select("id", "copy.*")
    )


def start_stream(
    stream: DataFrame,
    store: Store,
    checkpoint: str,
    name: str,
    self_id: int | None = None,
    every: str | None = None,
    channels: DataFrame | None = None,
    on_batch: Callable[[Ingested], None] | None = None,
) -> StreamingQuery:
    """Ingest a stream of raw messages; without ``every``, what is available now.

    The held messages are kept in as many parts as the session of ``stream`` has shuffle
    partitions, which cannot change during the life of a checkpoint; ``stream_session`` makes a
    session for that. With ``channels``, messages of channels that can't be read are left out.
    ``on_batch`` is told what each micro-batch wrote.

    Micro-batches are named by stream name and batch id. A replayed micro-batch has the same rows
    and the same id and replaces what it left, so each message counts exactly once. The last message
    of each channel is written as its offset, so scheduled runs go on from there. A stream that
    starts over with a new checkpoint needs a new name.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if channels is not None:
            batch = join_dimension(batch, facts.readable_channels(channels), "channel_id", "id")
        last = F.max("created_at").alias("last_scanned")
        offsets = lambda seen: seen.groupBy("channel_id").agg(last)
        done = write_facts(batch, store, f"{name}-{batch_id:012d}", self_id, offsets)
        if on_batch is not None:
            on_batch(done)

    writer = (
        settled_messages(stream)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .queryName(name)
        .foreachBatch(write)
    )
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
