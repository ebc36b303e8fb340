"""From raw messages to facts: counts per author, reaction edges, quality messages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorametrics import fixed_values as fixed
from agorametrics.functions.months import month_keys
from agorametrics.functions.text import is_blank, is_valid_message
from agorametrics.plans.joins import MAX_BROADCAST_ROWS, join_dimension
from agorametrics.plans.tables import write_once
from agorametrics.schemas import REACTIONS


def readable_channels(channels: DataFrame) -> DataFrame:
    return channels.where("can_read").select("channel_id")


def reaction_total(reactions: Column) -> Column:
    """Reactions on a message over all emoji, bots included."""
    return F.aggregate(
        F.coalesce(reactions, F.array().cast(REACTIONS)),
        F.lit(0).cast("bigint"),
        lambda total, reaction: total + reaction["count"],
    )


def unscanned(
    raw: DataFrame, channels: DataFrame, offsets: DataFrame, cutoff: dt.datetime
) -> DataFrame:
    """Messages of readable channels after each channel's offset and before the cutoff.

    Both bounds are exclusive. Channels without an offset start at the fixed first date.
    """
    starts = readable_channels(channels).join(offsets, "channel_id", "left").select(
        "channel_id", F.coalesce("last_scanned", F.lit(fixed.SCAN_START)).alias("last_scanned")
    )
    # The earliest offset bounds the scan, so old files are skipped.
    earliest = starts.agg(F.min("last_scanned")).scalar()
    created = F.col("created_at")
    candidates = raw.where((created < F.lit(cutoff)) & (created > earliest))
    return (
        join_dimension(candidates, starts, "channel_id", "id")
        .where(F.col("created_at") > F.col("last_scanned"))
        .drop("last_scanned")
    )


def next_offsets(scanned: DataFrame, channels: DataFrame, cutoff: dt.datetime) -> DataFrame:
    """Time of the last message seen per readable channel, skipped messages included.

    A channel in which nothing was seen moves on to the cutoff.
    """
    last = scanned.groupBy("channel_id").agg(F.max("created_at").alias("seen"))
    return readable_channels(channels).join(last, "channel_id", "left").select(
        "channel_id", F.coalesce("seen", F.lit(cutoff)).alias("last_scanned")
    )


def offset_for(offsets: DataFrame, channel_id: int) -> DataFrame:
    """Point lookup of one channel's offset; no row when it was never scanned."""
    return offsets.where(F.col("channel_id") == channel_id).select("last_scanned")


def newest_copies(rows: DataFrame, at: str = "fetched_at") -> DataFrame:
    """One row per id, the copy with the newest ``at``; of equally new ones any.

    Only ids and times are shuffled to find the ids with several copies, which are few. All rows
    then pass by these, broadcast if they are few enough and else joined, and older copies are
    dropped where they are. Only copies of one id that are equally new are brought together.
    """
    several = rows.groupBy("id").agg(F.count("*").alias("copies"), F.max(at).alias("newest")).where("copies > 1")
    several = write_once(several.select("id", "newest"), "repeated-ids")
    n = several.count()
    if not n:
        return rows
    known = several.toDF("_id", "_newest")
    several = F.broadcast(known) if n <= MAX_BROADCAST_ROWS else known
    kept = rows.join(several, F.col("id") == F.col("_id"), "left")
    kept = kept.where(F.col("_id").isNull() | F.col(at).eqNullSafe(F.col("_newest")))
    alike = kept.where("_id is not null").groupBy("id").agg(F.count("*").alias("copies")).where("copies > 1")
    alike = write_once(alike.select(F.col("id").alias("_alike")), "alike-ids")
    kept = kept.drop("_id", "_newest")
    n = alike.count()
    if not n:
        return kept
    few = F.broadcast(alike) if n <= MAX_BROADCAST_ROWS else alike
    single = kept.join(few, F.col("id") == F.col("_alike"), "left_anti")
    columns = [c for c in rows.columns if c != "id"]
    one = kept.join(few, F.col("id") == F.col("_alike"), "left_semi").groupBy("id")
    return single.unionByName(one.agg(F.first(F.struct(*columns)).alias("copy")).select("id", "copy.*"))


def counted_messages(raw: DataFrame, self_id: int | None = None, skip_bots: bool = False) -> DataFrame:
    """Messages that count: not blank, not our own, and on request not from any bot."""
    kept = raw.where(~is_blank(F.col("content")))
    if self_id is not None:
        kept = kept.where(F.col("author.id") != self_id)
    if skip_bots:
        kept = kept.where(~F.coalesce("author.bot", F.lit(False)))
    return kept


def author_months(messages: DataFrame) -> DataFrame:
    """Messages and reactions per author and calendar month."""
    return author_months_from_counts(
        messages.select(
            F.col("author.id").alias("author_id"),
            reaction_total(F.col("reactions")).alias("reaction_count"),
            F.col("created_at").alias("ts"),
        )
    )


def author_months_from_counts(counts: DataFrame) -> DataFrame:
    """The same from one row per message: ``(author_id, reaction_count, ts)``."""
    return (
        counts.select("author_id", *month_keys(F.col("ts")), "reaction_count")
        .groupBy("author_id", "year", "month")
        .agg(
            F.count("*").alias("total_messages"), F.sum("reaction_count").alias("total_reactions")
        )
    )


def reaction_events(messages: DataFrame) -> DataFrame:
    """One row per person who reacted with an emoji; bots do not count."""
    return (
        messages.select(
            F.col("author.id").alias("receiver_id"),
            "created_at",
            F.explode("reactions").alias("reaction"),
        )
        .select("receiver_id", "created_at", "reaction.emoji", F.explode("reaction.users").alias("user"))
        .where(~F.coalesce("user.bot", F.lit(False)))
        .select(F.col("user.id").alias("giver_id"), "receiver_id", "emoji", "created_at")
    )


def reaction_months(events: DataFrame) -> DataFrame:
    """Reactions per giver, receiver and calendar month."""
    return (
        events.select("giver_id", "receiver_id", *month_keys(F.col("created_at")))
        .groupBy("giver_id", "receiver_id", "year", "month")
        .agg(F.count("*").alias("reaction_count"))
    )


def all_time_reactions(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("giver_id", "receiver_id").agg(
        F.sum("reaction_count").alias("reaction_count")
    )


def reply_columns(reference: Column) -> list[Column]:
    """Id, author and content of the message replied to; all NULL for other messages."""
    deleted = F.coalesce(reference["deleted"], F.lit(False))
    author = F.when(deleted, fixed.DELETED_AUTHOR).otherwise(
        F.coalesce(reference["author"], F.lit(fixed.UNKNOWN_AUTHOR))
    )
    content = F.when(deleted, fixed.DELETED_CONTENT).otherwise(
        F.coalesce(reference["content"], F.lit(fixed.MISSING_CONTENT))
    )
    return [
        reference["id"].alias("reply_to_id"),
        F.when(reference.isNotNull(), author).alias("reply_to_author"),
        F.when(reference.isNotNull(), content).alias("reply_to_content"),
    ]


def resolve_references(messages: DataFrame, originals: DataFrame, reply_to: str = "reply_to_id") -> DataFrame:
    """Add ``reference`` to messages that only carry the id they reply to.

    Messages that reply to nothing would all meet on the NULL key, so they get a second
    key from their own id, which spreads them and matches nothing.
    """
    no_reply = F.col(reply_to).isNull()
    left = messages.withColumn("_lane", F.when(no_reply, F.xxhash64("id")).otherwise(F.lit(0)))
    right = originals.select(
        F.col("id").alias("_id"),
        F.lit(0).cast("bigint").alias("_key"),
        F.col("author.display_name").alias("_author"),
        F.col("content").alias("_content"),
    )
    found = F.col("_id").isNotNull()
    reference = F.when(
        ~no_reply,
        F.struct(
            F.col(reply_to).alias("id"),
            (~found).alias("deleted"),
            F.col("_author").alias("author"),
            F.col("_content").alias("content"),
        ),
    )
    joined = left.join(
        right, (F.col(reply_to) == F.col("_id")) & (F.col("_lane") == F.col("_key")), "left"
    )
    return joined.withColumn("reference", reference).drop(
        "_lane", "_id", "_key", "_author", "_content", reply_to
    )


def is_quality(content: Column, total: Column) -> Column:
    return (total >= fixed.QUALITY_MIN_REACTIONS) & is_valid_message(content)


def originals_of(replies: DataFrame, originals: DataFrame) -> DataFrame:
    """The newest copy of each message that ``replies``, a written table, reply to."""
    wanted = replies.where("reply_to_id is not null").select(F.col("reply_to_id").alias("id")).distinct()
    newest = F.max_by(F.struct("author", "content"), "fetched_at").alias("copy")
    found = originals.select("id", "author", "content", "fetched_at").join(wanted, "id", "left_semi")
    return found.groupBy("id").agg(newest).select("id", "copy.*")


def quality_messages(messages: DataFrame) -> DataFrame:
    """Well-received messages with valid content, and what they reply to."""
    total = reaction_total(F.col("reactions"))
    return (
        messages.where(is_quality(F.col("content"), total))
        .select(
            "id",
            "content",
            F.col("created_at").alias("ts"),
            total.alias("reaction_count"),
            F.col("author.id").alias("author_id"),
            *reply_columns(F.col("reference")),
        )
    )


def message_facts(
    messages: DataFrame, self_id: int | None = None, reply: str = "reference", skip_bots: bool = False
) -> DataFrame:
    """What the stored tables need of each message, and no more.

    ``(id, channel_id, fetched_at, counted, author_id, created_at, reaction_count, givers, quality)``:
    whether the message counts, the people behind its reactions, and for a quality message that
    counts its own columns with ``reply``, as it is in ``messages``. On request no bot's message counts.
    """
    # A column of its own, so that it is added up once a message.
    messages = messages.withColumn("_total", reaction_total(F.col("reactions")))
    total = F.col("_total")
    none = F.array().cast("array<bigint>")
    people = lambda users: F.filter(users, lambda u: ~F.coalesce(u["bot"], F.lit(False)))
    givers = F.flatten(
        F.transform(
            "reactions",
            lambda r: F.coalesce(F.transform(people(r["users"]), lambda u: u["id"]), none),
        )
    )
    counted = F.coalesce(~is_blank(F.col("content")), F.lit(False))
    if self_id is not None:
        counted = counted & F.coalesce(F.col("author.id") != self_id, F.lit(False))
    if skip_bots:
        counted = counted & ~F.coalesce("author.bot", F.lit(False))
    quality = F.struct(
        "id",
        "content",
        F.col("created_at").alias("ts"),
        total.alias("reaction_count"),
        F.col("author.id").alias("author_id"),
        "fetched_at",
        F.col(reply),
    )
    return messages.select(
        "id",
        "channel_id",
        "fetched_at",
        counted.alias("counted"),
        F.col("author.id").alias("author_id"),
        "created_at",
        total.alias("reaction_count"),
        F.coalesce(givers, none).alias("givers"),
        F.when(counted & is_quality(F.col("content"), total), quality).alias("quality"),
    )


def tagged_counts(messages: DataFrame, all_time: bool = True) -> DataFrame:
    """Author months, reaction months and all-time reactions from one pass over message facts.

    ``(tag, a, b, year, month, n, reactions)``: a message gives a row to its author's month, and
    each reaction one to its giver and receiver, with and without the month. All are added up by
    one shuffle; ``all_time`` reactions can be left out.
    """
    year, month = month_keys(F.col("created_at"))

    def row(tag: str, a: Column, b: Column, monthly: bool, reactions: Column) -> Column:
        return F.struct(
            F.lit(tag).alias("tag"),
            a.cast("bigint").alias("a"),
            b.cast("bigint").alias("b"),
            (F.col("year") if monthly else F.lit(0)).alias("year"),
            (F.col("month") if monthly else F.lit(0)).alias("month"),
            reactions.cast("bigint").alias("reactions"),
        )

    author, no = F.col("author_id"), F.lit(None)
    own = F.array(row("stats", author, no, True, F.col("reaction_count")))
    monthly = F.transform("givers", lambda giver: row("edges", giver, author, True, no))
    parts = [own, monthly]
    if all_time:
        parts.append(F.transform("givers", lambda giver: row("all_time", giver, author, False, no)))
    rows = messages.where("counted").select(year, month, "author_id", "reaction_count", "givers")
    rows = rows.select(F.inline(F.concat(*parts)))
    return rows.groupBy("tag", "a", "b", "year", "month").agg(
        F.count("*").alias("n"), F.sum("reactions").alias("reactions")
    )


def stats_of(counts: DataFrame) -> DataFrame:
    """The author months among tagged counts."""
    return counts.where("tag = 'stats'").select(
        F.col("a").alias("author_id"), "year", "month", F.col("n").alias("total_messages"), F.col("reactions").alias("total_reactions")
    )


def edges_of(counts: DataFrame) -> DataFrame:
    """The reaction months among tagged counts."""
    return counts.where("tag = 'edges'").select(
        F.col("a").alias("giver_id"), F.col("b").alias("receiver_id"), "year", "month", F.col("n").alias("reaction_count")
    )


def ingest_totals(messages: DataFrame) -> DataFrame:
    """Quality messages and their reactions over all channels, one row."""
    total = reaction_total(F.col("reactions"))
    kept = messages.where(is_quality(F.col("content"), total))
    return kept.agg(
        F.count("*").alias("total_messages"),
        F.coalesce(F.sum(total), F.lit(0).cast("bigint")).alias("total_reactions"),
    )


def repopulated(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Author months and reaction months recomputed since the fixed date, without bots.

    ``raw`` has one row per message.
    """
    messages = counted_messages(
        raw.where(F.col("created_at") > F.lit(fixed.REPOPULATE_START)), skip_bots=True
    )
    return author_months(messages), reaction_months(reaction_events(messages))
