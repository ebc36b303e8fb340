"""Every check query, each next to SQL that gives the same rows.

Doubles are rounded to six digits on both sides: sums of doubles may differ in the last
place between engines.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agorametrics.functions import text
from agorametrics.operators import (
    activity,
    clusters,
    facts,
    inflation,
    influence,
    matrix,
    sampling,
    trade,
    volume,
)
from agorametrics.operators import members as people
from agorametrics.plans.tables import new_folder, write_once
from agorametrics.session import stream_session
from agorametrics.sources import history, quotes
from agorametrics.sources import store as tables
from agorametrics.sources.store import Store
from agorametrics.streaming import ingest
from workloads import standin_sql as sql
from workloads import standins as given
from workloads.standin_sql import with_ctes

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

UTC = dt.timezone.utc
EVENTS_AS_OF = dt.datetime(2024, 2, 10, tzinfo=UTC)
ORDERS_AS_OF = dt.datetime(1999, 3, 15, tzinfo=UTC)
PERSONAL_AS_OF = dt.datetime(1999, 1, 31, 12, tzinfo=UTC)
ONE_USER = 7


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def mapping(spark: SparkSession, sf: str) -> DataFrame:
    return given.mapping(spark, sf, EVENTS_AS_OF)


# --- facts ------------------------------------------------------------------------


@query(with_ctes("order_stats", "SELECT * FROM order_stats"))
def user_stats_monthly(spark, sf):
    return given.order_stats(spark, sf)


@query(with_ctes("order_edges", "SELECT * FROM order_edges"))
def user_reactions_monthly(spark, sf):
    return given.order_edges(spark, sf)


@query(with_ctes("order_reactions", "SELECT * FROM order_reactions"))
def user_reactions_alltime(spark, sf):
    return facts.all_time_reactions(given.order_edges(spark, sf))


@query(
    with_ctes(
        "members mapping",
        """SELECT author_id, username || ' (later)' AS username, TIMESTAMP '2024-02-11' AS last_updated
        FROM mapping WHERE author_id IN (SELECT id FROM members WHERE bot)
        UNION ALL SELECT author_id, username, TIMESTAMP '2024-02-10'
        FROM mapping WHERE author_id IN (SELECT id FROM members WHERE NOT bot)""",
    )
)
def user_mapping_latest(spark, sf):
    """All members get a username; a day later the bots are renamed."""
    later = EVENTS_AS_OF + dt.timedelta(days=1)
    bots = given.members(spark, sf).where("bot")
    renamed = people.cleaned_usernames(
        bots.withColumn("display_name", F.concat("display_name", F.lit(" (later)"))), later
    )
    latest = people.latest_usernames(mapping(spark, sf).unionByName(renamed))
    return latest.withColumn("last_updated", F.col("last_updated").cast("timestamp_ntz"))


@query(
    with_ctes(
        "members mapping",
        """SELECT author_id, username || CASE WHEN bot THEN '' ELSE ' (later)' END AS username,
        CASE WHEN bot THEN TIMESTAMP '2024-02-10' ELSE TIMESTAMP '2024-02-11' END AS last_updated
        FROM mapping JOIN members ON id = author_id""",
    )
)
def usernames_refreshed(spark, sf):
    """Three refreshes of a store: the second comes too early, at the third the bots have left."""
    store = Store(spark, new_folder(spark, "store"))
    everyone = given.members(spark, sf)
    for hours, suffix, present in ((0, "", everyone), (23, " (early)", everyone), (24, " (later)", everyone.where("NOT bot"))):
        shown = present.withColumn("display_name", F.concat("display_name", F.lit(suffix)))
        ingest.refresh_usernames(shown, store, EVENTS_AS_OF + dt.timedelta(hours=hours))
    return store.user_mapping().withColumn("last_updated", F.col("last_updated").cast("timestamp_ntz"))


@query(
    with_ctes(
        "order_quality",
        """SELECT id, content, ts, reaction_count, author_id,
        CAST(NULL AS BIGINT) AS reply_to_id, CAST(NULL AS VARCHAR) AS reply_to_author,
        CAST(NULL AS VARCHAR) AS reply_to_content FROM order_quality""",
    )
)
def messages_quality(spark, sf):
    messages = facts.quality_messages(facts.counted_messages(given.raw_orders(spark, sf)))
    return messages.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    with_ctes(
        "contents",
        f"""SELECT doc_id, {sql.BLANK} AS blank, {sql.SHORT} AS too_short, {sql.LINK} AS link,
        {sql.EMOJI} AS emoji, {sql.TAG} AS tag, {sql.VALID} AS valid FROM contents""",
    )
)
def message_filter_flags(spark, sf):
    content = F.col("content")
    return given.document_contents(spark, sf).select(
        "doc_id",
        text.is_blank(content).alias("blank"),
        text.is_too_short(content).alias("too_short"),
        text.has_link(content).alias("link"),
        text.has_custom_emoji(content).alias("emoji"),
        text.has_tag(content).alias("tag"),
        text.is_valid_message(content).alias("valid"),
    )


@query(
    with_ctes(
        "raw",
        """SELECT giver_id, receiver_id, CAST(year(created_at) AS INTEGER) AS year,
        CAST(month(created_at) AS INTEGER) AS month, count(*) AS reaction_count FROM (
            SELECT k AS giver_id, author_id AS receiver_id, created_at FROM raw
            UNION ALL
            SELECT k + i, author_id, created_at FROM raw, unnest(range(1, ups + 1)) AS u(i))
        WHERE giver_id < 100 GROUP BY 1, 2, 3, 4""",
    )
)
def reaction_explode(spark, sf):
    return facts.reaction_months(facts.reaction_events(given.unresolved_messages(spark, sf)))


@query(with_ctes("raw", "SELECT id, reaction_count FROM raw"))
def reaction_totals(spark, sf):
    return given.unresolved_messages(spark, sf).select(
        "id", facts.reaction_total(F.col("reactions")).alias("reaction_count")
    )


@query(
    with_ctes(
        "turns",
        """SELECT m.id, m.reply_to AS reply_to_id,
        CASE WHEN m.reply_to IS NULL THEN NULL WHEN p.id IS NULL THEN 'Deleted User'
             ELSE coalesce(p.author_name, 'Unknown User') END AS reply_to_author,
        CASE WHEN m.reply_to IS NULL THEN NULL WHEN p.id IS NULL THEN 'Message was deleted'
             ELSE coalesce(p.content, 'Content unavailable') END AS reply_to_content
        FROM turns m LEFT JOIN turns p ON m.reply_to = p.id""",
    )
)
def reply_info(spark, sf):
    turns = given.conversation_messages(spark, sf)
    resolved = facts.resolve_references(turns, turns)
    return resolved.select("id", *facts.reply_columns(F.col("reference")))


@query(
    with_ctes(
        "raw",
        """SELECT id, content || ' (edited)' AS content, reaction_count + 1 AS reaction_count FROM raw""",
    )
)
def newest_copies(spark, sf):
    """Every message is fetched twice; the second time edited and with one more reaction."""
    raw = given.unresolved_messages(spark, sf)
    extra = F.struct(
        F.lit("late").alias("emoji"),
        F.lit(1).cast("bigint").alias("count"),
        F.col("reactions")[1]["users"].alias("users"),
    )
    later = raw.withColumns(
        {
            "content": F.concat("content", F.lit(" (edited)")),
            "reactions": F.array_append("reactions", extra),
            "fetched_at": F.col("fetched_at") + F.expr("INTERVAL 1 DAY"),
        }
    )
    newest = facts.newest_copies(later.unionByName(raw))
    return newest.select(
        "id", "content", facts.reaction_total(F.col("reactions")).alias("reaction_count")
    )


@query(
    with_ctes(
        "raw",
        f"""SELECT author_id, CAST(year(created_at) AS INTEGER) AS year,
        CAST(month(created_at) AS INTEGER) AS month, count(*) AS total_messages,
        CAST(sum(reaction_count) AS BIGINT) AS total_reactions
        FROM raw WHERE NOT ({sql.BLANK}) AND NOT author_bot GROUP BY 1, 2, 3""",
    )
)
def repopulated_stats(spark, sf):
    return facts.repopulated(given.unresolved_messages(spark, sf))[0]


@query(
    with_ctes(
        "raw",
        f"""SELECT giver_id, receiver_id, CAST(year(created_at) AS INTEGER) AS year,
        CAST(month(created_at) AS INTEGER) AS month, count(*) AS reaction_count FROM (
            SELECT k AS giver_id, author_id AS receiver_id, created_at, content, author_bot FROM raw
            UNION ALL
            SELECT k + i, author_id, created_at, content, author_bot
            FROM raw, unnest(range(1, ups + 1)) AS u(i))
        WHERE giver_id < 100 AND NOT ({sql.BLANK}) AND NOT author_bot GROUP BY 1, 2, 3, 4""",
    )
)
def repopulated_reactions(spark, sf):
    return facts.repopulated(given.unresolved_messages(spark, sf))[1]


# --- stored tables, filled by two scheduled increments -----------------------------


DAYS = (dt.datetime(2024, 1, 17, tzinfo=UTC), dt.datetime(2024, 2, 2, tzinfo=UTC))


def _two_days(spark: SparkSession, sf: str) -> tuple[Store, list[ingest.Ingested]]:
    raw, channels, store = _raw_and_store(spark, sf)
    return store, [ingest.ingest_increment(raw, channels, store, day, given.SELF_ID, raw) for day in DAYS]


def ingested(spark: SparkSession, sf: str) -> Store:
    return _two_days(spark, sf)[0]


_SCANNED_STATS = """SELECT author_id, CAST(year(created_at) AS INTEGER) AS year,
    CAST(month(created_at) AS INTEGER) AS month, count(*) AS total_messages,
    CAST(sum(reaction_count) AS BIGINT) AS total_reactions FROM {0} GROUP BY 1, 2, 3"""

_SCANNED_EDGES = """SELECT giver_id, receiver_id, CAST(year(created_at) AS INTEGER) AS year,
    CAST(month(created_at) AS INTEGER) AS month, count(*) AS reaction_count FROM (
        SELECT k AS giver_id, author_id AS receiver_id, created_at FROM {0}
        UNION ALL
        SELECT k + i, author_id, created_at FROM {0}, unnest(range(1, ups + 1)) AS u(i))
    WHERE giver_id < 100 GROUP BY 1, 2, 3, 4"""

_QUALITY = f"WHERE reaction_count >= 4 AND {sql.VALID}"


@query(with_ctes("scanned", _SCANNED_STATS.format("scanned")))
def ingest_stats(spark, sf):
    return ingested(spark, sf).user_stats_monthly()


def _raw_and_store(spark: SparkSession, sf: str):
    raw = given.replying_messages(spark, sf)
    return raw, given.channels(spark, sf), Store(spark, new_folder(spark, "store"))


@query(with_ctes("scanned", _SCANNED_STATS.format("scanned")))
def ingest_after_crash(spark, sf):
    """A run leaves its counts without the offsets behind them; the next day's run goes on."""
    raw, channels, store = _raw_and_store(spark, sf)
    scanned = facts.unscanned(raw, channels, store.scan_offsets(), DAYS[0] - dt.timedelta(days=1))
    counted = facts.counted_messages(facts.newest_copies(scanned), given.SELF_ID)
    store.put(tables.STATS, facts.author_months(counted), store.next_batch())
    ingest.ingest_increment(raw, channels, store, DAYS[1], given.SELF_ID, raw)
    return store.user_stats_monthly()


@query(with_ctes("scanned", _SCANNED_STATS.format("scanned")))
def ingest_out_of_order(spark, sf):
    raw, channels, store = _raw_and_store(spark, sf)
    for month, day in ((1, 8), (2, 2), (1, 17)):
        as_of = dt.datetime(2024, month, day, tzinfo=UTC)
        ingest.ingest_increment(raw, channels, store, as_of, given.SELF_ID, raw)
    return store.user_stats_monthly()


@query(with_ctes("scanned", _SCANNED_STATS.format("scanned")))
def ingest_after_compaction(spark, sf):
    raw, channels, store = _raw_and_store(spark, sf)
    ingest.ingest_increment(raw, channels, store, DAYS[0], given.SELF_ID, raw)
    store = store.compacted(new_folder(spark, "store"))
    ingest.ingest_increment(raw, channels, store, DAYS[1], given.SELF_ID, raw)
    return store.user_stats_monthly()


@query(with_ctes("scanned", _SCANNED_STATS.format("scanned")))
def ingest_compacted_in_place(spark, sf):
    raw, channels, store = _raw_and_store(spark, sf)
    ingest.ingest_increment(raw, channels, store, DAYS[0], given.SELF_ID, raw)
    store.compact()
    ingest.ingest_increment(raw, channels, store, DAYS[1], given.SELF_ID, raw)
    return store.user_stats_monthly()


@query(
    with_ctes(
        "raw readable",
        f"""SELECT author_id, CAST(year(created_at) AS INTEGER) AS year,
        CAST(month(created_at) AS INTEGER) AS month, count(*) AS total_messages,
        CAST(sum(reaction_count) AS BIGINT) AS total_reactions
        FROM raw JOIN readable USING (channel_id) WHERE created_at < TIMESTAMP '2024-02-01 00:00:00'
        AND NOT ({sql.BLANK}) AND NOT author_bot GROUP BY 1, 2, 3""",
    )
)
def repopulated_store(spark, sf):
    """The stored months replaced by a new count, without bots."""
    store = ingested(spark, sf)
    raw, channels = given.replying_messages(spark, sf), given.channels(spark, sf)
    ingest.repopulate(raw, channels, store, dt.datetime(2024, 2, 3, tzinfo=UTC))
    return store.user_stats_monthly()


@query(
    with_ctes(
        "scanned",
        f"""SELECT year, month, round(avg(CAST(total_reactions AS DOUBLE) / nullif(total_messages, 0)), 6) AS average_rpm
        FROM ({_SCANNED_STATS.format("scanned")}) GROUP BY 1, 2""",
    )
)
def ingest_monthly_mean(spark, sf):
    """The mean of the authors' ratios, kept up by the two increments without counting again."""
    changes = ingested(spark, sf).batches(tables.RPM_CHANGES)
    return rounded(inflation.monthly_rpm_from_changes(changes), "average_rpm")


@query(with_ctes("scanned", _SCANNED_EDGES.format("scanned")))
def ingest_reactions(spark, sf):
    return ingested(spark, sf).user_reactions_monthly()


@query(
    with_ctes(
        "raw scanned",
        f"""SELECT m.id, m.content, m.created_at AS ts, m.reaction_count, m.author_id,
        m.reply_to AS reply_to_id,
        CASE WHEN m.reply_to IS NULL THEN NULL
             ELSE coalesce(p.author_name, 'Deleted User') END AS reply_to_author,
        CASE WHEN m.reply_to IS NULL THEN NULL
             ELSE coalesce(p.content, 'Message was deleted') END AS reply_to_content
        FROM (SELECT * FROM scanned {_QUALITY}) m LEFT JOIN raw p ON m.reply_to = p.id""",
    )
)
def ingest_messages(spark, sf):
    messages = ingested(spark, sf).messages()
    return messages.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    with_ctes(
        "raw readable",
        """SELECT channel_id, max(created_at) AS last_scanned FROM raw JOIN readable USING (channel_id)
        WHERE created_at < TIMESTAMP '2024-02-01 00:00:00' GROUP BY 1""",
    )
)
def channel_offsets(spark, sf):
    offsets = ingested(spark, sf).scan_offsets()
    return offsets.withColumn("last_scanned", F.col("last_scanned").cast("timestamp_ntz"))


@query(
    with_ctes(
        "raw readable",
        """SELECT max(created_at) AS last_scanned FROM raw JOIN readable USING (channel_id)
        WHERE created_at < TIMESTAMP '2024-02-01 00:00:00' AND channel_id = 1""",
    )
)
def channel_offset_lookup(spark, sf):
    offset = facts.offset_for(ingested(spark, sf).scan_offsets(), 1)
    return offset.select(F.col("last_scanned").cast("timestamp_ntz").alias("last_scanned"))


@query(
    with_ctes(
        "raw readable",
        """SELECT 'last_scanned_timestamp_' || channel_id AS key,
        strftime(max(created_at), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS value
        FROM raw JOIN readable USING (channel_id)
        WHERE created_at < TIMESTAMP '2024-02-01 00:00:00' GROUP BY channel_id""",
    )
)
def metadata(spark, sf):
    return ingested(spark, sf).metadata()


@query(
    with_ctes(
        "scanned",
        f"""SELECT count(*) AS total_messages,
        coalesce(CAST(sum(reaction_count) AS BIGINT), 0) AS total_reactions FROM scanned {_QUALITY}""",
    )
)
def ingest_totals(spark, sf):
    """Observed while the two increments are written."""
    _, runs = _two_days(spark, sf)
    totals = (sum(r.total_messages for r in runs), sum(r.total_reactions for r in runs))
    return spark.createDataFrame([totals], "total_messages long, total_reactions long")


@query(
    with_ctes(
        "scanned",
        f"""SELECT 'user_stats_monthly' AS name, CAST(0 AS BIGINT) AS n
        UNION ALL SELECT 'user_reactions', 0
        UNION ALL SELECT 'user_reactions_monthly', count(*) FROM ({_SCANNED_EDGES.format("scanned")})
        UNION ALL SELECT 'messages', count(*) FROM scanned {_QUALITY}""",
    )
)
def reset_stats(spark, sf):
    store = ingested(spark, sf)
    store.reset()
    parts = {
        tables.STATS: store.user_stats_monthly(),
        tables.ALL_TIME: store.user_reactions(),
        tables.EDGES: store.user_reactions_monthly(),
        tables.MESSAGES: store.messages(),
    }
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in parts.items()]
    return counts[0].unionAll(counts[1]).unionAll(counts[2]).unionAll(counts[3])


# --- stored tables, filled by a stream ---------------------------------------------


def streamed(spark: SparkSession, sf: str, read=given.raw_stream) -> Store:
    root = new_folder(spark, "stream-store")
    session = stream_session(spark, spark.sparkContext.defaultParallelism)
    stream = ingest.start_stream(
        read(session, sf),
        Store(session, root),
        new_folder(spark, "stream-checkpoint"),
        name="events",
        self_id=given.SELF_ID,
        every="0 seconds",
        channels=given.channels(session, sf),
    )
    stream.processAllAvailable()
    stream.stop()
    return Store(spark, root)


@query(with_ctes("settled", _SCANNED_STATS.format("settled")))
def stream_user_stats(spark, sf):
    return streamed(spark, sf).user_stats_monthly()


@query(with_ctes("settled", _SCANNED_STATS.format("settled")))
def stream_channel_history(spark, sf):
    """The same messages, kept by channel and replayed by the channel history source."""
    raw = given.unresolved_messages(spark, sf)
    folder = new_folder(spark, "history")
    history.write_history(raw, folder)

    def read(session, _):
        history.register(session)
        return session.readStream.format(history.FORMAT).schema(raw.schema).load(folder)

    return streamed(spark, sf, read).user_stats_monthly()


@query(with_ctes("settled", _SCANNED_EDGES.format("settled")))
def stream_user_reactions(spark, sf):
    return streamed(spark, sf).user_reactions_monthly()


@query(
    with_ctes(
        "settled",
        f"""SELECT id, content, created_at AS ts, reaction_count, author_id FROM settled {_QUALITY}""",
    )
)
def stream_messages(spark, sf):
    messages = streamed(spark, sf).messages()
    return messages.select(
        "id", "content", F.col("ts").cast("timestamp_ntz").alias("ts"), "reaction_count", "author_id"
    )


# --- activity ----------------------------------------------------------------------

_TOTALS = """SELECT s.author_id, username, total_msgs, total_reacts,
    round(CAST(total_reacts AS DOUBLE) / nullif(total_msgs, 0), 6) AS avg_reacts
    FROM (SELECT author_id, CAST(sum(total_messages) AS BIGINT) AS total_msgs,
                 CAST(sum(total_reactions) AS BIGINT) AS total_reacts
          FROM order_stats {0} GROUP BY 1) s LEFT JOIN mapping m ON s.author_id = m.author_id"""


@query(with_ctes("order_stats mapping", _TOTALS.format("")))
def stats_all_time(spark, sf):
    totals = activity.totals_in_range(given.order_stats(spark, sf), mapping(spark, sf))
    return rounded(totals, "avg_reacts")


@query(
    with_ctes(
        "order_stats mapping",
        _TOTALS.format(
            """WHERE (year > 1997 OR (year = 1997 AND month >= 11))
            AND (year < 1999 OR (year = 1999 AND month <= 2))"""
        ),
    )
)
def stats_range(spark, sf):
    totals = activity.totals_in_range(
        given.order_stats(spark, sf),
        mapping(spark, sf),
        dt.date(1997, 11, 20),
        dt.date(1999, 2, 3),
    )
    return rounded(totals, "avg_reacts")


_MONTH = """SELECT s.author_id, username, total_messages AS total_msgs, total_reactions AS total_reacts,
    round(CAST(total_reactions AS DOUBLE) / nullif(total_messages, 0), 6) AS avg_reacts
    FROM {0} s LEFT JOIN mapping m ON s.author_id = m.author_id WHERE year = {1} AND month = {2}"""


@query(with_ctes("order_stats mapping", _MONTH.format("order_stats", 1998, 5)))
def monthly_stats(spark, sf):
    stats = activity.monthly_stats(given.order_stats(spark, sf), mapping(spark, sf), 1998, 5)
    return rounded(stats, "avg_reacts")


_ONE_MONTH = with_ctes(
    "event_stats",
    f"""SELECT total_messages AS total_msgs, total_reactions AS total_reacts,
    round(CAST(total_reactions AS DOUBLE) / nullif(total_messages, 0), 6) AS avg_reacts
    FROM event_stats WHERE author_id = {ONE_USER} AND year = 2024 AND month = 1""",
)


@query(_ONE_MONTH)
def user_monthly_stats(spark, sf):
    return rounded(
        activity.user_month(given.event_stats(spark, sf), ONE_USER, 2024, 1), "avg_reacts"
    )


@query(_ONE_MONTH)
def stored_user_month(spark, sf):
    """The same looked up in a store, which reads only row groups that hold the author."""
    store = Store(spark, new_folder(spark, "store"))
    store.put(tables.STATS, given.event_stats(spark, sf), store.next_batch())
    return rounded(activity.user_month(store.user_stats_monthly(), ONE_USER, 2024, 1), "avg_reacts")


_BOARD = """SELECT author_id, display_name, {avg} AS avg_reacts, total_msgs, total_reacts,
    round(server_avg, 6) AS server_avg FROM (
      SELECT s.author_id, coalesce(nullif(username, ''), 'User ' || s.author_id) AS display_name,
             CAST(total_reactions AS DOUBLE) / nullif(total_messages, 0) AS avg_reacts,
             total_messages AS total_msgs, total_reactions AS total_reacts,
             (SELECT CAST(sum(total_reactions) AS DOUBLE) / nullif(sum(total_messages), 0)
              FROM event_stats WHERE year = 2024 AND month = 1) AS server_avg
      FROM event_stats s LEFT JOIN mapping m ON s.author_id = m.author_id
      WHERE year = 2024 AND month = 1 AND total_messages >= {least})
    {tail}"""
_AVG6 = "round(avg_reacts, 6)"
_TOP10 = "ORDER BY board.avg_reacts DESC, author_id LIMIT 10"


def _board_sql(avg: str, least: int, tail: str) -> str:
    return _BOARD.format(avg=avg, least=least, tail=tail).replace(
        f"total_messages >= {least})", f"total_messages >= {least}) board"
    )


def _leaderboard(spark: SparkSession, sf: str, **options) -> DataFrame:
    """Asked for February, which is empty, so January is shown."""
    return activity.leaderboard(
        given.event_stats(spark, sf),
        mapping(spark, sf),
        EVENTS_AS_OF.year,
        EVENTS_AS_OF.month,
        EVENTS_AS_OF.date(),
        **options,
    )


@query(with_ctes("event_stats mapping", _board_sql(_AVG6, 30, _TOP10)))
def leaderboard_top10(spark, sf):
    return rounded(_leaderboard(spark, sf), "avg_reacts", "server_avg")


@query(
    with_ctes(
        "event_stats mapping",
        _board_sql(_AVG6, 65, "ORDER BY board.avg_reacts ASC, author_id LIMIT 10"),
    )
)
def leaderboard_least(spark, sf):
    board = _leaderboard(spark, sf, least=True, min_messages=65)
    return rounded(board, "avg_reacts", "server_avg")


@query(with_ctes("event_stats mapping", _board_sql(_AVG6, 65, "")))
def leaderboard_all(spark, sf):
    board = _leaderboard(spark, sf, all_users=True, min_messages=65)
    return rounded(board, "avg_reacts", "server_avg")


@query(
    with_ctes(
        "event_stats mapping",
        f"""SELECT author_id, rpad(left(display_name, 20), 20, ' ') || ' '
        || printf('%5.2f', avg_reacts) || ' ' || printf('%5d', total_msgs) || ' '
        || printf('%7d', total_reacts) AS line
        FROM ({_board_sql("avg_reacts", 30, "")})""",
    )
)
def leaderboard_lines(spark, sf):
    return activity.leaderboard_lines(_leaderboard(spark, sf, all_users=True))


@query(
    with_ctes(
        "event_stats",
        """SELECT 2024 AS year, 1 AS month, 'January 2024' AS month_name, count(*) AS users,
        count(*) FILTER (WHERE total_messages >= 30) AS active_users,
        round(CAST(sum(total_reactions) AS DOUBLE) / sum(total_messages), 6) AS server_avg,
        CASE WHEN count(*) = 0 THEN 'no_statistics'
             WHEN count(*) FILTER (WHERE total_messages >= 30) = 0 THEN 'nobody_active'
             ELSE 'shown' END AS outcome
        FROM event_stats WHERE year = 2024 AND month = 1""",
    )
)
def leaderboard_summary(spark, sf):
    """Asked for February, which is empty, so January is shown."""
    asked = (EVENTS_AS_OF.year, EVENTS_AS_OF.month, EVENTS_AS_OF.date())
    return rounded(activity.leaderboard_summary(given.event_stats(spark, sf), *asked), "server_avg")


def _personal(spark: SparkSession, sf: str) -> DataFrame:
    authors = given.members(spark, sf).select(F.col("id").alias("author_id"))
    return activity.personal_months(given.order_stats(spark, sf), authors, PERSONAL_AS_OF)


@query(
    with_ctes(
        "personal",
        """SELECT author_id, step, year, month, month_name, total_msgs, total_reacts,
        round(avg_reacts, 6) AS avg_reacts FROM personal""",
    )
)
def personal_12m(spark, sf):
    return rounded(_personal(spark, sf), "avg_reacts")


@query(
    with_ctes(
        "personal",
        """SELECT author_id, step, rpad(month_name, 10, ' ') || ' ' || printf('%10d', total_msgs) || ' '
        || printf('%10d', total_reacts) || ' ' || printf('%5.2f', avg_reacts) AS line FROM personal""",
    )
)
def personal_lines(spark, sf):
    return activity.personal_lines(_personal(spark, sf))


def _active(spark: SparkSession, sf: str) -> DataFrame:
    return activity.active_users(given.event_stats(spark, sf), 2024, 1, min_messages=60)


@query(with_ctes("active", "SELECT author_id FROM active"))
def active_users(spark, sf):
    return _active(spark, sf)


# --- inflation ---------------------------------------------------------------------


@query(
    with_ctes(
        "monthly_rpm",
        """SELECT year, month, round(average_rpm, 6) AS average_rpm FROM monthly_rpm
        ORDER BY year DESC, month DESC LIMIT 12""",
    )
)
def inflation_monthly_raw(spark, sf):
    return rounded(inflation.monthly_rpm(given.order_stats(spark, sf), 12), "average_rpm")


@query(
    with_ctes(
        "yearly_rpm",
        """SELECT year, total_reactions, total_messages, round(average_rpm, 6) AS average_rpm
        FROM yearly_rpm""",
    )
)
def inflation_yearly_raw(spark, sf):
    return rounded(inflation.yearly_rpm(given.order_stats(spark, sf)), "average_rpm")


_MONTHLY_CHANGE = """SELECT year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS month_year,
    CAST(printf('%.2f', CASE WHEN previous = 0 THEN 0.0
         ELSE (average_rpm - previous) / previous * 100 END) AS DOUBLE) AS change_percentage,
    round(average_rpm, 6) AS average_rpm{0} FROM (
      SELECT *, lag(average_rpm) OVER (ORDER BY {1}) AS previous FROM {2})
    WHERE previous IS NOT NULL"""
_ZERO_TOTALS = """, CAST(0 AS BIGINT) AS total_reactions, CAST(0 AS BIGINT) AS total_messages"""
_LAST12 = "(SELECT * FROM monthly_rpm ORDER BY year DESC, month DESC LIMIT 12)"


@query(
    with_ctes(
        "monthly_rpm", _MONTHLY_CHANGE.format(_ZERO_TOTALS, "year DESC, month DESC", _LAST12)
    )
)
def inflation_monthly_change(spark, sf):
    months, _ = inflation.inflation_report(given.order_stats(spark, sf))
    return rounded(months, "average_rpm")


@query(with_ctes("monthly_rpm", _MONTHLY_CHANGE.format(_ZERO_TOTALS, "year, month", "monthly_rpm")))
def inflation_monthly_chronological(spark, sf):
    monthly = inflation.monthly_rpm(given.order_stats(spark, sf))
    return rounded(inflation.monthly_inflation(monthly, chronological=True), "average_rpm")


@query(with_ctes("monthly_rpm", _MONTHLY_CHANGE.format("", "year DESC, month DESC", _LAST12)))
def inflation_monthly_bars(spark, sf):
    months, _ = inflation.inflation_report(given.order_stats(spark, sf))
    return rounded(inflation.monthly_inflation_bars(months), "average_rpm")


@query(
    with_ctes(
        "yearly_change",
        """SELECT year, CAST(printf('%.2f', CASE WHEN previous = 0 THEN 0.0
        ELSE (average_rpm - previous) / previous * 100 END) AS DOUBLE) AS change_percentage,
        round(average_rpm, 6) AS average_rpm, total_reactions, total_messages FROM yearly_change""",
    )
)
def inflation_yearly_change(spark, sf):
    _, years = inflation.inflation_report(given.order_stats(spark, sf))
    return rounded(years, "average_rpm")


@query(
    with_ctes(
        "yearly_change",
        """SELECT year, round(coalesce((average_rpm / nullif(lag(average_rpm) OVER (ORDER BY year), 0)
        - 1) * 100, 0), 6) AS yoy_change, round(average_rpm, 6) AS average_rpm FROM yearly_change""",
    )
)
def inflation_yearly_plot(spark, sf):
    _, years = inflation.inflation_report(given.order_stats(spark, sf))
    return rounded(inflation.yearly_inflation_bars(years), "yoy_change", "average_rpm")


_FROM_EDGES = """SELECT {0}, coalesce(r, 0) AS total_reactions, total_messages,
    round(coalesce(CAST(coalesce(r, 0) AS DOUBLE) / nullif(total_messages, 0), 0), 6) AS average_rpm
    FROM (SELECT {0}, CAST(sum(total_messages) AS BIGINT) AS total_messages FROM order_stats GROUP BY {0})
    LEFT JOIN (SELECT {0}, CAST(sum(reaction_count) AS BIGINT) AS r FROM order_edges GROUP BY {0})
    USING ({0})"""


@query(
    with_ctes(
        "order_stats order_edges",
        _FROM_EDGES.format("year, month") + " ORDER BY year DESC, month DESC LIMIT 12",
    )
)
def inflation_monthly_new(spark, sf):
    rpm = inflation.monthly_rpm_from_edges(
        given.order_stats(spark, sf), given.order_edges(spark, sf), 12
    )
    return rounded(rpm, "average_rpm")


@query(with_ctes("order_stats order_edges", _FROM_EDGES.format("year")))
def inflation_yearly_new(spark, sf):
    rpm = inflation.yearly_rpm_from_edges(given.order_stats(spark, sf), given.order_edges(spark, sf))
    return rounded(rpm, "average_rpm")


# --- volume ------------------------------------------------------------------------

_GDP = """SELECT year, month, CAST(sum(total_messages) AS BIGINT) AS total_messages
    FROM order_stats GROUP BY 1, 2 ORDER BY year DESC, month DESC LIMIT 24"""
_HDI = """SELECT q.year, q.month, quality_count, total_count,
    CAST(quality_count AS DOUBLE) / nullif(total_count, 0) AS hdi_ratio
    FROM (SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
                 count(*) AS quality_count FROM order_quality GROUP BY 1, 2) q
    JOIN (SELECT year, month, CAST(sum(total_messages) AS BIGINT) AS total_count
          FROM order_stats GROUP BY 1, 2) t ON q.year = t.year AND q.month = t.month
    ORDER BY q.year DESC, q.month DESC LIMIT 24"""
_POINTS = """SELECT year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS month_year, {0} AS {1},
    round({1} + (max({1}) OVER ()) * CAST(0.02 AS DOUBLE), 6) AS label_height FROM ({2})"""


@query(with_ctes("order_stats", _GDP))
def gdp_24(spark, sf):
    return volume.messages_per_month(given.order_stats(spark, sf))


def _hdi(spark: SparkSession, sf: str) -> DataFrame:
    messages = facts.quality_messages(facts.counted_messages(given.raw_orders(spark, sf)))
    return volume.quality_ratio_per_month(messages, given.order_stats(spark, sf))


@query(
    with_ctes(
        "order_stats order_quality",
        f"""SELECT year, month, quality_count, total_count, round(hdi_ratio, 6) AS hdi_ratio
        FROM ({_HDI})""",
    )
)
def hdi_24(spark, sf):
    return rounded(_hdi(spark, sf), "hdi_ratio")


@query(with_ctes("order_stats", _POINTS.format("total_messages", "total_messages", _GDP)))
def gdp_chart(spark, sf):
    series = volume.messages_per_month(given.order_stats(spark, sf))
    return rounded(volume.chart_points(series, "total_messages"), "label_height")


@query(
    with_ctes(
        "order_stats order_quality", _POINTS.format("round(hdi_ratio, 6)", "hdi_ratio", _HDI)
        .replace("round(hdi_ratio + (max(hdi_ratio)", "round(p.hdi_ratio + (max(p.hdi_ratio)")
        + " p",
    )
)
def hdi_chart(spark, sf):
    return rounded(volume.chart_points(_hdi(spark, sf), "hdi_ratio"), "hdi_ratio", "label_height")


# --- trade -------------------------------------------------------------------------

_PARTNERS = """SELECT * FROM (
    SELECT {user}, {partner}, {total}, CAST(row_number() OVER (PARTITION BY {user}
           ORDER BY {total} DESC, {partner}) AS INTEGER) AS rank
    FROM (SELECT {user}, {partner}, CAST(sum(reaction_count) AS BIGINT) AS {total}
          FROM trade_edges GROUP BY 1, 2)) WHERE rank <= 5"""


@query(
    with_ctes(
        "trade_edges", _PARTNERS.format(user="giver_id", partner="receiver_id", total="total_given")
    )
)
def trade_exports_top5(spark, sf):
    return trade.top_exports(given.order_edges(spark, sf), ORDERS_AS_OF)


@query(
    with_ctes(
        "trade_edges",
        _PARTNERS.format(user="receiver_id", partner="giver_id", total="total_received"),
    )
)
def trade_imports_top5(spark, sf):
    return trade.top_imports(given.order_edges(spark, sf), ORDERS_AS_OF)


_SIDES = """SELECT user_id, CAST(sum(given) AS BIGINT) AS given, CAST(sum(received) AS BIGINT) AS received
    FROM (SELECT giver_id AS user_id, reaction_count AS given, 0 AS received FROM {0}
          UNION ALL SELECT receiver_id, 0, reaction_count FROM {0}) GROUP BY 1"""
_STATUS = "CASE WHEN {0} > 0 THEN 'SURPLUS' WHEN {0} = 0 THEN 'NEUTRAL' ELSE 'DEFICIT' END"


@query(
    with_ctes(
        "trade_edges",
        f"""SELECT user_id, given AS total_given, received AS total_received,
        received - given AS trade_balance, {_STATUS.format("received - given")} AS status
        FROM ({_SIDES.format("trade_edges")})""",
    )
)
def trade_summary(spark, sf):
    return trade.trade_totals(given.order_edges(spark, sf), ORDERS_AS_OF)


_ONE_SIDE = """(SELECT '{direction}' AS direction, {partner} AS partner_id,
    CAST(sum(reaction_count) AS BIGINT) AS total FROM trade_edges WHERE {user} = {one}
    GROUP BY 2 ORDER BY total DESC, partner_id LIMIT 5)"""
_USER_PARTNERS = f"""SELECT direction, partner_id,
    coalesce(display_name, 'User ' || partner_id) AS name, total FROM (
    {_ONE_SIDE.format(direction="export", partner="receiver_id", user="giver_id", one=ONE_USER)}
    UNION ALL
    {_ONE_SIDE.format(direction="import", partner="giver_id", user="receiver_id", one=ONE_USER)})
    LEFT JOIN members ON partner_id = id"""


@query(with_ctes("trade_edges members", _USER_PARTNERS))
def trade_user_partners(spark, sf):
    return trade.user_trade_partners(
        given.order_edges(spark, sf), given.members(spark, sf), ONE_USER, ORDERS_AS_OF
    )


@query(
    with_ctes(
        "trade_edges members",
        f"""SELECT direction, partner_id, '  ' || CASE WHEN length(name) < 20 THEN rpad(name, 20, ' ')
        ELSE name END || ' ' || printf('%6d', total) AS line FROM ({_USER_PARTNERS})""",
    )
)
def trade_user_lines(spark, sf):
    return trade.partner_lines(trade_user_partners(spark, sf))


@query(
    with_ctes(
        "trade_edges",
        f"""SELECT total_given, total_received, total_received - total_given AS trade_balance,
        {_STATUS.format("total_received - total_given")} AS status FROM (
        SELECT (SELECT coalesce(CAST(sum(reaction_count) AS BIGINT), 0) FROM trade_edges
                WHERE giver_id = {ONE_USER}) AS total_given,
               (SELECT coalesce(CAST(sum(reaction_count) AS BIGINT), 0) FROM trade_edges
                WHERE receiver_id = {ONE_USER}) AS total_received)""",
    )
)
def trade_user_summary(spark, sf):
    return trade.user_trade_summary(given.order_edges(spark, sf), ONE_USER, ORDERS_AS_OF)


# --- matrix, members, clusters -----------------------------------------------------


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    members = matrix.numbered_members(_active(spark, sf))
    return matrix.reaction_matrix(given.event_reactions(spark, sf), members)


@query(
    with_ctes(
        "cells",
        """SELECT giver_id, receiver_id, g.position AS giver_index, r.position AS receiver_index,
        reaction_count FROM cells
        JOIN (SELECT author_id, row_number() OVER (ORDER BY author_id) - 1 AS position FROM active) g
          ON giver_id = g.author_id
        JOIN (SELECT author_id, row_number() OVER (ORDER BY author_id) - 1 AS position FROM active) r
          ON receiver_id = r.author_id""",
    )
)
def reaction_matrix(spark, sf):
    return _cells(spark, sf)


@query(
    with_ctes(
        "cells",
        """SELECT giver_id, receiver_id, round(CAST(reaction_count AS DOUBLE)
        / sum(reaction_count) OVER (PARTITION BY giver_id) * 100, 6) AS percentage FROM cells""",
    )
)
def reaction_percentage(spark, sf):
    return rounded(matrix.reaction_percentages(_cells(spark, sf)), "percentage")


@query(
    with_ctes(
        "nation_reactions",
        """SELECT CAST(g.n_nationkey AS BIGINT) AS giver_id,
        string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY r.n_nationkey) AS counts
        FROM nation g CROSS JOIN nation r LEFT JOIN (
            SELECT giver_id, receiver_id, CAST(sum(reaction_count) AS BIGINT) AS n
            FROM nation_reactions GROUP BY 1, 2) ON giver_id = g.n_nationkey AND receiver_id = r.n_nationkey
        GROUP BY 1""",
    )
)
def reaction_matrix_dense(spark, sf):
    members = given.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("author_id")
    )
    members = write_once(matrix.numbered_members(members), "nation-members")
    rows = matrix.dense_rows(given.nation_reactions(spark, sf), members, "reaction_count")
    return rows.select("giver_id", F.array_join("row", ",").alias("counts"))


@query(
    with_ctes(
        "active",
        "SELECT count(*) AS users, greatest(CAST(24 AS DOUBLE), count(*) * CAST(0.6 AS DOUBLE)) AS size FROM active",
    )
)
def matrix_figure_size(spark, sf):
    return (
        _active(spark, sf)
        .agg(F.count("*").alias("users"))
        .withColumn("size", matrix.figure_size(F.col("users")))
    )


@query(
    with_ctes(
        "members",
        """SELECT c_custkey AS id, coalesce(nullif(regexp_replace(display_name, '[^\\x00-\\x7F]', '', 'g'), ''),
        'User ' || c_custkey) AS name FROM customer LEFT JOIN members ON id = c_custkey""",
    )
)
def member_names_ascii(spark, sf):
    ids = given.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return people.member_labels(ids, given.members(spark, sf))


@query(
    with_ctes(
        "order_reactions members",
        f"""SELECT id AS user_id, coalesce(given, 0) AS given, coalesce(received, 0) AS received
        FROM members LEFT JOIN ({_SIDES.format("order_reactions")}) ON user_id = id WHERE NOT bot""",
    )
)
def given_received(spark, sf):
    ids = people.non_bot_members(given.members(spark, sf)).select(F.col("id").alias("user_id"))
    return clusters.member_reactions(given.order_reactions(spark, sf), ids)


@query(
    with_ctes(
        "order_reactions members",
        f"""SELECT id AS user_id, round((given - avg(given) OVER ()) / stddev_pop(given) OVER (), 6) AS z_given,
        round((received - avg(received) OVER ()) / stddev_pop(received) OVER (), 6) AS z_received FROM (
        SELECT id, coalesce(given, 0) AS given, coalesce(received, 0) AS received
        FROM members LEFT JOIN ({_SIDES.format("order_reactions")}) ON user_id = id WHERE NOT bot)""",
    )
)
def cluster_features(spark, sf):
    scaled = clusters.standardised(given_received(spark, sf), ["given", "received"])
    return rounded(scaled.select("user_id", "z_given", "z_received"), "z_given", "z_received")


def _clusters_sql() -> str:
    """Farthest-point seeds and Lloyd rounds for four clusters of two columns."""

    def far(centre: str) -> str:
        return f"((given - {centre}.g) / m.dg) * ((given - {centre}.g) / m.dg) + ((received - {centre}.r) / m.dr) * ((received - {centre}.r) / m.dr)"

    def seed(k: int) -> str:
        near = far("m") if k == 0 else "least(" + ", ".join(far(f"s{j}") for j in range(k)) + ")"
        others = "".join(f", s{j}" for j in range(k))
        return f"s{k} AS (SELECT given::DOUBLE AS g, received::DOUBLE AS r FROM p, m{others} ORDER BY {near} DESC, user_id LIMIT 1)"

    def nearest(centres: list[str]) -> str:
        each = ", ".join(f"{{'d': {far(c)}, 'k': {k}}}" for k, c in enumerate(centres))
        return f"list_min([{each}]).k"

    means = ", ".join(
        f"""{{'g': coalesce(sum(given) FILTER (WHERE cluster = {k}) OVER () / count(*) FILTER (WHERE cluster = {k}) OVER (), c{k}.g),
        'r': coalesce(sum(received) FILTER (WHERE cluster = {k}) OVER () / count(*) FILTER (WHERE cluster = {k}) OVER (), c{k}.r)}} AS n{k}"""
        for k in range(4)
    )
    return f"""p AS (
      SELECT id AS user_id, display_name AS "user", coalesce(given, 0)::BIGINT AS given, coalesce(received, 0)::BIGINT AS received
      FROM members LEFT JOIN ({_SIDES.format("order_reactions")}) ON user_id = id WHERE NOT bot),
    m AS (SELECT sum(given) / count(*) AS g, sum(received) / count(*) AS r,
      coalesce(nullif(sqrt((count(*) * sum(given * given) - sum(given) * sum(given))::DOUBLE) / count(*), 0), 1) AS dg,
      coalesce(nullif(sqrt((count(*) * sum(received * received) - sum(received) * sum(received))::DOUBLE) / count(*), 0), 1) AS dr
      FROM p),
    {seed(0)}, {seed(1)}, {seed(2)}, {seed(3)},
    rounds AS (
      SELECT 0 AS round, p.*, {nearest(["s0", "s1", "s2", "s3"])} AS cluster, -1 AS was,
        {", ".join(f"s{k} AS c{k}" for k in range(4))}
      FROM p, m, s0, s1, s2, s3
      UNION ALL
      SELECT round + 1, user_id, "user", given, received, {nearest(["n0", "n1", "n2", "n3"])}, cluster, n0, n1, n2, n3
      FROM (SELECT *, bool_or(cluster <> was) OVER () AS moved, {means} FROM rounds), m WHERE moved)
    SELECT user_id, "user", given, received, cluster FROM rounds WHERE round = (SELECT max(round) FROM rounds)"""


@query(with_ctes("order_reactions members", _clusters_sql(), recursive=True))
def user_clusters(spark, sf):
    return clusters.user_clusters(given.order_reactions(spark, sf), given.members(spark, sf))


# --- most liked --------------------------------------------------------------------


def _liked_inputs(spark: SparkSession, sf: str):
    """Asked for February, which is empty, so January is shown."""
    return (
        given.event_edges(spark, sf),
        mapping(spark, sf),
        given.event_stats(spark, sf),
        EVENTS_AS_OF.year,
        EVENTS_AS_OF.month,
        EVENTS_AS_OF.date(),
    )


@query(with_ctes("liked_edges", "SELECT u, v, round(weight, 6) AS weight FROM liked_edges"))
def most_liked_edges(spark, sf):
    return rounded(influence.most_liked_edges(*_liked_inputs(spark, sf)), "weight")


# Power iteration without normalising in between (the growth stays far from overflow in
# 100 steps); norms and the stopping step are worked out afterwards.
_CENTRALITY = """nodes AS (SELECT u AS node FROM liked_edges UNION SELECT v FROM liked_edges),
size AS (SELECT count(*) AS n FROM nodes),
arcs AS (SELECT u AS src, v AS dst, weight FROM liked_edges
         UNION ALL SELECT v, u, weight FROM liked_edges
         UNION ALL SELECT node, node, 1.0 FROM nodes),
power AS (SELECT 0 AS i, node, CAST(1.0 AS DOUBLE) / n AS s FROM nodes, size
          UNION ALL
          SELECT i + 1, dst, sum(s * weight) FROM power JOIN arcs ON node = src
          WHERE i < 100 GROUP BY i + 1, dst),
norms AS (SELECT i, CASE WHEN i = 0 THEN 1.0 ELSE sqrt(sum(s * s)) END AS norm FROM power GROUP BY i),
scaled AS (SELECT i, node, s / norm AS score FROM power JOIN norms USING (i)),
settled AS (SELECT min(i) AS i FROM (
    SELECT a.i, sum(abs(a.score - b.score)) AS change
    FROM scaled a JOIN scaled b ON a.node = b.node AND a.i = b.i + 1 GROUP BY a.i), size
    WHERE change < n * 1e-6)
SELECT node AS "user", {0} FROM scaled JOIN settled USING (i)
ORDER BY score DESC, "user" LIMIT 5"""


@query(
    with_ctes("liked_edges", _CENTRALITY.format("round(scaled.score, 6) AS score").replace(
        "ORDER BY score", "ORDER BY scaled.score"), recursive=True)
)
def most_liked_top5(spark, sf):
    return rounded(influence.most_liked(*_liked_inputs(spark, sf)), "score")


@query(
    with_ctes(
        "liked_edges",
        _CENTRALITY.format(
            """rpad(left(node, 20), 20, ' ') || ' ' || printf('%8.2f', score) AS line"""
        ),
        recursive=True,
    )
)
def most_liked_lines(spark, sf):
    return influence.most_liked_lines(influence.most_liked(*_liked_inputs(spark, sf)))


@query(
    with_ctes(
        "liked_rows liked_edges",
        """SELECT 2024 AS year, 1 AS month, 'January 2024' AS month_name,
        (SELECT count(*) FROM liked_rows) AS edges, (SELECT count(*) FROM liked_edges) AS ties,
        CASE WHEN (SELECT count(*) FROM liked_rows) = 0 THEN 'no_data'
             WHEN (SELECT count(*) FROM liked_edges) = 0 THEN 'too_few' ELSE 'shown' END AS outcome""",
    )
)
def most_liked_summary(spark, sf):
    return influence.most_liked_report(*_liked_inputs(spark, sf))[0]


# --- random picks ------------------------------------------------------------------


@query(
    with_ctes(
        "order_quality",
        "SELECT id, content FROM order_quality ORDER BY md5('7:' || id), id LIMIT 1",
    )
)
def random_message(spark, sf):
    messages = facts.quality_messages(facts.counted_messages(given.raw_orders(spark, sf)))
    return sampling.random_message(messages, seed=7).select("id", "content")


@query("SELECT text AS quote FROM benchmark ORDER BY md5('7:' || text), text LIMIT 1")
def random_quote(spark, sf):
    quotes = given.table(spark, sf, "benchmark").select(F.col("text").alias("quote"))
    return sampling.random_quote(quotes, seed=7)


@query("SELECT text AS quote FROM benchmark WHERE text IS NOT NULL")
def quotes_from_files(spark, sf):
    """The benchmark texts, written as YAML lists by the quote source and read again."""
    quotes.register(spark)
    folder = new_folder(spark, "quotes")
    texts = given.table(spark, sf, "benchmark").where("text is not null").select(F.col("text").alias("quote"))
    texts.repartition(3).write.format(quotes.FORMAT).mode("append").save(folder)
    return spark.read.format(quotes.FORMAT).load(folder)
