"""Ingest: facts from raw messages, repeated runs, streams and restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from agorametrics.community import Community
from agorametrics.operators import facts, inflation
from agorametrics.schemas import CHANNELS, RAW_MESSAGES
from agorametrics.sources import history as channel_history
from agorametrics.sources import store as tables
from agorametrics.sources.store import Store
from agorametrics.streaming import ingest

UTC = dt.timezone.utc


def at(day, hour=12, minute=0):
    return dt.datetime(2024, 1, day, hour, minute, tzinfo=UTC)


def message(
    id,
    author=1,
    content="a message that is long enough",
    created=at(5),
    bot=False,
    reactions=(),
    channel=1,
    reference=None,
    fetched=None,
):
    return (
        id,
        channel,
        (author, f"name {author}", bot),
        content,
        created,
        reference,
        [(emoji, count, users) for emoji, count, users in reactions],
        fetched or created,
    )


FOUR = [("up", 3, [(10, False), (11, False), (12, True)]), ("down", 1, [(10, False)])]


def raw(spark, *messages):
    return spark.createDataFrame(list(messages), RAW_MESSAGES)


def test_counting(spark):
    data = raw(
        spark,
        message(1, reactions=FOUR),
        message(2),
        message(3, author=2, bot=True, reactions=FOUR),
        message(4, author=9, reactions=FOUR),
        message(5, content=" \t　"),
    )
    counted = facts.counted_messages(data, self_id=9)
    assert {tuple(r) for r in facts.author_months(counted).collect()} == {
        (1, 2024, 1, 2, 4),
        (2, 2024, 1, 1, 4),
    }
    edges = facts.reaction_months(facts.reaction_events(counted))
    assert {tuple(r) for r in edges.collect()} == {
        (10, 1, 2024, 1, 2),
        (11, 1, 2024, 1, 1),
        (10, 2, 2024, 1, 2),
        (11, 2, 2024, 1, 1),
    }
    people_only = facts.counted_messages(data, skip_bots=True)
    assert {r.id for r in people_only.collect()} == {1, 2, 4}


def test_missing_reactions_count_zero(spark):
    row = (1, 1, (1, "a", False), "text", at(5), None, None, at(5))
    totals = facts.author_months(raw(spark, row)).collect()
    assert totals[0].total_reactions == 0


def test_quality_and_replies(spark):
    data = raw(
        spark,
        message(1, reactions=FOUR, reference=(7, False, "bo", "hello")),
        message(2, reactions=FOUR, reference=(8, True, None, None)),
        message(3, reactions=FOUR, reference=(9, False, None, None)),
        message(4, reactions=FOUR),
        message(5, reactions=FOUR[:1]),
        message(6, reactions=FOUR, content="see http://x.y for more"),
    )
    got = facts.quality_messages(data).orderBy("id").collect()
    assert [(r.id, r.reaction_count) for r in got] == [(1, 4), (2, 4), (3, 4), (4, 4)]
    assert [(r.reply_to_id, r.reply_to_author, r.reply_to_content) for r in got] == [
        (7, "bo", "hello"),
        (8, "Deleted User", "Message was deleted"),
        (9, "Unknown User", "Content unavailable"),
        (None, None, None),
    ]
    totals = facts.ingest_totals(data).first()
    assert tuple(totals) == (4, 16)


def test_scan_bounds_are_exclusive(spark):
    channels = spark.createDataFrame([(1, True), (2, True), (3, False)], CHANNELS)
    offsets = spark.createDataFrame([(1, at(5))], "channel_id long, last_scanned timestamp")
    cutoff = at(9)
    data = raw(
        spark,
        message(1, created=at(5)),
        message(2, created=at(5, 13)),
        message(3, created=cutoff),
        message(4, created=at(2), channel=2),
        message(5, created=at(6), channel=3),
        message(6, created=dt.datetime(2016, 12, 31, tzinfo=UTC), channel=2),
    )
    scanned = facts.unscanned(data, channels, offsets, cutoff)
    assert {r.id for r in scanned.collect()} == {2, 4}
    nothing = facts.unscanned(data.where("channel_id = 2"), channels, offsets, at(1))
    seconds = F.col("last_scanned").cast("long")
    after = facts.next_offsets(scanned.where("channel_id = 1"), channels, cutoff)
    assert {tuple(r) for r in after.select("channel_id", seconds).collect()} == {
        (1, int(at(5, 13).timestamp())),
        (2, int(cutoff.timestamp())),
    }
    assert nothing.count() == 0


def test_offset_lookup(spark):
    offsets = spark.createDataFrame([(1, at(5))], "channel_id long, last_scanned timestamp")
    assert facts.offset_for(offsets, 1).count() == 1
    assert facts.offset_for(offsets, 2).count() == 0


def test_newest_copy(spark):
    data = raw(
        spark,
        message(1, content="new", fetched=at(8)),
        message(1, content="old", fetched=at(7)),
        message(2, content="only"),
    )
    assert {(r.id, r.content) for r in facts.newest_copies(data).collect()} == {(1, "new"), (2, "only")}


def test_resolve_references(spark):
    messages = spark.createDataFrame([(1, None), (2, 1), (3, 99)], "id long, reply_to_id long")
    originals = raw(spark, message(1, content="first"))
    got = facts.resolve_references(messages, originals)
    rows = got.select("id", *facts.reply_columns(F.col("reference"))).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [
        (1, None, None, None),
        (2, 1, "name 1", "first"),
        (3, 99, "Deleted User", "Message was deleted"),
    ]


def test_repopulate_starts_at_its_date(spark):
    early = dt.datetime(2022, 12, 31, tzinfo=UTC)
    data = raw(spark, message(1, reactions=FOUR), message(2, created=early), message(3, bot=True))
    stats, edges = facts.repopulated(data)
    assert [tuple(r) for r in stats.collect()] == [(1, 2024, 1, 1, 4)]
    assert edges.count() == 2


@pytest.fixture
def channels(spark):
    return spark.createDataFrame([(1, True)], CHANNELS)


def history(spark):
    return raw(
        spark,
        *[
            message(i, author=i % 3, created=at(1 + i % 20, i % 24, i % 60), reactions=FOUR if i % 2 else ())
            for i in range(1, 200)
        ],
    )


def contents(store):
    return (
        sorted(tuple(r) for r in store.user_stats_monthly().collect()),
        sorted(tuple(r) for r in store.user_reactions_monthly().collect()),
        sorted(tuple(r) for r in store.user_reactions().collect()),
        sorted(r.id for r in store.messages().collect()),
    )


def test_increments_equal_one_run_and_repeat_safely(spark, tmp_path, channels):
    data = history(spark)
    once = Store(spark, str(tmp_path / "once"))
    ingest.ingest_increment(data, channels, once, at(30))
    steps = Store(spark, str(tmp_path / "steps"))
    for day in (8, 15, 15, 30):
        ingest.ingest_increment(data, channels, steps, at(day))
    assert contents(once) == contents(steps)
    # Nothing new: one more run changes nothing.
    ingest.ingest_increment(data, channels, steps, at(30, 13))
    assert contents(once) == contents(steps)


@pytest.mark.parametrize("next_run", [30, 31])
def test_a_failed_run_is_replaced(spark, tmp_path, channels, monkeypatch, next_run):
    """The run dies when its counts are written; it is repeated, or the next day's run follows."""
    data = history(spark)
    store = Store(spark, str(tmp_path / "store"))
    ingest.ingest_increment(data, channels, store, at(8))

    def failing(self, rows, batch, **observed):
        """The counts become visible, the offsets don't."""
        Store._write(rows.where(F.col("kind") != tables.OFFSETS), batch, self.facts, "dynamic", {})
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(Store, "write", failing)
        with pytest.raises(OSError):
            ingest.ingest_increment(data, channels, store, at(30))
    ingest.ingest_increment(data, channels, store, at(next_run))
    once = Store(spark, str(tmp_path / "once"))
    ingest.ingest_increment(data, channels, once, at(30))
    assert contents(store) == contents(once)


def test_order_and_compaction_do_not_matter(spark, tmp_path, channels):
    data = history(spark)
    once = Store(spark, str(tmp_path / "once"))
    ingest.ingest_increment(data, channels, once, at(30))
    mixed = Store(spark, str(tmp_path / "mixed"))
    for day in (8, 30, 15):
        ingest.ingest_increment(data, channels, mixed, at(day))
    assert contents(mixed) == contents(once)
    first = Store(spark, str(tmp_path / "first"))
    ingest.ingest_increment(data, channels, first, at(15))
    compact = first.compacted(str(tmp_path / "compact"))
    ingest.ingest_increment(data, channels, compact, at(30))
    assert contents(compact) == contents(once)
    ingest.ingest_increment(data, channels, first, at(16))
    first.compact()
    assert {r.batch for r in first.batches(tables.STATS).collect()} == {"00000002"}
    # A repeated run finds nothing.
    ingest.ingest_increment(data, channels, first, at(15))
    ingest.ingest_increment(data, channels, first, at(30))
    assert contents(first) == contents(once)


def test_monthly_mean_is_kept_up(spark, tmp_path, channels):
    """After each increment, a replay and a new count, the mean is that over all authors."""
    data = raw(
        spark,
        *[message(i, author=i % 7, created=at(1 + i % 25, i % 24), reactions=FOUR if i % (1 + i % 5) == 0 else ()) for i in range(1, 150)],
        message(500, author=8, created=dt.datetime(2023, 12, 30, tzinfo=UTC), reactions=FOUR),
    )
    store = Store(spark, str(tmp_path / "store"))

    def same():
        full = inflation.monthly_rpm(store.user_stats_monthly()).collect()
        kept = inflation.monthly_rpm_from_changes(store.batches(tables.RPM_CHANGES)).collect()
        assert [tuple(r)[:2] for r in kept] == [tuple(r)[:2] for r in full]
        assert all(abs(a.average_rpm - b.average_rpm) < 1e-9 for a, b in zip(kept, full))
        return len(full)

    for day, months in ((2, 2), (9, 2), (15, 2), (28, 2)):
        ingest.ingest_increment(data, channels, store, at(day))
        assert same() == months
    extra = raw(spark, message(900, author=1, reactions=FOUR), message(901, author=99))
    for _ in range(2):
        ingest.write_facts(extra, store, "chat-000000000001")
        same()
    store.compact()
    same()
    ingest.repopulate(data, channels, store, at(29))
    same()
    store.reset()
    assert same() == 0


def test_raw_messages_are_read_once(spark, tmp_path, channels):
    """An increment evaluates its input a single time, and totals come from the write."""
    evaluated = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            evaluated.add(batch.num_rows)
            yield batch

    data = history(spark)
    watched = data.mapInArrow(count, data.schema)
    store = Store(spark, str(tmp_path / "store"))
    done = ingest.ingest_increment(watched, channels, store, at(30))
    assert evaluated.value == data.count()
    assert (done.total_messages, done.total_reactions) == tuple(facts.ingest_totals(data).first())
    assert done.batch == "00000001"


def test_replies_are_looked_up_for_quality_messages(spark, tmp_path, channels):
    """The same messages with their references and with ids to look up fill equal stores."""
    rows = [
        message(1, content="first message, the old copy", fetched=at(6)),
        message(1, content="first message, the new copy", fetched=at(7)),
        message(2, reactions=FOUR),
        message(3, reactions=FOUR),
        message(4, author=2, reactions=[("up", 9, None)]),
    ]
    plain = raw(spark, *rows)
    replies = F.when(F.col("id") == 2, 1).when(F.col("id") == 3, 99).cast("bigint")
    data = plain.drop("reference").withColumn("reply_to_id", replies)
    store = Store(spark, str(tmp_path / "store"))
    ingest.ingest_increment(data, channels, store, at(30), originals=data)
    got = store.messages().orderBy("id").collect()
    assert [(r.id, r.reply_to_author, r.reply_to_content) for r in got] == [
        (2, "name 1", "first message, the new copy"),
        (3, "Deleted User", "Message was deleted"),
        (4, None, None),
    ]
    assert sorted(tuple(r)[3:] for r in store.user_stats_monthly().collect()) == [(1, 9), (3, 8)]


def test_newest_copies_shuffle_ids_only(spark):
    data = raw(spark, message(1), message(1, fetched=at(9)), message(2))
    plan = facts.newest_copies(data.where("id = 2"))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan
    some = facts.newest_copies(data)
    assert some.count() == 2 and some.where("id = 1").first().fetched_at.day == 9
    assert "Aggregate" not in some._jdf.queryExecution().executedPlan().toString()
    alike = raw(spark, message(1), message(1), message(1, fetched=at(4)), message(2), message(2, fetched=at(9)))
    assert sorted(r.id for r in facts.newest_copies(alike).collect()) == [1, 2]


def test_repopulate_replaces_what_was_ingested(spark, tmp_path, channels):
    data = raw(
        spark,
        message(1, reactions=FOUR),
        message(2, author=3, bot=True, created=at(6)),
        message(3, created=at(20), reactions=FOUR),
        message(4, channel=2, reactions=FOUR),
    )
    store = Store(spark, str(tmp_path / "store"))
    ingest.ingest_increment(data, channels, store, at(10))
    ingest.repopulate(data, channels, store, at(11))
    assert [tuple(r) for r in store.user_stats_monthly().collect()] == [(1, 2024, 1, 1, 4)]
    assert store.user_reactions_monthly().count() == 2
    # The next increment counts what came later, once.
    ingest.ingest_increment(data, channels, store, at(30))
    assert [tuple(r) for r in store.user_stats_monthly().collect()] == [(1, 2024, 1, 2, 8)]


def test_usernames_are_refreshed_once_a_day(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    kind = "id long, display_name string, bot boolean"
    first = spark.createDataFrame([(1, "a", False), (2, "b", False)], kind)
    later = spark.createDataFrame([(1, "c", False)], kind)
    assert ingest.refresh_usernames(first, store, at(5))
    assert ingest.refresh_usernames(later, store, at(6, 11)) is None
    assert ingest.refresh_usernames(later, store, at(6, 12))
    assert {(r.author_id, r.username) for r in store.user_mapping().collect()} == {(1, "c"), (2, "b")}
    assert store.batches(tables.MAPPING).select("batch").distinct().count() == 1


def test_months_are_utc_in_any_session(spark, tmp_path, channels):
    data = raw(spark, message(1, created=dt.datetime(2024, 2, 1, 1, tzinfo=UTC), reactions=FOUR))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        store = Store(spark, str(tmp_path / "store"))
        ingest.ingest_increment(data, channels, store, dt.datetime(2024, 2, 9, tzinfo=UTC))
        assert [tuple(r) for r in store.user_stats_monthly().collect()] == [(1, 2024, 2, 1, 4)]
        assert {(r.year, r.month) for r in store.batches(tables.MESSAGES).collect()} == {(2024, 2)}
        assert store.metadata().first().value == "2024-02-01T01:00:00.000000+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    with pytest.raises(ValueError):
        ingest.ingest_increment(data, channels, store, dt.datetime(2024, 2, 9))


def land(spark, folder, *messages):
    raw(spark, *messages).coalesce(1).write.mode("append").parquet(str(folder))


def run_stream(spark, tmp_path, store, **options):
    stream = spark.readStream.schema(RAW_MESSAGES).parquet(str(tmp_path / "landing"))
    query = ingest.start_stream(stream, store, str(tmp_path / "checkpoint"), name="chat", **options)
    query.awaitTermination()


def test_stream_holds_counts_once_and_restarts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    landing = tmp_path / "landing"
    land(
        spark,
        landing,
        message(1, created=at(5, 10), reactions=FOUR),
        message(1, created=at(5, 10), reactions=FOUR, fetched=at(5, 11)),
        message(2, author=2, created=at(5, 10, 30)),
        message(3, author=2, created=at(6, 9)),
    )
    run_stream(spark, tmp_path, store)
    # The newest message is less than a day after the others: nothing has settled.
    assert store.user_stats_monthly().collect() == []
    land(spark, landing, message(4, author=3, created=at(7, 8)), message(1, created=at(5, 10), fetched=at(7)))
    run_stream(spark, tmp_path, store)
    # The watermark stands at the 6th, 8:00; the last copy of message 1 had no reactions.
    assert {tuple(r) for r in store.user_stats_monthly().collect()} == {(1, 2024, 1, 1, 0), (2, 2024, 1, 1, 0)}
    # Too late for its pane, and a new message that lets the rest settle.
    land(spark, landing, message(5, created=at(5, 10, 45)), message(6, author=4, created=at(12)))
    run_stream(spark, tmp_path, store)
    assert {tuple(r) for r in store.user_stats_monthly().collect()} == {
        (1, 2024, 1, 1, 0),
        (2, 2024, 1, 2, 0),
        (3, 2024, 1, 1, 0),
    }


def test_stream_leaves_out_channels_and_writes_offsets(spark, tmp_path, channels):
    store = Store(spark, str(tmp_path / "store"))
    landing = tmp_path / "landing"
    land(spark, landing, message(1, created=at(5, 10)), message(2, channel=3, created=at(5, 10)), message(3, created=at(9)))
    run_stream(spark, tmp_path, store, channels=channels)
    land(spark, landing, message(4, created=at(12)))
    run_stream(spark, tmp_path, store, channels=channels)
    assert [tuple(r) for r in store.user_stats_monthly().collect()] == [(1, 2024, 1, 2, 0)]
    offsets = store.scan_offsets().select("channel_id", F.col("last_scanned").cast("long")).collect()
    assert [tuple(r) for r in offsets] == [(1, int(at(9).timestamp()))]
    # A scheduled run goes on behind the stream.
    data = raw(spark, message(1, created=at(5, 10)), message(4, created=at(12)))
    ingest.ingest_increment(data, channels, store, at(20))
    assert [tuple(r) for r in store.user_stats_monthly().collect()] == [(1, 2024, 1, 3, 0)]


def replay(spark, folder, store, checkpoint, **options):
    """One run of a stream over a history, with all that is there."""
    channel_history.register(spark)
    stream = spark.readStream.format(channel_history.FORMAT).schema(RAW_MESSAGES).load(str(folder))
    query = ingest.start_stream(stream, store, str(checkpoint), name="history", every="0 seconds", **options)
    query.processAllAvailable()
    query.stop()


def test_channel_history_restarts_behind_each_channel(spark, tmp_path):
    folder, store = tmp_path / "history", Store(spark, str(tmp_path / "store"))
    batches = []
    first = raw(spark, message(1, created=at(5, 10), reactions=FOUR), message(2, author=2, channel=2, created=at(6, 9)))
    channel_history.write_history(first, str(folder))
    replay(spark, folder, store, tmp_path / "checkpoint", on_batch=batches.append)
    assert store.user_stats_monthly().collect() == []
    more = raw(spark, message(3, author=3, channel=3, created=at(9, 9)), message(4, channel=2, author=2, created=at(8, 1)))
    channel_history.write_history(more, str(folder))
    replay(spark, folder, store, tmp_path / "checkpoint", on_batch=batches.append)
    replay(spark, folder, store, tmp_path / "checkpoint", on_batch=batches.append)
    assert {tuple(r) for r in store.user_stats_monthly().collect()} == {(1, 2024, 1, 1, 4), (2, 2024, 1, 2, 0)}
    assert sum(b.total_messages for b in batches) == 1 and sum(b.total_reactions for b in batches) == 4


def test_channel_history_offsets_and_replay(spark, tmp_path):
    """An offset range gives the same rows whenever it is read, and later files don't change it."""
    folder = str(tmp_path / "history")
    rows = [message(i, channel=1 + i % 3, created=at(1 + i % 20, i % 24, i % 60), reactions=FOUR) for i in range(90)]
    channel_history.write_history(raw(spark, *rows[:60]), folder)
    reader = channel_history.HistoryReader(folder, RAW_MESSAGES)
    assert reader.initialOffset() == {}
    end = reader.latestOffset()
    assert sorted(end) == ["1", "2", "3"]

    def ids(start, end):
        return sorted(i for s in reader.partitions(start, end) for b in reader.read(s) for i in b.column("id").to_pylist())

    assert ids({}, end) == list(range(60))
    channel_history.write_history(raw(spark, *(message(i, channel=1 + i % 3, created=at(25, 1, i % 60)) for i in range(60, 90))), folder)
    assert ids({}, end) == list(range(60)) and ids(end, end) == []
    later = reader.latestOffset()
    assert ids(end, later) == list(range(60, 90)) and ids({}, later) == list(range(90))
    assert channel_history.HistoryReader(str(tmp_path / "none"), RAW_MESSAGES).latestOffset() == {}


def test_channel_history_keeps_all_columns(spark, tmp_path):
    rows = [message(1, reactions=FOUR, reference=(7, False, "bo", "hello")), message(2, content=None, bot=True)]
    data, folder = raw(spark, *rows), str(tmp_path / "history")
    channel_history.write_history(data, folder)
    channel_history.register(spark)
    out = str(tmp_path / "out")
    query = spark.readStream.format(channel_history.FORMAT).load(folder).writeStream.format("parquet")
    query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
    assert sorted(map(str, spark.read.schema(RAW_MESSAGES).parquet(out).collect())) == sorted(map(str, data.collect()))


def test_replayed_micro_batch_counts_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    data = raw(spark, message(1, reactions=FOUR), message(2, author=2))
    for _ in range(2):
        ingest.write_facts(data, store, "chat-000000000003")
    assert contents(store) == (
        [(1, 2024, 1, 1, 4), (2, 2024, 1, 1, 0)],
        [(10, 1, 2024, 1, 2), (11, 1, 2024, 1, 1)],
        [(10, 1, 2), (11, 1, 1)],
        [1],
    )


def test_all_reports_over_a_store(spark, tmp_path, channels):
    store = Store(spark, str(tmp_path / "store"))
    authors = [10, 11, 13, 14, 15]
    users = [(a, False) for a in authors]
    data = raw(
        spark,
        *[
            message(i, author=authors[i % 5], created=at(1 + i % 20, 1, i % 60), reactions=[("up", 4, users[: 1 + i % 4])])
            for i in range(400)
        ],
    )
    members = spark.createDataFrame(
        [(a, f"name {a}", False) for a in authors], "id long, display_name string, bot boolean"
    )
    ingest.ingest_increment(data, channels, store, at(30))
    ingest.refresh_usernames(members, store, at(30))
    community = Community(store, members)
    now = at(30)
    assert community.rpm(["--leaderboard"], 10, now).count() == 5
    assert community.rpm([], 10, now).count() == 12
    assert community.rpm([], 10, now).first().total_msgs == 80
    assert community.leaderboard(now, month_offset=-1).count() == 0
    assert tuple(community.leaderboard_summary(now).first())[:4] == (2024, 1, "January 2024", 5)
    assert community.leaderboard_summary(now, month_offset=-1).first().outcome == "no_statistics"
    assert community.leaderboard_lines(now, least=True).count() == 5
    assert community.monthly_stats(2024, 1).count() == 5
    assert community.user_month(10, 2024, 1).first().total_msgs == 80
    assert community.active_users(2024, 1).count() == 5
    assert community.personal_lines(10, now).count() == 12
    assert community.gdp_points().count() == 1 and community.hdi_points().count() == 1
    assert [bars.count() for bars in community.inflation_bars()] == [0, 0]
    assert community.most_liked_report(now)[0].first().outcome == "shown"
    assert community.totals().count() == 5
    assert [tuple(r) for r in community.gdp().collect()] == [(2024, 1, 400)]
    assert community.hdi().first().hdi_ratio == 1.0
    months, years = community.inflation()
    assert months.count() == 0 and years.count() == 0
    assert community.inflation_from_edges(monthly=True).first().total_reactions == 1000
    assert community.inflation_from_edges(monthly=False).first().total_messages == 400
    partners, summary = community.trade(10, now)
    assert partners.where("direction = 'import'").count() == 4
    given = sum(1 for i in range(400))
    received = sum(1 + i % 4 for i in range(400) if i % 5 == 0)
    assert tuple(summary.first())[:3] == (given, received, received - given)
    assert community.most_liked(now).count() > 0
    assert community.reaction_percentages(now).groupBy("giver_id").agg(F.sum("percentage").alias("p")).where(
        "abs(p - 100) > 1e-9"
    ).count() == 0
    assert community.user_clusters(k=2).count() == 5
    assert community.random_message(seed=1).first().content == "a message that is long enough"
    assert community.member_labels(members.select("id")).count() == 5
    community.reset()
    assert community.totals().count() == 0 and community.hdi().count() == 0


def test_a_month_with_many_rows_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """A task's share goes by rows: facts are mostly nulls and shuffle as next to nothing."""
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    store = Store(spark, str(tmp_path))
    edges = spark.range(1000).select(
        (F.col("id") % 3).alias("giver_id"), F.col("id").alias("receiver_id"),
        F.lit(2024).alias("year"), F.lit(1).alias("month"), F.lit(1).cast("long").alias("reaction_count"),
    )
    store.put(tables.EDGES, edges, "00000001")
    files = list(tmp_path.glob("facts/kind=*/batch=00000001/year=2024/month=1/*.parquet"))
    assert 5 <= len(files) <= 11
    assert store.user_reactions_monthly().count() == 1000
    assert max(spark.read.parquet(str(f)).count() for f in files) < 500


def test_repopulation_reads_messages_once(spark, tmp_path):
    """Both counts come from one pass over the raw messages, and leave bots out."""
    read = spark.sparkContext.accumulator(0)

    def passed(content):
        read.add(1)
        return content

    data = raw(
        spark,
        message(1, reactions=FOUR),
        message(2, author=2, bot=True, reactions=FOUR),
        message(3, content=None),
        message(4, author=3, reactions=[("up", 1, [(10, False), (None, None)])]),
    )
    channels = spark.createDataFrame([(1, True)], CHANNELS)
    store = Store(spark, str(tmp_path))
    ingest.ingest_increment(data, channels, store, at(20))
    once = F.udf(passed, "string").asNondeterministic()
    counted = data.withColumn("content", once("content"))
    ingest.repopulate(counted, channels, store, at(21))
    assert read.value == 4
    stats, edges = facts.repopulated(data)
    assert sorted(map(tuple, store.user_stats_monthly().collect())) == sorted(map(tuple, stats.collect()))
    found, expected = (sorted(map(str, df.collect())) for df in (store.user_reactions_monthly(), edges))
    assert found == expected
