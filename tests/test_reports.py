"""Reports on small tables worked out by hand."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agorametrics.operators import activity, clusters, inflation, matrix, trade, volume
from agorametrics.operators import members as people

STATS = "author_id long, year int, month int, total_messages long, total_reactions long"
MAPPING = "author_id long, username string"
EDGES = "giver_id long, receiver_id long, year int, month int, reaction_count long"
MEMBERS = "id long, display_name string, bot boolean"
UTC = dt.timezone.utc


@pytest.fixture(scope="module")
def stats(spark):
    rows = [
        (1, 2024, 1, 29, 290),
        (2, 2024, 1, 30, 30),
        (3, 2024, 1, 31, 93),
        (4, 2024, 1, 40, 40),
        (1, 2023, 12, 5, 10),
    ]
    return spark.createDataFrame(rows, STATS)


@pytest.fixture(scope="module")
def mapping(spark):
    return spark.createDataFrame([(1, "ann"), (2, ""), (3, None)], MAPPING)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns or df.columns).collect()]


def test_leaderboard(stats, mapping):
    board = activity.leaderboard(stats, mapping, 2024, 1, dt.date(2024, 1, 20))
    assert rows(board, "author_id", "display_name", "avg_reacts") == [
        (3, "User 3", 3.0),
        (2, "User 2", 1.0),
        (4, "User 4", 1.0),
    ]
    # The author with 29 messages is not shown but counts in the average.
    assert board.first().server_avg == pytest.approx(453 / 130)


def test_leaderboard_least_and_size(stats, mapping):
    board = activity.leaderboard(stats, mapping, 2024, 1, dt.date(2024, 1, 20), least=True, size=1)
    assert rows(board, "author_id") == [(2,)]
    everyone = activity.leaderboard(
        stats, mapping, 2024, 1, dt.date(2024, 1, 20), all_users=True, size=1
    )
    assert everyone.count() == 3


def test_empty_month_falls_back_only_when_current_or_future(stats, mapping):
    february = activity.leaderboard(stats, mapping, 2024, 2, dt.date(2024, 2, 3))
    assert february.count() == 3
    assert activity.leaderboard(stats, mapping, 2024, 2, dt.date(2024, 3, 3)).count() == 0
    assert activity.leaderboard(stats, mapping, 2024, 3, dt.date(2024, 3, 3)).count() == 0
    months = activity.month_or_previous(stats, 2024, 1, dt.date(2024, 1, 3))
    assert rows(months.select("month").distinct()) == [(1,)]


def test_leaderboard_summary(stats):
    def summary(year, month, day, **options):
        return tuple(activity.leaderboard_summary(stats, year, month, day, **options).first())

    january = summary(2024, 1, dt.date(2024, 1, 20))
    assert january == (2024, 1, "January 2024", 4, 3, pytest.approx(453 / 130), "shown")
    # An empty current month shows the one before; a past one shows nothing.
    assert summary(2024, 2, dt.date(2024, 2, 3)) == january
    assert summary(2024, 2, dt.date(2024, 3, 3)) == (2024, 2, "February 2024", 0, 0, 0.0, "no_statistics")
    assert summary(2024, 3, dt.date(2024, 3, 3)) == (2024, 2, "February 2024", 0, 0, 0.0, "no_statistics")
    assert summary(2024, 1, dt.date(2024, 1, 20), min_messages=1000)[4:] == (
        0,
        pytest.approx(453 / 130),
        "nobody_active",
    )


def test_leaderboard_lines(stats, mapping):
    board = activity.leaderboard(stats, mapping, 2024, 1, dt.date(2024, 1, 20), size=1)
    assert rows(activity.leaderboard_lines(board), "line") == [
        (f"{'User 3':<20} {3.0:5.2f} {31:5d} {93:7d}",)
    ]


def test_totals_in_range(stats, mapping):
    everything = activity.totals_in_range(stats, mapping)
    assert rows(everything)[0] == (1, "ann", 34, 300, 300 / 34)
    one_end = activity.totals_in_range(stats, mapping, start=dt.date(2024, 1, 1))
    assert rows(one_end)[0] == rows(everything)[0]
    december = activity.totals_in_range(stats, mapping, dt.date(2023, 12, 31), dt.date(2023, 12, 1))
    assert rows(december) == [(1, "ann", 5, 10, 2.0)]


def test_user_month(stats):
    assert rows(activity.user_month(stats, 1, 2023, 12)) == [(5, 10, 2.0)]
    assert rows(activity.user_month(stats, 9, 2023, 12)) == []


def test_personal_months_steps_of_thirty_days(spark, stats):
    author = spark.createDataFrame([(1,)], "author_id long")
    got = activity.personal_months(stats, author, dt.datetime(2024, 1, 31, tzinfo=UTC)).orderBy("step")
    dates = [dt.date(2024, 1, 31) - dt.timedelta(days=30 * i) for i in range(12)]
    assert rows(got, "year", "month") == [(d.year, d.month) for d in dates]
    assert rows(got, "total_msgs", "total_reacts", "avg_reacts")[:4] == [
        (29, 290, 10.0),
        (29, 290, 10.0),
        (5, 10, 2.0),
        (0, 0, 0.0),
    ]
    line = rows(activity.personal_lines(got).orderBy("step"), "line")[0][0]
    assert line == f"{'Jan 2024':<10} {29:>10} {290:>10} {10.0:>5.2f}"


def test_active_users(stats):
    assert {r.author_id for r in activity.active_users(stats, 2024, 1).collect()} == {2, 3, 4}


def monthly(spark, values):
    months = [(1, 2024, m, 1, v) for m, v in values.items()]
    return spark.createDataFrame(months, STATS)


def test_monthly_inflation_runs_newest_first(spark):
    base = inflation.monthly_rpm(monthly(spark, {1: 1, 2: 2, 3: 4}), 12)
    got = rows(inflation.monthly_inflation(base), "month_year", "change_percentage")
    assert sorted(got) == [("2024-01", -50.0), ("2024-02", -50.0)]
    forward = rows(inflation.monthly_inflation(base, chronological=True), "month_year", "change_percentage")
    assert sorted(forward) == [("2024-02", 100.0), ("2024-03", 100.0)]


def test_inflation_from_zero_is_zero(spark):
    base = inflation.monthly_rpm(monthly(spark, {1: 3, 2: 0}))
    assert rows(inflation.monthly_inflation(base), "month_year", "change_percentage") == [("2024-01", 0.0)]


def test_mean_of_ratios_and_ratio_of_sums(spark):
    data = spark.createDataFrame([(1, 2024, 1, 1, 4), (2, 2024, 1, 3, 0)], STATS)
    assert rows(inflation.monthly_rpm(data), "average_rpm") == [(2.0,)]
    assert rows(inflation.yearly_rpm(data), "average_rpm") == [(1.0,)]


def test_month_limit_zero_means_all(spark):
    data = monthly(spark, {m: m for m in range(1, 7)})
    assert inflation.monthly_rpm(data, 0).count() == 6
    assert rows(inflation.monthly_rpm(data, 2), "month") == [(6,), (5,)]


def test_yearly_inflation_and_bars(spark):
    data = spark.createDataFrame([(1, y, 1, 1, v) for y, v in ((2022, 1), (2023, 2), (2024, 1))], STATS)
    changes = inflation.yearly_inflation(inflation.yearly_rpm(data))
    assert rows(changes, "year", "change_percentage") == [(2023, 100.0), (2024, -50.0)]
    assert rows(inflation.yearly_inflation_bars(changes), "year", "yoy_change") == [
        (2023, 0.0),
        (2024, -50.0),
    ]


def test_rpm_from_edges(spark):
    data = spark.createDataFrame([(1, 2024, 1, 4, 0), (1, 2024, 2, 2, 0)], STATS)
    edges = spark.createDataFrame([(1, 2, 2024, 1, 6), (5, 6, 2023, 1, 7)], EDGES)
    assert rows(inflation.monthly_rpm_from_edges(data, edges)) == [
        (2024, 2, 0, 2, 0.0),
        (2024, 1, 6, 4, 1.5),
    ]
    assert rows(inflation.yearly_rpm_from_edges(data, edges)) == [(2024, 6, 6, 1.0)]


def test_volume(spark):
    data = spark.createDataFrame([(1, 2024, 1, 4, 0), (2, 2024, 1, 6, 0), (1, 2023, 12, 5, 0)], STATS)
    assert rows(volume.messages_per_month(data, 1)) == [(2024, 1, 10)]
    messages = spark.createDataFrame([(i, dt.datetime(2024, 1, 5)) for i in range(3)], "id long, ts timestamp")
    assert rows(volume.quality_ratio_per_month(messages, data)) == [(2024, 1, 3, 10, 0.3)]
    points = volume.chart_points(volume.messages_per_month(data), "total_messages")
    assert rows(points) == [("2023-12", 5, 5.2), ("2024-01", 10, 10.2)]


@pytest.fixture(scope="module")
def edges(spark):
    data = [
        (1, 2, 2024, 1, 3),
        (2, 1, 2024, 1, 1),
        (3, 1, 2023, 2, 2),
        (3, 1, 2023, 1, 9),
        (1, 1, 2024, 1, 1),
        (4, 5, 2024, 1, 2),
    ]
    return spark.createDataFrame(data, EDGES)


AS_OF = dt.datetime(2024, 2, 10, tzinfo=UTC)


def test_trade_window_is_at_month_grain(edges):
    # One year before is 2023-02-10: all of February 2023 counts, January does not.
    assert trade.trade_window(edges, AS_OF).count() == 5


def test_trade_totals(edges):
    got = {r.user_id: tuple(r)[1:] for r in trade.trade_totals(edges, AS_OF).collect()}
    assert got[1] == (4, 4, 0, "NEUTRAL")
    assert got[2] == (1, 3, 2, "SURPLUS")
    assert got[3] == (2, 0, -2, "DEFICIT")


def test_trade_of_one_user(spark, edges):
    members = spark.createDataFrame([(2, "bo", False)], MEMBERS)
    partners = trade.user_trade_partners(edges, members, 1, AS_OF)
    assert set(rows(partners, "direction", "name", "total")) == {
        ("export", "bo", 3),
        ("export", "User 1", 1),
        ("import", "bo", 1),
        ("import", "User 1", 1),
        ("import", "User 3", 2),
    }
    assert rows(trade.user_trade_summary(edges, 1, AS_OF)) == [(4, 4, 0, "NEUTRAL")]
    assert rows(trade.user_trade_summary(edges, 99, AS_OF)) == [(0, 0, 0, "NEUTRAL")]
    lines = {r.line for r in trade.partner_lines(partners).collect()}
    assert f"  {'bo':<20} {3:>6}" in lines


def test_top_partners_break_ties_by_id(spark):
    data = [(1, r, 2024, 1, 1) for r in range(20, 9, -1)]
    top = trade.top_exports(spark.createDataFrame(data, EDGES), AS_OF)
    assert sorted(rows(top, "receiver_id", "rank")) == [(10 + i, i + 1) for i in range(5)]


def test_matrix(spark, edges):
    all_time = edges.groupBy("giver_id", "receiver_id").agg(F.sum("reaction_count").alias("reaction_count"))
    members = spark.createDataFrame([(1, 0), (2, 1), (4, 2)], "author_id long, position long")
    cells = matrix.reaction_matrix(all_time, members)
    assert set(rows(cells)) == {(1, 2, 0, 1, 3), (2, 1, 1, 0, 1), (1, 1, 0, 0, 1)}
    shares = {(r.giver_id, r.receiver_id): r.percentage for r in matrix.reaction_percentages(cells).collect()}
    assert shares == {(1, 2): 75.0, (1, 1): 25.0, (2, 1): 100.0}
    cut = matrix.reaction_percentages(cells, hot_rows=1)
    assert {(r.giver_id, r.receiver_id): r.percentage for r in cut.collect()} == shares
    dense = matrix.dense_rows(cells, members, "reaction_count")
    # Member 4 gave nothing to a member: a row of zeros.
    assert sorted(rows(dense)) == [(1, [1, 3, 0]), (2, [1, 0, 0]), (4, [0, 0, 0])]
    wide = matrix.dense_rows(matrix.reaction_percentages(cells), members, "percentage")
    assert sorted(rows(wide))[2] == (4, [0.0, 0.0, 0.0])
    many = spark.range(3000).selectExpr("id * 2 as author_id", "id as position")
    row = matrix.dense_rows(cells.select("giver_id", "receiver_id", "reaction_count"), many, "reaction_count")
    found = row.where("giver_id = 2").first().row
    assert len(found) == 3000 and sum(found) == 0


def test_figure_size(spark):
    got = spark.createDataFrame([(10,), (100,)], "n long").select(
        matrix.figure_size(F.col("n")).alias("size")
    )
    assert rows(got) == [(24.0,), (60.0,)]


def test_usernames(spark):
    members = spark.createDataFrame([(1, "a\U0001f389", False), (2, "b", True)], MEMBERS)
    first = people.cleaned_usernames(members, dt.datetime(2024, 1, 1, tzinfo=UTC))
    second = people.cleaned_usernames(
        members.where("bot").withColumn("display_name", F.lit("c")), dt.datetime(2024, 1, 2, tzinfo=UTC)
    )
    latest = people.latest_usernames(second.unionByName(first))
    assert set(rows(latest, "author_id", "username")) == {(1, "a"), (2, "c")}
    assert rows(people.non_bot_members(members), "id") == [(1,)]


def test_refresh_once_a_day():
    now = dt.datetime(2024, 1, 2, tzinfo=UTC)
    assert people.refresh_due(None, now)
    assert people.refresh_due(now - dt.timedelta(days=1), now)
    assert not people.refresh_due(now - dt.timedelta(hours=23), now)


def test_standardised(spark):
    data = spark.createDataFrame([(1, 2, 5), (2, 4, 5), (3, 9, 5)], "user_id long, given long, received long")
    got = np.array(rows(clusters.standardised(data, ["given", "received"]), "z_given", "z_received"))
    x = np.array([2.0, 4.0, 9.0])
    assert np.allclose(got[:, 0], (x - x.mean()) / x.std())
    assert np.allclose(got[:, 1], 0)


def test_clusters_separate_clear_groups(spark):
    centres = {0: (5, 5), 1: (1000, 5), 2: (5, 1000), 3: (1000, 1000)}
    points = [(10 * g + i, x + i, y + i) for g, (x, y) in centres.items() for i in range(5)]
    members = spark.createDataFrame(
        [(i, f"m{i}", False) for i, _, _ in points] + [(999, "bot", True), (5, "", False)], MEMBERS
    ).dropDuplicates(["id"])
    reactions = [(i, 10_000, x) for i, x, _ in points] + [(10_001, i, y) for i, _, y in points]
    edges = spark.createDataFrame(reactions, "giver_id long, receiver_id long, reaction_count long")
    known = members.where(F.col("id") != 5)
    got = clusters.user_clusters(edges, known).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.cluster, set()).add(r.user_id // 10)
    assert len(got) == 20 and sorted(groups) == [0, 1, 2, 3]
    assert sorted(next(iter(g)) for g in groups.values()) == [0, 1, 2, 3]
    assert all(len(g) == 1 for g in groups.values())


def brute_kmeans(points, k):
    """Lists of (id, numbers): farthest-point seeds, then rounds until nothing changes."""
    n, width = len(points), range(len(points[0][1]))
    mean = [sum(x[j] for _, x in points) / n for j in width]
    dev = [
        math.sqrt(n * sum(x[j] ** 2 for _, x in points) - sum(x[j] for _, x in points) ** 2) / n or 1.0 for j in width
    ]
    far = lambda x, c: sum(((x[j] - c[j]) / dev[j]) * ((x[j] - c[j]) / dev[j]) for j in width)
    centres = []
    while len(centres) < k:
        best = max(points, key=lambda p: (min(far(p[1], c) for c in centres or [mean]), -p[0]))
        centres.append(list(best[1]))
    labels = None
    while True:
        new = {i: min(range(k), key=lambda c: (far(x, centres[c]), c)) for i, x in points}
        if new == labels:
            return labels
        labels = new
        for c in set(labels.values()):
            own = [x for i, x in points if labels[i] == c]
            centres[c] = [sum(x[j] for x in own) / len(own) for j in width]


@pytest.mark.parametrize("k", [1, 3, 4])
def test_kmeans_equals_brute_force(spark, k):
    """Random points with ties, whatever the partitions."""
    rng = random.Random(k)
    points = [(i, (rng.randrange(12), rng.randrange(12) ** 2, 7)) for i in range(150)]
    df = spark.createDataFrame([(i, *x) for i, x in points], "user_id long, a long, b long, c long")
    expected = brute_kmeans(points, k)
    for parts in (1, 5):
        got = clusters.kmeans_labels(df.repartition(parts), ["a", "b", "c"], k).collect()
        assert {r.user_id: r.cluster for r in got} == expected


def test_kmeans_with_fewer_points_than_clusters(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(9)], "user_id long, a long")
    got = clusters.kmeans_labels(df, ["a"], 4).collect()
    assert {(r.a, r.cluster) for r in got} in ({(0, 0), (1, 1)}, {(0, 1), (1, 0)})
    same = clusters.kmeans_labels(df.withColumn("a", F.lit(3)), ["a"], 4).collect()
    assert {r.cluster for r in same} == {0}


def test_clusters_need_enough_members(spark):
    members = spark.createDataFrame([(1, "a", False)], MEMBERS)
    edges = spark.createDataFrame([(1, 2, 3)], "giver_id long, receiver_id long, reaction_count long")
    with pytest.raises(ValueError):
        clusters.user_clusters(edges, members)
