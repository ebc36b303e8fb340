"""The most-liked ranking against an independent numpy power iteration."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from agorametrics.operators import influence
from agorametrics.plans import hot_keys, joins, positions, tables

EDGES = "giver_id long, receiver_id long, year int, month int, reaction_count long"
STATS = "author_id long, year int, month int, total_messages long, total_reactions long"
MAPPING = "author_id long, username string"


def power_iteration(edges, max_iter=100, tol=1e-6):
    names = sorted({n for u, v, _ in edges for n in (u, v)})
    index = {n: i for i, n in enumerate(names)}
    a = np.zeros((len(names), len(names)))
    for u, v, w in edges:
        a[index[u], index[v]] = a[index[v], index[u]] = w
    x = np.full(len(names), 1 / len(names))
    for _ in range(max_iter):
        last, x = x, x + a @ x
        x /= np.linalg.norm(x)
        if np.abs(x - last).sum() < len(names) * tol:
            return dict(zip(names, x))
    return None


def random_graph(nodes, count, seed):
    rng = np.random.default_rng(seed)
    pairs = {tuple(sorted(rng.choice(nodes, 2, replace=False))) for _ in range(count)}
    return [(f"n{u:03d}", f"n{v:03d}", float(rng.integers(1, 9)) / 50) for u, v in sorted(pairs)]


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "hot_rows": 3}])
def test_centrality(spark, options):
    graph = random_graph(30, 200, 1) + [("hub", f"n{i:03d}", 0.5) for i in range(30)]
    expected = power_iteration(graph)
    got = influence.eigenvector_centrality(
        spark.createDataFrame(graph, "u string, v string, weight double"), **options
    )
    scores = {r.node: r.score for r in got.collect()}
    assert scores.keys() == expected.keys()
    for node, score in expected.items():
        assert scores[node] == pytest.approx(score, abs=1e-9)


def test_step_limit(spark):
    path = [(f"n{i:02d}", f"n{i + 1:02d}", 0.02) for i in range(12)]
    assert power_iteration(path, max_iter=7) is None
    with pytest.raises(influence.NotConverged):
        influence.eigenvector_centrality(
            spark.createDataFrame(path, "u string, v string, weight double"), max_iter=7
        )


def test_no_edges(spark):
    empty = spark.createDataFrame([], "u string, v string, weight double")
    assert influence.eigenvector_centrality(empty).collect() == []


def named(spark, rows):
    return spark.createDataFrame(
        rows,
        "giver_id long, receiver_id long, giver_username string, receiver_username string, reaction_count long",
    )


def test_quantile_keeps_the_top(spark):
    edges = named(spark, [(1, i, "a", f"b{i}", n) for i, n in enumerate((1, 2, 3, 10))])
    kept = influence.strong_edges(edges).collect()
    # The 0.80 quantile of 1, 2, 3, 10 is 5.8 (before scaling).
    assert [(r.reaction_count, r.weight) for r in kept] == [(10, 0.2)]


def test_quantile_matches_numpy(spark):
    rng = np.random.default_rng(5)
    counts = rng.integers(1, 40, 997).tolist()
    edges = named(spark, [(i, i, "a", "b", n) for i, n in enumerate(counts)])
    limit = np.quantile(np.array(counts) / 50, 0.8)
    assert influence.strong_edges(edges).count() == sum(n / 50 >= limit for n in counts)


def test_ties_at_the_quantile_stay(spark):
    edges = named(spark, [(1, i, "a", f"b{i}", 1) for i in range(7)])
    assert influence.strong_edges(edges).count() == 7


def test_one_edge_per_pair(spark):
    edges = influence.strong_edges(
        named(
            spark,
            [(1, 2, "ann", "bo", 5), (2, 1, "bo", "ann", 7), (3, 3, "cy", "cy", 90), (4, 5, "x", "x", 90)],
        ),
        quantile=0.0,
    )
    pairs = influence.undirected_edges(edges).collect()
    assert [(r.u, r.v, r.weight) for r in pairs] == [("ann", "bo", 0.14)]
    by_id = influence.undirected_edges(edges, by_id=True).collect()
    assert {(r.u, r.v) for r in by_id} == {(1, 2), (4, 5)}


def month_tables(spark, edges, authors):
    names = sorted({u for e in edges for u in e[:2]})
    return (
        spark.createDataFrame([(g, r, 2024, 1, n) for g, r, n in edges], EDGES),
        spark.createDataFrame([(i, f"name{i}") for i in names], MAPPING),
        spark.createDataFrame([(i, 2024, 1, 3, 0) for i in authors], STATS),
    )


def test_most_liked(spark):
    edges = [(1, 2, 9), (2, 3, 9), (3, 1, 9), (4, 1, 9), (5, 1, 9), (6, 1, 9), (7, 1, 99)]
    frames = month_tables(spark, edges, authors=[1, 2, 3, 4, 5, 6])
    # Author 7 wrote nothing in the month, so the strongest tie does not count.
    got = influence.most_liked(*frames, 2024, 1, dt.date(2024, 1, 20))
    expected = power_iteration([(f"name{min(g, r)}", f"name{max(g, r)}", n / 50) for g, r, n in edges[:6]])
    ranked = sorted(expected.items(), key=lambda item: (-item[1], item[0]))[:5]
    assert [r.user for r in got.collect()][0] == "name1"
    assert {r.user: round(r.score, 9) for r in got.collect()}.keys() <= expected.keys()
    assert [round(r.score, 6) for r in got.collect()] == [round(s, 6) for _, s in ranked]
    later = influence.most_liked(*frames, 2024, 2, dt.date(2024, 2, 20))
    assert [r.user for r in later.collect()] == [r.user for r in got.collect()]
    lines = influence.most_liked_lines(got).collect()
    assert lines[0].line == f"{'name1':<20} {expected['name1']:>8.2f}"


def test_most_liked_without_data(spark):
    frames = month_tables(spark, [(1, 2, 9)], authors=[1, 2])
    assert influence.most_liked(*frames, 2023, 5, dt.date(2024, 1, 20)).collect() == []


def test_most_liked_outcomes(spark):
    def head(edges, authors, year=2024, month=1, as_of=dt.date(2024, 1, 20), **options):
        frames = month_tables(spark, edges, authors=authors)
        summary, ranking = influence.most_liked_report(*frames, year, month, as_of, **options)
        return tuple(summary.first()), ranking.count()

    ring = [(1, 2, 9), (2, 3, 9), (3, 1, 9)]
    assert head(ring, [1, 2, 3]) == ((2024, 1, "January 2024", 3, 3, "shown"), 3)
    february = {"month": 2, "as_of": dt.date(2024, 2, 3)}
    assert head(ring, [1, 2, 3], **february) == ((2024, 1, "January 2024", 3, 3, "shown"), 3)
    assert head(ring, [1, 2, 3], year=2023, month=5) == ((2023, 5, "May 2023", 0, 0, "no_data"), 0)
    # The only edge is a loop.
    assert head([(1, 1, 9)], [1]) == ((2024, 1, "January 2024", 1, 0, "too_few"), 0)
    star = [(1, n, 9) for n in range(2, 7)]
    assert head(star, range(1, 7), max_iter=1) == ((2024, 1, "January 2024", 5, 5, "not_settled"), 0)


def test_hot_keys_are_cut(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") < 400, 1).otherwise(F.col("id")).cast("long").alias("k"), "id"
    )
    hot = hot_keys.hot_keys(rows, "k", max_keys=10, min_rows=1)
    assert [tuple(r) for r in hot.collect()] == [(1, 4)]
    cut = hot_keys.cut_rows(rows, "k", "id", hot)
    assert cut.where("k = 1").select("piece").distinct().count() == 4
    names = rows.select("k").distinct().withColumn("name", F.concat(F.lit("n"), "k"))
    joined = cut.join(hot_keys.copy_to_pieces(names, "k", hot), ["k", "piece"])
    assert joined.count() == 1000
    assert joined.where(F.col("name") != F.concat(F.lit("n"), "k")).count() == 0


def test_joins_with_a_hot_key(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") < 400, 1).otherwise(F.col("id")).cast("long").alias("k"), "id"
    )
    names = rows.select("k").distinct().withColumn("name", F.concat(F.lit("n"), "k"))
    plain = sorted(tuple(r) for r in rows.join(names, "k").select("k", "id", "name").collect())
    for options in ({}, {"max_rows": 5}, {"max_rows": 5, "hot_rows": 50}):
        got = joins.join_dimension(rows, names, "k", "id", **options).select("k", "id", "name")
        assert sorted(tuple(r) for r in got.collect()) == plain
    few = rows.where("id < 3 or id = 500").union(spark.createDataFrame([(-1, -1)], "k long, id long"))
    got = joins.few_rows_with(few, names, "k").collect()
    assert sorted((r.k, r.name) for r in got) == [(-1, None), (1, "n1"), (1, "n1"), (1, "n1"), (500, "n500")]


def test_positions(spark):
    ids = spark.range(1000).select((F.col("id") * 7919 % 10007).alias("author_id"))
    got = positions.with_position(ids, "author_id").orderBy("author_id").collect()
    assert [r.position for r in got] == list(range(1000))


def test_work_folder_is_the_configured_one(spark):
    assert tables.work_folder(spark) == spark.conf.get("spark.checkpoint.dir")
