"""Most-liked users: eigenvector centrality of the strongest reaction ties of a month."""

from __future__ import annotations

import datetime as dt

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametrics import fixed_values as fixed
from agorametrics.functions import cells
from agorametrics.functions.months import month_number
from agorametrics.operators.activity import month_candidates, month_or_previous, shown_month
from agorametrics.plans.hot_keys import MIN_HOT_ROWS, copy_to_pieces, cut_rows, hot_keys
from agorametrics.plans.tables import new_folder, write_once, write_table

RANKING = "user string, score double"

# Power steps per written table. More steps mean fewer writes and a longer lineage.
STEPS_PER_TABLE = 4

# Up to this size a vector is broadcast.
BROADCAST_BYTES = 10 * 1024 * 1024


class NotConverged(Exception):
    """The power iteration did not settle within its step limit."""


def named_edges(edges: DataFrame, mapping: DataFrame, stats: DataFrame) -> DataFrame:
    """Edges between mapped users who both wrote messages in the edge's month."""

    def side(role: str) -> DataFrame:
        # Username and messages of one side share its key: the edges move once per side.
        names = mapping.select(
            F.col("author_id").alias(f"{role}_id"), F.col("username").alias(f"{role}_username")
        )
        counts = stats.select(
            F.col("author_id").alias(f"{role}_id"),
            "year",
            "month",
            F.col("total_messages").alias(f"{role}_messages"),
        )
        return counts.join(names, f"{role}_id")

    return (
        edges.join(side("giver"), ["giver_id", "year", "month"])
        .join(side("receiver"), ["receiver_id", "year", "month"])
        .select(
            "giver_id",
            "receiver_id",
            "year",
            "month",
            "giver_username",
            "receiver_username",
            "reaction_count",
            "giver_messages",
            "receiver_messages",
        )
    )


def strong_edges(edges: DataFrame, quantile: float = fixed.EDGE_QUANTILE) -> DataFrame:
    """Edges with a weight at or above the quantile of all weights, ties kept.

    The exact quantile is taken over the histogram of weights. N different reaction
    counts need at least N * (N + 1) / 2 reactions, so the histogram stays small however
    many edges there are.
    """
    weighted = edges.withColumn("weight", F.col("reaction_count") / fixed.EDGE_WEIGHT_SCALE)
    histogram = weighted.groupBy("weight").agg(F.count("*").alias("edges"))
    threshold = histogram.agg(F.percentile("weight", quantile, F.col("edges"))).scalar()
    return weighted.where(F.col("weight") >= threshold)


def undirected_edges(edges: DataFrame, by_id: bool = False) -> DataFrame:
    """One edge ``(u, v, weight)`` per pair of users, without loops.

    Users are told apart by username, or by id on request. When both directions (or
    several ids with one name) give the same pair, the one with the largest giver and
    receiver id counts.
    """
    giver, receiver = ("giver_id", "receiver_id") if by_id else ("giver_username", "receiver_username")
    return (
        edges.where(F.col(giver) != F.col(receiver))
        .groupBy(F.least(giver, receiver).alias("u"), F.greatest(giver, receiver).alias("v"))
        .agg(F.max_by("weight", F.struct("giver_id", "receiver_id")).alias("weight"))
    )


def month_edges(
    edges: DataFrame, mapping: DataFrame, stats: DataFrame, year: int, month: int, as_of: dt.date
) -> DataFrame:
    """Named edges of a month; when a current or future one has none, of the month before."""
    candidates = named_edges(
        month_candidates(edges, year, month, as_of), mapping, month_candidates(stats, year, month, as_of)
    )
    # Read for the month, the quantile and the edges: write the joined edges once.
    return month_or_previous(write_once(candidates, "named-edges"), year, month, as_of)


def most_liked_edges(
    edges: DataFrame, mapping: DataFrame, stats: DataFrame, year: int, month: int, as_of: dt.date
) -> DataFrame:
    """The graph the ranking is computed on.

    When no edge of the current or a future month is left, the month before counts.
    """
    return undirected_edges(strong_edges(month_edges(edges, mapping, stats, year, month, as_of)))


def eigenvector_centrality(
    edges: DataFrame,
    max_iter: int = fixed.CENTRALITY_MAX_ITER,
    tol: float = fixed.CENTRALITY_TOLERANCE,
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Centrality ``(node, score)`` of the undirected weighted graph ``edges(u, v, weight)``.

    Power iteration on A + I from the uniform vector. It stops at the first step that
    changes the normalised vector by less than ``nodes * tol`` in total, and raises
    :class:`NotConverged` when no step up to ``max_iter`` does.

    A vector of at most ``broadcast_bytes`` is broadcast. Beyond that the adjacency is
    partitioned once and kept, and each step moves only the vector and partial sums;
    nodes with more than ``hot_rows`` neighbours are cut into pieces if need be.
    """
    spark = edges.sparkSession
    arcs = write_once(_arcs(edges), "arcs")
    nodes = arcs.where("own").select(F.col("src").alias("node"))
    row = nodes.agg(F.count("*"), F.sum(F.octet_length(F.col("node").cast("string")))).first()
    size, text_bytes = row[0], row[1] or 0
    if size == 0:
        return nodes.withColumn("score", F.lit(0.0))
    # Per row: the name, the value, and the overhead of a row in a hash table.
    small = text_bytes + size * 64 <= broadcast_bytes
    if small:
        hot, adjacency = None, arcs
    else:
        hot = write_once(hot_keys(arcs, "src", min_rows=hot_rows), "hot-nodes")
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if hot.isEmpty():
            hot, adjacency = None, arcs.repartition(partitions, "src")
        else:
            adjacency = cut_rows(arcs, "src", "dst", hot).repartition(partitions, "src", "piece")
    adjacency = adjacency.persist(StorageLevel.MEMORY_AND_DISK)

    def step(vector: DataFrame, number: int) -> DataFrame:
        """Column s<number> = (A + I) s<number - 1>; the columns before are carried along.

        The vector is used once, so that the plan of several steps stays a chain.
        """
        values = vector.withColumnRenamed("node", "src")
        keys = ["src"]
        if small:
            values = F.broadcast(values)
        elif hot is not None:
            values, keys = copy_to_pieces(values, "src", hot), ["src", "piece"]
        kept = [f"s{i}" for i in range(number)]
        return (
            adjacency.join(values, keys)
            .groupBy(F.col("dst").alias("node"))
            .agg(
                *[F.sum(F.when(F.col("own"), F.col(c))).alias(c) for c in kept],
                F.sum(F.col("weight") * F.col(kept[-1])).alias(f"s{number}"),
            )
        )

    try:
        vector = nodes.withColumn("s0", F.lit(1.0 / size))
        # Two folders in turn: the one being read is never the one being written.
        folders = [new_folder(spark, "power-a"), new_folder(spark, "power-b")]
        for done in range(0, max_iter, STEPS_PER_TABLE):
            steps = min(STEPS_PER_TABLE, max_iter - done)
            for number in range(1, steps + 1):
                vector = step(vector, number)
            table = write_table(vector, folders[done // STEPS_PER_TABLE % 2])
            norms, changes = _progress(table, steps)
            for number in range(1, steps + 1):
                if changes[number - 1] < size * tol:
                    return table.select("node", (F.col(f"s{number}") / norms[number]).alias("score"))
            vector = table.select("node", (F.col(f"s{steps}") / norms[steps]).alias("s0"))
        raise NotConverged(f"no convergence within {max_iter} steps")
    finally:
        adjacency.unpersist()


def _arcs(edges: DataFrame) -> DataFrame:
    """A + I as rows ``(src, dst, weight, own)``: both directions and a loop per node."""
    ends = F.array(
        F.struct(F.col("u").alias("src"), F.col("v").alias("dst")),
        F.struct(F.col("v").alias("src"), F.col("u").alias("dst")),
    )
    both = edges.select(F.inline(ends), "weight", F.lit(False).alias("own"))
    loops = both.select("src").distinct().select(
        "src",
        F.col("src").alias("dst"),
        F.lit(1.0).alias("weight"),
        F.lit(True).alias("own"),
    )
    return both.unionByName(loops)


def _progress(table: DataFrame, steps: int) -> tuple[list[float], list[float]]:
    """Norm of each step's vector, and how much each step changed the normalised vector."""
    row = table.agg(
        *[F.sqrt(F.sum(F.col(f"s{i}") * F.col(f"s{i}"))).alias(f"n{i}") for i in range(steps + 1)]
    ).first()
    norms = [row[f"n{i}"] or 1.0 for i in range(steps + 1)]
    # The first vector is compared as it is: uniform at the start, normalised later.
    norms[0] = 1.0
    changes = table.agg(
        *[
            F.sum(F.abs(F.col(f"s{i}") / norms[i] - F.col(f"s{i - 1}") / norms[i - 1])).alias(f"c{i}")
            for i in range(1, steps + 1)
        ]
    ).first()
    return norms, [changes[f"c{i}"] for i in range(1, steps + 1)]


def top_nodes(centrality: DataFrame, size: int = fixed.MOST_LIKED_SIZE) -> DataFrame:
    return (
        centrality.select(F.col("node").alias("user"), "score")
        .orderBy(F.desc("score"), "user")
        .limit(size)
    )


def most_liked_report(
    edges: DataFrame,
    mapping: DataFrame,
    stats: DataFrame,
    year: int,
    month: int,
    as_of: dt.date,
    size: int = fixed.MOST_LIKED_SIZE,
    max_iter: int = fixed.CENTRALITY_MAX_ITER,
) -> tuple[DataFrame, DataFrame]:
    """The head of the ranking, one row, and the highest-ranked users of the month.

    The head has the month shown, its edges, the ties that the ranking is computed on, and the
    outcome: ``shown``, ``no_data`` (no edges), ``too_few`` (no tie between two users) or
    ``not_settled``. The ranking is empty unless it is shown.
    """
    shown = month_edges(edges, mapping, stats, year, month, as_of)
    graph = write_once(undirected_edges(strong_edges(shown)), "graph")
    try:
        ranking, settled = top_nodes(eigenvector_centrality(graph, max_iter), size), True
    except NotConverged:
        ranking, settled = edges.sparkSession.createDataFrame([], RANKING), False
    counts = shown.agg(F.max(month_number()).alias("number"), F.count("*").alias("edges"))
    ties = graph.agg(F.count("*")).scalar()
    head = counts.withColumn("ties", ties).select(
        *shown_month(F.col("number"), year, month, as_of),
        "edges",
        "ties",
        F.when(F.col("edges") == 0, "no_data")
        .when(F.col("ties") == 0, "too_few")
        .otherwise("shown" if settled else "not_settled")
        .alias("outcome"),
    )
    return head, ranking


def most_liked(
    edges: DataFrame,
    mapping: DataFrame,
    stats: DataFrame,
    year: int,
    month: int,
    as_of: dt.date,
    size: int = fixed.MOST_LIKED_SIZE,
) -> DataFrame:
    """The highest-ranked users of a month.

    Empty when there are no edges, or too few for the ranking to settle.
    """
    return most_liked_report(edges, mapping, stats, year, month, as_of, size)[1]


def most_liked_lines(ranking: DataFrame) -> DataFrame:
    return ranking.select(
        "user", cells.line(cells.name_cell(F.col("user")), cells.decimal_cell(F.col("score"), 8))
    )
