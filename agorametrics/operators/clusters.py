"""Clusters of users by reactions given and received."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorametrics import fixed_values as fixed
from agorametrics.functions.text import member_name
from agorametrics.operators.members import non_bot_members
from agorametrics.operators.trade import given_and_received
from agorametrics.plans.tables import write_once


def member_reactions(reactions: DataFrame, members: DataFrame) -> DataFrame:
    """Reactions given and received of ``members(user_id)``; zeros for those without any."""
    zero = F.lit(0).cast("bigint")
    return members.join(given_and_received(reactions), "user_id", "left").select(
        "user_id",
        F.coalesce("given", zero).alias("given"),
        F.coalesce("received", zero).alias("received"),
    )


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns ``z_<name>``: zero mean, unit population deviation; zero for a constant."""
    moments = df.agg(
        *[F.avg(c).alias(f"avg_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"dev_{c}") for c in columns],
    ).first()

    def scaled(name: str) -> Column:
        deviation = moments[f"dev_{name}"] or 1.0
        return ((F.col(name) - moments[f"avg_{name}"]) / deviation).alias(f"z_{name}")

    return df.select("*", *[scaled(c) for c in columns])


def _spread(points: DataFrame, columns: list[str]) -> list[tuple[float, float]]:
    """Mean and population deviation of columns of whole numbers, from exact sums.

    Exact sums don't depend on the order of the rows, so all that follows is the same on each run.
    """
    whole = "decimal(38,0)"
    sums = [F.sum(F.col(c).cast(whole)).alias(f"sum_{c}") for c in columns]
    squares = [F.sum((F.col(c) * F.col(c)).cast(whole)).alias(f"squares_{c}") for c in columns]
    row = points.agg(F.count("*").alias("n"), *sums, *squares).first()

    def of(name: str) -> tuple[float, float]:
        n, total, squared = row["n"], int(row[f"sum_{name}"]), int(row[f"squares_{name}"])
        # Whole numbers up to the root: a constant column has no spread at all.
        return total / n, math.sqrt(n * squared - total * total) / n or 1.0

    return [of(c) for c in columns]


def _distance(columns: list[str], centre: list[float], deviations: list[float]) -> Column:
    """Squared distance to ``centre``, each column in units of its deviation."""
    steps = [(F.col(c) - F.lit(at)) / F.lit(dev) for c, at, dev in zip(columns, centre, deviations, strict=True)]
    return functools.reduce(Column.__add__, [step * step for step in steps])


def _nearest(columns: list[str], centres: list[list[float]], deviations: list[float]) -> Column:
    """(distance, cluster) of the nearest centre, the first of equals."""
    each = [
        F.struct(_distance(columns, centre, deviations).alias("distance"), F.lit(k).alias("cluster"))
        for k, centre in enumerate(centres)
    ]
    return F.array_min(F.array(*each))


def farthest_points(
    points: DataFrame, columns: list[str], k: int, key: str, spread: list[tuple[float, float]]
) -> list[list[float]]:
    """``k`` rows as first centres: the one farthest from the mean, then each time the one farthest
    from its nearest centre so far. Ties go to the smallest key.

    Each is one aggregate that keeps a single candidate per task. Fewer come back if the rows
    hold fewer different points.
    """
    means, deviations = [m for m, _ in spread], [d for _, d in spread]
    centres: list[list[float]] = []
    while len(centres) < k:
        near = _nearest(columns, centres or [means], deviations).getField("distance")
        row = points.agg(F.max(F.struct(near.alias("distance"), (-F.col(key)).alias("key"), *columns)).alias("r")).first()["r"]
        if centres and not row["distance"] > 0:
            break
        centres.append([float(row[c]) for c in columns])
    return centres


def kmeans_labels(
    points: DataFrame, columns: list[str], k: int = fixed.CLUSTERS, key: str = "user_id", rounds: int = fixed.CLUSTER_ROUNDS
) -> DataFrame:
    """Add ``cluster`` by Lloyd's k-means over standardised ``columns`` of whole numbers.

    Starts from farthest points, so it needs no seed, and the clusters are numbered in that order.
    A round is one aggregate: the ``k`` centres stand in the plan as constants, each row finds its
    nearest, ties to the first, and sums combine before the shuffle. A centre without rows stays. It
    ends when a round changes no row, or after ``rounds``. ``points`` is read once a round, so it
    should be a written table.
    """
    if len(points.limit(k).collect()) < k:
        raise ValueError(f"clustering into {k} groups needs at least {k} rows")
    spread = _spread(points, columns)
    deviations = [d for _, d in spread]
    centres = farthest_points(points, columns, k, key, spread)
    before: list[list[float]] | None = None
    for _ in range(rounds):
        now = _nearest(columns, centres, deviations).getField("cluster")
        was = F.lit(-1) if before is None else _nearest(columns, before, deviations).getField("cluster")
        labelled = points.select(now.alias("cluster"), was.alias("was"), *columns)
        sums = labelled.groupBy("cluster").agg(
            F.count("*").alias("n"),
            F.sum((F.col("cluster") != F.col("was")).cast("long")).alias("changed"),
            *(F.sum(c).alias(c) for c in columns),
        ).collect()
        if not sum(r["changed"] for r in sums):
            break
        before, centres = centres, list(centres)
        for r in sums:
            centres[r["cluster"]] = [r[c] / r["n"] for c in columns]
    return points.withColumn("cluster", _nearest(columns, centres, deviations).getField("cluster"))


def user_clusters(reactions: DataFrame, members: DataFrame, k: int = fixed.CLUSTERS) -> DataFrame:
    """Cluster of every member who is not a bot, by reactions given and received."""
    people = non_bot_members(members)
    totals = member_reactions(reactions, people.select(F.col("id").alias("user_id")))
    # Every k-means round reads the points again: write the aggregated counts once.
    points = write_once(totals, "cluster-points")
    labelled = kmeans_labels(points, ["given", "received"], k)
    return labelled.join(people.withColumnRenamed("id", "user_id"), "user_id", "left").select(
        "user_id",
        member_name(F.col("display_name"), F.col("user_id")).alias("user"),
        "given",
        "received",
        "cluster",
    )
