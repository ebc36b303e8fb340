"""Reaction trade: what users give to and receive from each other."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agorametrics import fixed_values as fixed
from agorametrics.functions import cells
from agorametrics.functions.months import from_month
from agorametrics.functions.text import member_name
from agorametrics.plans.joins import few_rows_with
from agorametrics.plans.tables import write_once


def trade_window(edges: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Edges since the month of one year ago; up to thirteen calendar months."""
    since = as_of - dt.timedelta(days=fixed.TRADE_WINDOW_DAYS)
    return edges.where(from_month(since.year, since.month))


def _top_partners(edges: DataFrame, user: str, partner: str, total: str, size: int) -> DataFrame:
    sums = edges.groupBy(user, partner).agg(F.sum("reaction_count").alias(total))
    # The rank limit is applied before the shuffle too, so that a user with very many
    # partners sends only a few rows per task to the ranking.
    rank = F.row_number().over(W.partitionBy(user).orderBy(F.desc(total), partner))
    return sums.withColumn("rank", rank).where(F.col("rank") <= size)


def top_exports(edges: DataFrame, as_of: dt.datetime, size: int = fixed.TRADE_PARTNERS) -> DataFrame:
    """The receivers each giver gave most to."""
    return _top_partners(trade_window(edges, as_of), "giver_id", "receiver_id", "total_given", size)


def top_imports(edges: DataFrame, as_of: dt.datetime, size: int = fixed.TRADE_PARTNERS) -> DataFrame:
    """The givers each receiver got most from."""
    return _top_partners(trade_window(edges, as_of), "receiver_id", "giver_id", "total_received", size)


def given_and_received(edges: DataFrame) -> DataFrame:
    """Reactions given and received per user, from one scan and one shuffle."""
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("giver_id").alias("user_id"),
            F.col("reaction_count").alias("given"),
            zero.alias("received"),
        ),
        F.struct(
            F.col("receiver_id").alias("user_id"),
            zero.alias("given"),
            F.col("reaction_count").alias("received"),
        ),
    )
    return (
        edges.select(F.inline(sides))
        .groupBy("user_id")
        .agg(F.sum("given").alias("given"), F.sum("received").alias("received"))
    )


def trade_status(balance: Column) -> Column:
    return (
        F.when(balance > 0, fixed.STATUS_SURPLUS)
        .when(balance == 0, fixed.STATUS_NEUTRAL)
        .otherwise(fixed.STATUS_DEFICIT)
    )


def trade_totals(edges: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Totals, balance and status of every user with any reaction in the window."""
    balance = F.col("received") - F.col("given")
    return given_and_received(trade_window(edges, as_of)).select(
        "user_id",
        F.col("given").alias("total_given"),
        F.col("received").alias("total_received"),
        balance.alias("trade_balance"),
        trade_status(balance).alias("status"),
    )


def edges_with(edges: DataFrame, user_id: int, as_of: dt.datetime) -> DataFrame:
    """The edges of the window that one user is part of."""
    return trade_window(edges, as_of).where(
        (F.col("giver_id") == user_id) | (F.col("receiver_id") == user_id)
    )


def user_edges(edges: DataFrame, user_id: int, as_of: dt.datetime) -> DataFrame:
    """One user's partners with reactions given and received, from one scan."""
    mine = edges_with(edges, user_id, as_of)
    given = F.when(
        F.col("giver_id") == user_id,
        F.struct(
            F.col("receiver_id").alias("partner_id"),
            F.col("reaction_count").alias("given"),
            F.lit(None).cast("bigint").alias("received"),
        ),
    )
    received = F.when(
        F.col("receiver_id") == user_id,
        F.struct(
            F.col("giver_id").alias("partner_id"),
            F.lit(None).cast("bigint").alias("given"),
            F.col("reaction_count").alias("received"),
        ),
    )
    return (
        mine.select(F.inline(F.array_compact(F.array(given, received))))
        .groupBy("partner_id")
        .agg(F.sum("given").alias("given"), F.sum("received").alias("received"))
    )


def user_trade_partners(
    edges: DataFrame,
    members: DataFrame,
    user_id: int,
    as_of: dt.datetime,
    size: int = fixed.TRADE_PARTNERS,
) -> DataFrame:
    """The trade report of one user: top partners of both directions, by name."""
    partners = user_edges(edges, user_id, as_of)

    def top(direction: str, column: str) -> DataFrame:
        return (
            partners.where(F.col(column).isNotNull())
            .orderBy(F.desc(column), "partner_id")
            .limit(size)
            .select(F.lit(direction).alias("direction"), "partner_id", F.col(column).alias("total"))
        )

    both = write_once(top("export", "given").unionByName(top("import", "received")), "partners")
    names = members.select(F.col("id").alias("partner_id"), "display_name")
    return few_rows_with(both, names, "partner_id").select(
        "direction",
        "partner_id",
        member_name(F.col("display_name"), F.col("partner_id")).alias("name"),
        "total",
    )


def user_trade_summary(edges: DataFrame, user_id: int, as_of: dt.datetime) -> DataFrame:
    """One user's totals over all partners; one row, zeros for a user without any."""
    given = F.when(F.col("giver_id") == user_id, F.col("reaction_count"))
    received = F.when(F.col("receiver_id") == user_id, F.col("reaction_count"))
    zero = F.lit(0).cast("bigint")
    totals = (
        edges_with(edges, user_id, as_of)
        .agg(
            F.coalesce(F.sum(given), zero).alias("total_given"),
            F.coalesce(F.sum(received), zero).alias("total_received"),
        )
    )
    balance = F.col("total_received") - F.col("total_given")
    return totals.withColumn("trade_balance", balance).withColumn("status", trade_status(balance))


def partner_lines(partners: DataFrame) -> DataFrame:
    return partners.select(
        "direction",
        "partner_id",
        F.concat(
            F.lit("  "),
            cells.left_cell(F.col("name"), fixed.NAME_WIDTH),
            F.lit(" "),
            cells.right_cell(F.col("total"), 6),
        ).alias("line"),
    )
