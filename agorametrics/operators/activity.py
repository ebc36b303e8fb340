"""Reactions per message: leaderboard, personal series, active users."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorametrics import fixed_values as fixed
from agorametrics.functions import cells
from agorametrics.functions.months import (
    from_month,
    in_month,
    month_label,
    month_number,
    shift_month,
    until_month,
)
from agorametrics.functions.numbers import ratio, ratio_or_zero
from agorametrics.functions.text import name_or_id
from agorametrics.plans.joins import few_rows_with
from agorametrics.plans.tables import write_once


def totals_in_range(
    stats: DataFrame,
    mapping: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Totals per author over a month range; the range counts only with both ends."""
    if start and end:
        stats = stats.where(from_month(start.year, start.month) & until_month(end.year, end.month))
    totals = stats.groupBy("author_id").agg(
        F.sum("total_messages").alias("total_msgs"), F.sum("total_reactions").alias("total_reacts")
    )
    return (
        totals.join(mapping.select("author_id", "username"), "author_id", "left")
        .select(
            "author_id",
            "username",
            "total_msgs",
            "total_reacts",
            ratio(F.col("total_reacts"), F.col("total_msgs")).alias("avg_reacts"),
        )
        .orderBy(F.desc("avg_reacts"), "author_id")
    )


def month_totals(month_stats: DataFrame, mapping: DataFrame) -> DataFrame:
    return month_stats.join(mapping.select("author_id", "username"), "author_id", "left").select(
        "author_id",
        "username",
        F.col("total_messages").alias("total_msgs"),
        F.col("total_reactions").alias("total_reacts"),
        ratio(F.col("total_reactions"), F.col("total_messages")).alias("avg_reacts"),
    )


def monthly_stats(stats: DataFrame, mapping: DataFrame, year: int, month: int) -> DataFrame:
    """All authors of one month, highest reactions per message first."""
    return month_totals(stats.where(in_month(year, month)), mapping).orderBy(
        F.desc("avg_reacts"), "author_id"
    )


def user_month(stats: DataFrame, author_id: int, year: int, month: int) -> DataFrame:
    """One author's month; no row when there is none."""
    return stats.where((F.col("author_id") == author_id) & in_month(year, month)).select(
        F.col("total_messages").alias("total_msgs"),
        F.col("total_reactions").alias("total_reacts"),
        ratio(F.col("total_reactions"), F.col("total_messages")).alias("avg_reacts"),
    )


def month_candidates(df: DataFrame, year: int, month: int, as_of: dt.date) -> DataFrame:
    """Rows of a month; with the month before it if it is the current or a future one."""
    if (year, month) < (as_of.year, as_of.month):
        return df.where(in_month(year, month))
    return df.where(in_month(year, month) | in_month(*shift_month(year, month, -1)))


def month_or_previous(df: DataFrame, year: int, month: int, as_of: dt.date) -> DataFrame:
    """Rows of a month; an empty current or future month falls back to the one before.

    Reads at most two month partitions and needs no extra action.
    """
    candidates = month_candidates(df, year, month, as_of)
    if (year, month) < (as_of.year, as_of.month):
        return candidates
    latest = candidates.agg(F.max(month_number())).scalar()
    return candidates.where(month_number() == latest)


def leaderboard(
    stats: DataFrame,
    mapping: DataFrame,
    year: int,
    month: int,
    as_of: dt.date,
    least: bool = False,
    all_users: bool = False,
    min_messages: int = fixed.ACTIVE_MIN_MESSAGES,
    size: int = fixed.LEADERBOARD_SIZE,
) -> DataFrame:
    """Reactions per message of active users, with the average over all users."""
    month_rows = month_or_previous(stats, year, month, as_of)
    server_avg = month_rows.agg(
        ratio_or_zero(F.sum("total_reactions"), F.sum("total_messages"))
    ).scalar()
    average = F.col("avg_reacts").asc() if least else F.col("avg_reacts").desc()
    board = month_rows.where(F.col("total_messages") >= min_messages).select(
        "author_id",
        F.col("total_messages").alias("total_msgs"),
        F.col("total_reactions").alias("total_reacts"),
        ratio(F.col("total_reactions"), F.col("total_messages")).alias("avg_reacts"),
        server_avg.alias("server_avg"),
    )
    names = mapping.select("author_id", "username")
    if all_users:
        named = board.join(names, "author_id", "left")
    else:
        top = write_once(board.orderBy(average, "author_id").limit(size), "leaderboard")
        named = few_rows_with(top, names, "author_id")
    return named.select(
        "author_id",
        name_or_id(F.col("username"), F.col("author_id")).alias("display_name"),
        "avg_reacts",
        "total_msgs",
        "total_reacts",
        "server_avg",
    ).orderBy(average, "author_id")


def shown_month(newest: Column, year: int, month: int, as_of: dt.date) -> list[Column]:
    """``year, month`` and the label of the month ``newest``; null stands for no rows in any.

    Without rows it is the month asked for, or the one before if that is the current or a future one.
    """
    if (year, month) >= (as_of.year, as_of.month):
        year, month = shift_month(year, month, -1)
    zero_based = F.coalesce(newest, F.lit(year * 12 + month)) - 1
    keys = [F.floor(zero_based / 12).cast("int"), (zero_based % 12 + 1).cast("int")]
    return [
        keys[0].alias("year"),
        keys[1].alias("month"),
        month_label(fixed.MONTH_LONG, *keys).alias("month_name"),
    ]


def leaderboard_summary(
    stats: DataFrame,
    year: int,
    month: int,
    as_of: dt.date,
    min_messages: int = fixed.ACTIVE_MIN_MESSAGES,
) -> DataFrame:
    """The head of a leaderboard, one row: the month shown, the average, and the outcome.

    The outcome is ``shown``, ``no_statistics`` (nobody wrote) or ``nobody_active`` (nobody
    wrote ``min_messages``). ``stats`` has one row per author and month. One aggregate.
    """
    months = (
        month_candidates(stats, year, month, as_of)
        .groupBy(month_number().alias("number"))
        .agg(
            F.count("*").alias("users"),
            F.count_if(F.col("total_messages") >= min_messages).alias("active_users"),
            ratio_or_zero(F.sum("total_reactions"), F.sum("total_messages")).alias("server_avg"),
        )
    )
    newest = months.agg(F.max(F.struct(*months.columns)).alias("newest")).select("newest.*")
    users, active = (F.coalesce(c, F.lit(0).cast("bigint")) for c in ("users", "active_users"))
    return newest.select(
        *shown_month(F.col("number"), year, month, as_of),
        users.alias("users"),
        active.alias("active_users"),
        F.coalesce("server_avg", F.lit(0.0)).alias("server_avg"),
        F.when(users == 0, "no_statistics").when(active == 0, "nobody_active").otherwise("shown").alias("outcome"),
    )


def leaderboard_lines(board: DataFrame) -> DataFrame:
    """The rows of a leaderboard as monospace text."""
    return board.select(
        "author_id",
        cells.line(
            cells.name_cell(F.col("display_name")),
            cells.decimal_cell(F.col("avg_reacts"), 5),
            cells.right_cell(F.col("total_msgs"), 5),
            cells.right_cell(F.col("total_reacts"), 7),
        ),
    )


def personal_months(stats: DataFrame, authors: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Twelve steps of thirty days back from ``as_of`` for each of ``authors(author_id)``.

    The steps are days, not months: a calendar month may come twice or not at all.
    """
    step_date = F.date_sub(F.lit(as_of.date()), F.col("step") * fixed.PERSONAL_STEP_DAYS)
    spine = (
        authors.select(
            "author_id",
            F.explode(F.sequence(F.lit(0), F.lit(fixed.PERSONAL_MONTHS - 1))).alias("step"),
        )
        .withColumn("year", F.year(step_date))
        .withColumn("month", F.month(step_date))
    )
    oldest = as_of.date() - dt.timedelta(days=fixed.PERSONAL_STEP_DAYS * (fixed.PERSONAL_MONTHS - 1))
    window = stats.where(from_month(oldest.year, oldest.month) & until_month(as_of.year, as_of.month))
    zero = F.lit(0).cast("bigint")
    return spine.join(window, ["author_id", "year", "month"], "left").select(
        "author_id",
        "step",
        "year",
        "month",
        month_label(fixed.MONTH_SHORT).alias("month_name"),
        F.coalesce("total_messages", zero).alias("total_msgs"),
        F.coalesce("total_reactions", zero).alias("total_reacts"),
        ratio_or_zero(F.col("total_reactions"), F.col("total_messages")).alias("avg_reacts"),
    )


def personal_lines(months: DataFrame) -> DataFrame:
    return months.select(
        "author_id",
        "step",
        cells.line(
            cells.left_cell(F.col("month_name"), 10),
            cells.right_cell(F.col("total_msgs"), 10),
            cells.right_cell(F.col("total_reacts"), 10),
            cells.decimal_cell(F.col("avg_reacts"), 5),
        ),
    )


def active_users(
    stats: DataFrame, year: int, month: int, min_messages: int = fixed.ACTIVE_MIN_MESSAGES
) -> DataFrame:
    return stats.where(in_month(year, month) & (F.col("total_messages") >= min_messages)).select(
        "author_id"
    )
