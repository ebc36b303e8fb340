"""Reaction inflation by month and by year.

The series have one row per calendar month or year, so the windows over a whole series
hold a few hundred rows at most, whatever the size of the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agorametrics import fixed_values as fixed
from agorametrics.functions.months import year_month
from agorametrics.functions.numbers import (
    exact_round,
    percent_change,
    ratio,
    ratio_or_zero,
    sum_or_zero,
)


def _latest(df: DataFrame, months: int | None) -> DataFrame:
    """The newest months first; no number means all of them."""
    ordered = df.orderBy(F.desc("year"), F.desc("month"))
    return ordered.limit(months) if months else ordered


def monthly_rpm(stats: DataFrame, months: int | None = None) -> DataFrame:
    """Mean over authors of reactions per message, by month."""
    per_author = ratio(F.col("total_reactions"), F.col("total_messages"))
    return _latest(stats.groupBy("year", "month").agg(F.avg(per_author).alias("average_rpm")), months)


def rpm_changes(before: DataFrame, added: DataFrame) -> DataFrame:
    """What ``added`` counts change in the mean of ``monthly_rpm``: (year, month, ratios, authors).

    ``ratios`` is the change of the sum of the authors' ratios, ``authors`` that of their number.
    Only the authors and months of ``added`` are looked up in ``before``, both author months.
    """
    keys = ["author_id", "year", "month"]
    sums = lambda rows: rows.groupBy(*keys).agg(
        F.sum("total_messages").alias("m"), F.sum("total_reactions").alias("r")
    )
    new = sums(added)
    old = sums(before.join(added.select(*keys).distinct(), keys, "left_semi")).withColumnsRenamed({"m": "m0", "r": "r0"})
    zero = F.lit(0).cast("bigint")
    both = new.join(old, keys, "left").withColumns({"m0": F.coalesce("m0", zero), "r0": F.coalesce("r0", zero)})
    was, now = ratio(F.col("r0"), F.col("m0")), ratio(F.col("r0") + F.col("r"), F.col("m0") + F.col("m"))
    return both.groupBy("year", "month").agg(
        F.sum(F.coalesce(now, F.lit(0.0)) - F.coalesce(was, F.lit(0.0))).alias("ratios"),
        F.sum(now.isNotNull().cast("bigint") - was.isNotNull().cast("bigint")).alias("authors"),
    )


def monthly_rpm_from_changes(changes: DataFrame, months: int | None = None) -> DataFrame:
    """``monthly_rpm`` from all changes so far; it reads a row a month and batch, no authors."""
    sums = changes.groupBy("year", "month").agg(F.sum("ratios").alias("ratios"), F.sum("authors").alias("authors"))
    mean = F.when(F.col("authors") > 0, F.col("ratios") / F.col("authors"))
    return _latest(sums.select("year", "month", mean.alias("average_rpm")), months)


def yearly_rpm(stats: DataFrame) -> DataFrame:
    """Reactions over messages, by year."""
    return (
        stats.groupBy("year")
        .agg(
            F.sum("total_reactions").alias("total_reactions"),
            F.sum("total_messages").alias("total_messages"),
        )
        .withColumn("average_rpm", ratio(F.col("total_reactions"), F.col("total_messages")))
        .orderBy("year")
    )


def monthly_rpm_from_edges(stats: DataFrame, edges: DataFrame, months: int | None = None) -> DataFrame:
    """Reactions given by people over messages, by month."""
    return _latest(_rpm_from_edges(stats, edges, ["year", "month"]), months)


def yearly_rpm_from_edges(stats: DataFrame, edges: DataFrame) -> DataFrame:
    return _rpm_from_edges(stats, edges, ["year"]).orderBy("year")


def _rpm_from_edges(stats: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    messages = stats.groupBy(*keys).agg(sum_or_zero(F.col("total_messages")).alias("total_messages"))
    reactions = edges.groupBy(*keys).agg(F.sum("reaction_count").alias("reactions"))
    total = F.coalesce("reactions", F.lit(0).cast("bigint"))
    return messages.join(reactions, keys, "left").select(
        *keys,
        total.alias("total_reactions"),
        "total_messages",
        ratio_or_zero(total, F.col("total_messages")).alias("average_rpm"),
    )


def _changes(series: DataFrame, order: list[Column], label: Column) -> DataFrame:
    previous = F.lag("average_rpm").over(W.orderBy(*order))
    zero = F.lit(0).cast("bigint")
    totals = [
        F.col(c) if c in series.columns else zero.alias(c)
        for c in ("total_reactions", "total_messages")
    ]
    return (
        series.withColumn("previous", previous)
        .where(F.col("previous").isNotNull())
        .select(
            label,
            exact_round(percent_change(F.col("average_rpm"), F.col("previous")), 2).alias(
                "change_percentage"
            ),
            "average_rpm",
            *totals,
        )
    )


def monthly_inflation(monthly: DataFrame, chronological: bool = False) -> DataFrame:
    """Change of each month against the next newer one.

    That is how the report is defined: it walks the series newest first, so the newest
    month has no row. ``chronological`` compares with the month before instead.
    """
    if chronological:
        order = [F.asc("year"), F.asc("month")]
    else:
        order = [F.desc("year"), F.desc("month")]
    return _changes(monthly, order, year_month().alias("month_year"))


def yearly_inflation(yearly: DataFrame) -> DataFrame:
    """Change of each year against the year before; the first year has no row."""
    return _changes(yearly, [F.asc("year")], F.col("year"))


def yearly_inflation_bars(inflation: DataFrame) -> DataFrame:
    """Bars of the yearly chart: change of the averages, unrounded, zero for the first."""
    previous = F.lag("average_rpm").over(W.orderBy("year"))
    change = (F.try_divide(F.col("average_rpm"), previous) - 1) * 100
    return inflation.select(
        "year", F.coalesce(change, F.lit(0.0)).alias("yoy_change"), "average_rpm"
    )


def monthly_inflation_bars(inflation: DataFrame) -> DataFrame:
    """Bars of the monthly chart, oldest first."""
    return inflation.select("month_year", "change_percentage", "average_rpm").orderBy("month_year")


def inflation_report(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last twelve months and all years."""
    return (
        monthly_inflation(monthly_rpm(stats, fixed.INFLATION_MONTHS)),
        yearly_inflation(yearly_rpm(stats)),
    )
