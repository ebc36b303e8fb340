"""Messages per month, and the share of them that are quality messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agorametrics import fixed_values as fixed
from agorametrics.functions.months import month_keys, year_month
from agorametrics.functions.numbers import ratio


def first_of_newest(facts: list[DataFrame], months: int = fixed.VOLUME_MONTHS) -> tuple[int, int] | None:
    """The first of the newest months that all ``facts`` have; None if there is none.

    Reads month columns only. The driver gets as many rows as the report has months.
    """
    common = None
    for each in facts:
        own = each.select("year", "month").distinct()
        common = own if common is None else common.join(own, ["year", "month"])
    newest = common.orderBy(F.desc("year"), F.desc("month")).limit(months).collect()
    return tuple(newest[-1]) if newest else None


def messages_per_month(stats: DataFrame, months: int = fixed.VOLUME_MONTHS) -> DataFrame:
    """Total messages of the newest months."""
    return (
        stats.groupBy("year", "month")
        .agg(F.sum("total_messages").alias("total_messages"))
        .orderBy(F.desc("year"), F.desc("month"))
        .limit(months)
    )


def quality_per_month(messages: DataFrame) -> DataFrame:
    return (
        messages.select(*month_keys(F.col("ts")))
        .groupBy("year", "month")
        .agg(F.count("*").alias("quality_count"))
    )


def quality_ratio_per_month(
    messages: DataFrame, stats: DataFrame, months: int = fixed.VOLUME_MONTHS
) -> DataFrame:
    """Quality messages over all messages; months without any of the two are left out."""
    totals = stats.groupBy("year", "month").agg(F.sum("total_messages").alias("total_count"))
    return (
        quality_per_month(messages)
        .join(totals, ["year", "month"])
        .withColumn("hdi_ratio", ratio(F.col("quality_count"), F.col("total_count")))
        .orderBy(F.desc("year"), F.desc("month"))
        .limit(months)
    )


def chart_points(series: DataFrame, value: str) -> DataFrame:
    """Points of a line chart, oldest first, with the height of each value label.

    ``series`` has one row per month, at most the report's months, so one task may hold
    it; a second pass for the maximum would compute the series again.
    """
    top = F.max(value).over(W.partitionBy(F.lit(0)))
    return series.select(
        year_month().alias("month_year"),
        F.col(value),
        (F.col(value) + top * F.lit(0.02)).alias("label_height"),
    ).orderBy("month_year")
