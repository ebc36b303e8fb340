"""Consecutive positions 0, 1, 2, ... over a whole DataFrame without a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agorametrics.plans.tables import write_once


def with_position(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """Number the rows by a unique ``key``.

    The rows are cut into key ranges once; a row's position is its place in its range
    plus the sizes of the ranges before it. Only those sizes, one row per range, meet
    in one task and are broadcast.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(ranges, key).withColumn("_range", F.spark_partition_id())
    table = write_once(cut, "ranges")
    sizes = table.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    place = F.row_number().over(W.partitionBy("_range").orderBy(key)) - 1
    return (
        table.join(F.broadcast(starts), "_range")
        .withColumn(name, (F.col("_start") + place).cast("bigint"))
        .drop("_range", "_start")
    )
