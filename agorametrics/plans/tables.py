"""Intermediate tables written to the shared checkpoint folder.

A written table is computed once, cuts the lineage, survives lost executors, and gives
the planner real sizes, so that it broadcasts a small table and shuffles a large one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """The shared folder from ``spark.checkpoint.dir``; a local session may go without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="agorametrics-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path``, replacing what is there, and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a folder of its own and read it back."""
    return write_table(df, new_folder(df.sparkSession, name))
