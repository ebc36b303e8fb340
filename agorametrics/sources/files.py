"""Paths for sources that read files in Python."""

from __future__ import annotations

import sys

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``path`` and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def make_known(spark: SparkSession, source: type[DataSource]) -> None:
    """Register a data source; a session may know it already from the one it was made from."""
    try:
        spark.dataSource.register(source)
    except AnalysisException as known:
        if known.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise
