"""Quotes in YAML files that each hold one list, as a Spark data source.

``register(spark)`` makes the format ``yaml_quotes`` known; then

    spark.read.format("yaml_quotes").load(path)             # quotes(quote)
    quotes.write.format("yaml_quotes").mode("append").save(folder)

``path`` is a file, a folder or a glob in any file system that pyarrow reaches (local, HDFS,
S3, GCS). Each file is a partition of its own, so files are read in parallel. A path without files
and a file that is broken, empty or holds no list raise ``ValueError``: the path and the first
file when the schema is asked for, which is when ``load`` is called, the others when they are read.
Writing makes one file per task, which gets its name when all tasks are done. ``read_quotes`` reads
the same files through Spark's own file systems, for stores that only these reach.
"""

from __future__ import annotations

import fnmatch
import posixpath
import sys
import uuid
from collections.abc import Iterator

import pandas as pd
import yaml
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from agorametrics.sources.files import file_system, make_known

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "yaml_quotes"
SUFFIX = ".yaml"
_SCHEMA = "quote string"
_PARSED = "path string, quote string, problem string"


def _parse(content: bytes) -> tuple[list[str], str | None]:
    try:
        quotes = yaml.safe_load(content)
    except (yaml.YAMLError, UnicodeDecodeError):
        return [], "is not valid YAML"
    if not isinstance(quotes, list):
        return [], "does not hold a list"
    if not quotes:
        return [], "holds an empty list"
    return [str(quote) for quote in quotes], None


def _files(path: str) -> list[str]:
    """The files at ``path``: itself, those directly in a folder, or those that a glob names."""
    system, inner = file_system(path)
    folder, name = posixpath.split(inner.rstrip("/"))
    if any(c in name for c in "*?["):
        found = system.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True))
        found = [f for f in found if fnmatch.fnmatchcase(f.base_name, name)]
    else:
        found = [system.get_file_info(inner)]
        if found[0].type == fs.FileType.Directory:
            found = [
                f for f in system.get_file_info(fs.FileSelector(inner)) if not f.base_name.startswith(("_", "."))
            ]
    return sorted(f.path for f in found if f.type == fs.FileType.File)


def _read_file(path: str, name: str) -> list[str]:
    system, _ = file_system(path)
    with system.open_input_stream(name) as stream:
        quotes, problem = _parse(stream.read())
    if problem:
        raise ValueError(f"{name} {problem}")
    return quotes


class QuoteFile(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class QuoteReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[QuoteFile]:
        return [QuoteFile(name) for name in _files(self.path)]

    def read(self, partition: QuoteFile) -> Iterator[tuple[str]]:
        return ((quote,) for quote in _read_file(self.path, partition.name))


class Written(WriterCommitMessage):
    def __init__(self, hidden: str | None, name: str | None):
        self.hidden, self.name = hidden, name


class QuoteWriter(DataSourceWriter):
    """Tasks write hidden files; the driver gives them their names once all are there."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        system, folder = file_system(path)
        system.create_dir(folder, recursive=True)
        self.old = _files(path) if overwrite else []

    def write(self, rows: Iterator) -> Written:
        system, folder = file_system(self.path)
        name = f"part-{uuid.uuid4().hex}{SUFFIX}"
        hidden, some = f"{folder}/_{name}", False
        with system.open_output_stream(hidden) as stream:
            for row in rows:
                # A list of one is a line of the file's list; strings are quoted, whatever they hold.
                line = yaml.safe_dump(["" if row.quote is None else row.quote], allow_unicode=True, default_style='"')
                stream.write(line.encode("utf8"))
                some = True
        if some:
            return Written(hidden, f"{folder}/{name}")
        system.delete_file(hidden)
        return Written(None, None)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.path)
        for done in messages:
            if done and done.hidden:
                system.move(done.hidden, done.name)
        for name in self.old:
            system.delete_file(name)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.path)
        for done in messages:
            if done and done.hidden:
                system.delete_file(done.hidden)


class QuoteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("quotes need a path")
        return self.options["path"]

    def schema(self) -> str:
        files = _files(self._path())
        if not files:
            raise ValueError(f"cannot open {self._path()}")
        _read_file(self._path(), files[0])
        return _SCHEMA

    def reader(self, schema: StructType) -> QuoteReader:
        return QuoteReader(self._path())

    def writer(self, schema: StructType, overwrite: bool) -> QuoteWriter:
        if schema.fieldNames() != ["quote"]:
            raise ValueError("quotes are written from one column, quote")
        return QuoteWriter(self._path(), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    make_known(spark, QuoteSource)


def _parse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            quotes, problem = _parse(content)
            yield pd.DataFrame(
                {"path": path, "quote": quotes or [None], "problem": problem}
            )


def read_quotes(spark: SparkSession, path: str) -> DataFrame:
    """``quotes(quote)`` from a file, a folder or a glob; files are read in parallel.

    Raises ``ValueError`` at once for a missing, broken, empty or non-list file.
    """
    try:
        files = spark.read.format("binaryFile").load(path).select("path", "content")
    except AnalysisException as missing:
        raise ValueError(f"cannot open {path}") from missing
    parsed = files.mapInPandas(_parse_files, _PARSED)
    bad = parsed.where(F.col("problem").isNotNull()).select("path", "problem").head(1)
    if bad:
        raise ValueError(f"{bad[0].path} {bad[0].problem}")
    # Scans skip files without any bytes, so those show up as missing paths.
    if parsed.select("path").distinct().count() < len(files.inputFiles()):
        raise ValueError(f"{path} holds an empty file")
    return parsed.select("quote")
