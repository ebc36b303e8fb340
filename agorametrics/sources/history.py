"""The history of chat channels as a Spark stream source.

``register(spark)`` makes the format ``channel_history`` known; then

    spark.readStream.format("channel_history").schema(RAW_MESSAGES).load(folder)

reads a folder of parquet files by channel (``channel_id=<id>/...``, see ``write_history``), to which
messages are only ever added. An offset is a map from channel to the time of the last message read,
so a stream that starts again goes on behind each channel's last message, and a micro-batch is a
range of times per channel: replayed, it gives the same rows. Each file of a channel that reaches
into the range is a partition, so a busy channel is read by many tasks. The bounds are as in a
scheduled scan: after the offset, up to and with the end.

Only the oldest and newest time of each file are looked up on the driver, from the file's footer where it has
them, and once for each file. The folder is in any file system that pyarrow reaches.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from agorametrics.schemas import RAW_MESSAGES
from agorametrics.sources.files import file_system, make_known

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "channel_history"
_CHANNEL = re.compile(r"(?:^|/)channel_id=(-?[0-9]+)/")
_TIME = pa.timestamp("us", tz="UTC")


def _micros(value: pa.Scalar) -> int:
    return value.cast(_TIME).cast(pa.int64()).as_py()


def _times(system: fs.FileSystem, path: str) -> tuple[int, int] | None:
    """The oldest and the newest time in a file, as microseconds; None if it has no rows."""
    with system.open_input_file(path) as source:
        file = pq.ParquetFile(source)
        kind = file.schema_arrow.field("created_at").type
        leaf = [k for k in range(file.metadata.num_columns) if file.schema.column(k).path == "created_at"][0]
        groups = [file.metadata.row_group(g).column(leaf) for g in range(file.num_row_groups)]
        # Times in the old 96-bit form have no statistics.
        if groups and all(g.physical_type == "INT64" and g.is_stats_set and g.statistics.has_min_max for g in groups):
            low, high = min(g.statistics.min for g in groups), max(g.statistics.max for g in groups)
            return _micros(pa.scalar(low, kind)), _micros(pa.scalar(high, kind))
        times = pc.min_max(file.read(columns=["created_at"]).column(0))
        return (_micros(times["min"]), _micros(times["max"])) if times["max"].is_valid else None


class Span(InputPartition):
    """Messages of one file of a channel after ``start`` up to ``end``."""

    def __init__(self, channel: str, path: str, start: int, end: int):
        super().__init__((channel, path, start, end))
        self.channel, self.path, self.start, self.end = channel, path, start, end


class HistoryReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema
        self.known: dict[str, tuple[int, int] | None] = {}

    def _files(self) -> dict[str, list[tuple[str, int, int]]]:
        """Per channel the files with their oldest and newest times."""
        system, folder = file_system(self.path)
        found: dict[str, list[tuple[str, int, int]]] = {}
        for info in system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
            channel = _CHANNEL.search(info.path)
            if not channel or info.type != fs.FileType.File or info.base_name.startswith(("_", ".")) or "/_temporary/" in info.path:
                continue
            if info.path not in self.known:
                self.known[info.path] = _times(system, info.path)
            if self.known[info.path]:
                found.setdefault(channel[1], []).append((info.path, *self.known[info.path]))
        return found

    def initialOffset(self) -> dict[str, int]:
        return {}

    def latestOffset(self) -> dict[str, int]:
        return {channel: max(newest for _, _, newest in files) for channel, files in self._files().items()}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Span]:
        files = self._files()
        least = -(1 << 62)
        return [
            Span(channel, path, start.get(channel, least), upto)
            for channel, upto in sorted(end.items())
            for path, oldest, newest in sorted(files.get(channel, []))
            if newest > start.get(channel, least) and oldest <= upto
        ]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        kinds = to_arrow_schema(self.schema)
        with system.open_input_file(span.path) as source:
            file = pq.ParquetFile(source)
            stored = [f.name for f in kinds if f.name in file.schema_arrow.names]
            for batch in file.iter_batches(columns=stored):
                times = batch.column("created_at").cast(_TIME).cast(pa.int64())
                batch = batch.filter(pc.and_(pc.greater(times, span.start), pc.less_equal(times, span.end)))
                if not batch.num_rows:
                    continue
                channel = pa.array([int(span.channel)] * batch.num_rows, pa.int64())
                columns = [
                    channel if f.name == "channel_id" else batch.column(f.name).cast(f.type) if f.name in stored
                    else pa.nulls(batch.num_rows, f.type)
                    for f in kinds
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    def commit(self, end: dict[str, int]) -> None:
        """Nothing to let go of: files stay, and are known by their names."""


class HistorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return RAW_MESSAGES

    def streamReader(self, schema: StructType) -> HistoryReader:
        if not self.options.get("path"):
            raise ValueError("channel history needs a path")
        return HistoryReader(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    make_known(spark, HistorySource)


def write_history(raw: DataFrame, folder: str) -> None:
    """Add messages to a history, sorted by time within the files of each channel."""
    rows = raw.hint("rebalance", "channel_id").sortWithinPartitions("channel_id", "created_at")
    rows.write.mode("append").partitionBy("channel_id").parquet(folder)
