"""A Spark data source over segment files: ``spark.read.format("wal").load(folder)``."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .codec import SEGMENT_ROWS, read_stream

#: Bytes a read asks the file system for, and bytes of small files that one task takes.
PIECE, TASK_BYTES = 8 << 20, 128 << 20


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or URI, and the folder's path in it."""
    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


class SegmentFiles(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class WalReader(DataSourceReader):
    def __init__(self, folder: str, from_seq: int):
        self.folder, self.from_seq = folder, from_seq

    def partitions(self) -> list[InputPartition]:
        system, path = opened(self.folder)
        found = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.extension == "wal")
        groups, room = [], 0
        for file in found:
            if not groups or file[1] > room:
                groups.append([])
                room = TASK_BYTES
            groups[-1].append(file)
            room -= file[1]
        return [SegmentFiles(g) for g in groups or [[]]]

    def read(self, partition: SegmentFiles) -> Iterator[tuple]:
        system, _ = opened(self.folder)
        for path, size in partition.files:
            with system.open_input_stream(path, compression=None, buffer_size=PIECE) as file:
                slot, rows = read_stream(file, size)
                for seq, r in rows:
                    if seq >= self.from_seq:
                        yield slot, seq, r.aggregate_id, r.version, r.unix_time, r.command_id, r.codec, [{"type": t, "body": b} for t, b in r.events]


class WalSource(DataSource):
    """Options: path, from_seq. The path is a folder, or a URI of a file system pyarrow knows (file, hdfs, s3, gs),
    that driver and executors can open; other systems are read by ``codec.scan_segments``. A file is one task's,
    small ones are grouped; it is read in pieces and one frame is held at a time. An empty folder gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "wal"

    def schema(self) -> str:
        return SEGMENT_ROWS

    def reader(self, schema: StructType) -> WalReader:
        return WalReader(self.options["path"], int(self.options.get("from_seq", 1)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WalSource)
