"""User connectors as Spark data sources: a whole listing, or a stream of changes.

A connector splits its own listing, or the changes between two cursors, into parts; each part
is read by a task, so neither passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schemas import CHANGES, SOURCE_ITEMS


@dataclass(frozen=True)
class Item:
    path: str
    locator: str
    size: int | None = None
    content_type: str | None = None
    version: str | None = None


class Connector(Protocol):
    """What a user supplies: parts of the listing, and the items of one part."""

    def parts(self) -> Iterable[str]: ...

    def discover(self, part: str) -> Iterable[Item]: ...


class _Part(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


def register_source(spark: SparkSession, name: str, connector_class: type) -> None:
    """Make ``spark.read.format(name)`` read a connector; reader options become its
    keyword arguments (they arrive as strings)."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self):
            return SOURCE_ITEMS

        def reader(self, schema):
            return Reader(dict(self.options))

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.connector_options = options

        def partitions(self):
            return [_Part(p) for p in connector_class(**self.connector_options).parts()]

        def read(self, partition: _Part) -> Iterator[tuple]:
            for item in connector_class(**self.connector_options).discover(partition.name):
                yield (item.path, item.locator, item.size, item.content_type, item.version)

    spark.dataSource.register(Source)


class ChangeConnector(Protocol):
    """What a user supplies to be followed: the cursor behind all changes known now, the parts
    of the changes behind one cursor up to another, and the changes of one part, as tuples or
    Arrow batches in the columns of ``CHANGES``. A part must read the same when it is read again."""

    def latest(self) -> str | None: ...

    def changed_parts(self, since: str | None, until: str | None) -> Iterable[str]: ...

    def changes(self, part: str) -> Iterable[tuple | pa.RecordBatch]: ...


def register_changes(spark: SparkSession, name: str, connector_class: type) -> None:
    """Make ``spark.readStream.format(name)`` follow a connector. The offset of the stream is the
    connector's cursor, kept by the stream's checkpoint, so a stream that starts again goes on
    behind the last batch it finished, and a batch that failed is read again between the same
    two cursors."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self):
            return CHANGES

        def streamReader(self, schema):
            return Reader(dict(self.options))

    class Reader(DataSourceStreamReader):
        def __init__(self, options: dict[str, str]):
            self.connector = connector_class(**options)

        def initialOffset(self) -> dict:
            return {"cursor": None}

        def latestOffset(self) -> dict:
            return {"cursor": self.connector.latest()}

        def partitions(self, start: dict, end: dict):
            if start == end:
                return []
            return [_Part(p) for p in self.connector.changed_parts(start["cursor"], end["cursor"])]

        def read(self, partition: _Part) -> Iterator[tuple | pa.RecordBatch]:
            yield from self.connector.changes(partition.name)

    spark.dataSource.register(Source)


def follow_connector(spark: SparkSession, name: str, **options: str) -> DataFrame:
    return spark.readStream.format(name).options(**options).load()


class BatchFolders:
    """A change feed kept as folders ``<root>/<batch>`` of Parquet files on a shared file system;
    a batch appears when its ``_SUCCESS`` file does. The cursor is the name of the last batch,
    names sort in the order of time, and a part is a file."""

    def __init__(self, root: str):
        self.files, self.root = pafs.FileSystem.from_uri(root if ":/" in root else f"file://{root}")

    def _complete(self) -> list[str]:
        here = self.files.get_file_info(pafs.FileSelector(self.root, allow_not_found=True))
        names = sorted(f.base_name for f in here if f.type == pafs.FileType.Directory)
        marks = self.files.get_file_info([f"{self.root}/{n}/_SUCCESS" for n in names])
        return [n for n, mark in zip(names, marks) if mark.type == pafs.FileType.File]

    def latest(self) -> str | None:
        return max(self._complete(), default=None)

    def changed_parts(self, since: str | None, until: str | None) -> Iterator[str]:
        for name in self._complete():
            if (since is None or name > since) and name <= until:
                inside = self.files.get_file_info(pafs.FileSelector(f"{self.root}/{name}"))
                yield from sorted(f.path for f in inside if f.base_name.endswith(".parquet"))

    def changes(self, part: str) -> Iterator[pa.RecordBatch]:
        with self.files.open_input_file(part) as file:
            yield from pq.ParquetFile(file).iter_batches(columns=CHANGES.names)


def scan_connector(spark: SparkSession, name: str, **options: str) -> DataFrame:
    return spark.read.format(name).options(**options).load()
