"""A data source over stored page archives: ``spark.read.format("page_archive")``, as a table or a stream.

An archive is a folder of JSON lines, ``<path>/day=YYYY-MM-DD/<file>.json``, whose objects hold page_id, url and html. Every file
is a partition. Filters on ``day`` are pushed, so days outside them are not opened. A stream's offset is the last file
in the order of names: a crawler adds files behind those it has written, and a run reads what came since the last one.
Files are opened through Arrow's file systems (local paths, hdfs://, s3:// and what else it was built with).
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "day date, page_id long, url string, html string"
BATCH = 256


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def files(path: str) -> list[str]:
    """Files of the archive below its folder, in order of their names."""
    system, root = opened(path)
    found = system.get_file_info(pa.fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = [f.path[len(root.rstrip("/")) + 1 :] for f in found if f.is_file and f.base_name.endswith(".json") and not f.base_name.startswith(("_", "."))]
    return sorted(n for n in names if n.startswith("day="))


def day_of(name: str) -> datetime.date:
    return datetime.date.fromisoformat(name.split("/")[0].removeprefix("day="))


@dataclass
class ArchiveFile(InputPartition):
    name: str


def read_file(path: str, name: str) -> Iterator[pa.RecordBatch]:
    system, root = opened(path)
    day, rows = day_of(name), []
    schema = pa.schema([("day", pa.date32()), ("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])
    with system.open_input_stream(f"{root.rstrip('/')}/{name}") as stream:
        for line in _lines(stream):
            page = json.loads(line)
            rows.append({"day": day, **{k: page.get(k) for k in ("page_id", "url", "html")}})
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _lines(stream) -> Iterator[bytes]:
    """Lines that are not blank, a megabyte at a time."""
    rest = b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x for x in whole if x.strip())
    if rest.strip():
        yield rest


COMPARES = {EqualTo: lambda d, v: d == v, GreaterThan: lambda d, v: d > v, GreaterThanOrEqual: lambda d, v: d >= v, LessThan: lambda d, v: d < v, LessThanOrEqual: lambda d, v: d <= v, In: lambda d, v: d in v}


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.days = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps comparisons of the day with constants; the others are Spark's."""
        for f in filters:
            if type(f) in COMPARES and f.attribute == ("day",) and f.value is not None:
                self.days.append((type(f).__name__, f.value))
            else:
                yield f

    def partitions(self) -> list[ArchiveFile]:
        by_name = {k.__name__: c for k, c in COMPARES.items()}
        return [ArchiveFile(n) for n in files(self.path) if all(by_name[c](day_of(n), v) for c, v in self.days)]

    def read(self, partition: ArchiveFile) -> Iterator[pa.RecordBatch]:
        return read_file(self.path, partition.name) if partition is not None else iter(())


class ArchiveStream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        return {"file": max(files(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[ArchiveFile]:
        return [ArchiveFile(n) for n in files(self.path) if start["file"] < n <= end["file"]]

    def read(self, partition: ArchiveFile) -> Iterator[pa.RecordBatch]:
        return read_file(self.path, partition.name)


class PageArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def streamReader(self, schema) -> ArchiveStream:
        return ArchiveStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with its filters pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageArchive)
