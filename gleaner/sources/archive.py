"""Stored pages as a data source: what collectors have fetched, by load, source and day.

``store_pages`` writes a load; ``read_pages`` and ``stream_pages`` read loads that are whole. The
source lists files on the driver and reads them in tasks:

- filters on ``fuente`` and ``dia`` choose folders before anything is opened;
- with ``limite`` each source gives that many pages at most, newest day first and by place within a
  day: one task a source reads its files lazily and stops at the limit;
- as a stream, the offset is the number of whole loads, so a restart goes on where it stopped and
  a load that is still being written isn't seen.
"""

from __future__ import annotations

import heapq
import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

NAME = "gleaner_pages"
SCHEMA = T.StructType([T.StructField("carga", T.LongType()), T.StructField("fuente", T.StringType()), T.StructField("dia", T.DateType()), T.StructField("pos", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
STORED = ("pos", "url", "html")
#: Bytes of files that a task reads, about.
TASK_BYTES = 64 << 20
#: Rows that are read from a file at a time.
BATCH_ROWS = 256
_NONE = "__HIVE_DEFAULT_PARTITION__"
_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


@dataclass(frozen=True)
class File:
    path: str
    size: int
    carga: int
    fuente: str | None
    dia: date | None


class Files(InputPartition):
    """The files of a task, and how many rows of them it gives (None: all)."""

    def __init__(self, files: list[File], limit: int | None = None):
        self.files, self.limit = files, limit


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _loads(path: str) -> dict[int, str]:
    """Number and folder of the loads that are whole."""
    system, top = _system(path)
    found = system.get_file_info(fs.FileSelector(top, allow_not_found=True))
    folders = {int(x.base_name.split("=")[1]): x.path for x in found if x.type == fs.FileType.Directory and x.base_name.startswith("carga=")}
    done = system.get_file_info([posixpath.join(p, "_SUCCESS") for p in folders.values()]) if folders else []
    return {k: p for (k, p), mark in zip(folders.items(), done) if mark.type == fs.FileType.File}


def _files(path: str, loads: Iterable[int] | None = None) -> list[File]:
    system, _ = _system(path)
    out = []
    for k, folder in sorted(_loads(path).items()):
        if loads is None or k in loads:
            for x in system.get_file_info(fs.FileSelector(folder, recursive=True)):
                if x.type == fs.FileType.File and x.base_name.endswith(".parquet"):
                    source, day = (unquote(part.split("=", 1)[1]) for part in x.path.split("/")[-3:-1])
                    out.append(File(x.path, x.size, k, None if source == _NONE else source, None if day == _NONE else date.fromisoformat(day)))
    return out


def _packed(files: list[File]) -> list[Files]:
    """Files dealt to tasks of about TASK_BYTES each, the largest first into the first that has room."""
    tasks: list[tuple[int, int, list[File]]] = []
    for k, f in enumerate(sorted(files, key=lambda f: -f.size)):
        if tasks and tasks[0][0] + f.size <= TASK_BYTES:
            size, n, own = heapq.heappop(tasks)
            heapq.heappush(tasks, (size + f.size, n, [*own, f]))
        else:
            heapq.heappush(tasks, (f.size, k, [f]))
    return [Files(own) for _, _, own in tasks]


def _named(b: pa.RecordBatch, f: File) -> pa.RecordBatch:
    """The stored columns with those that the folders tell."""
    same = lambda v, kind: pa.repeat(pa.scalar(v, kind), b.num_rows)
    return pa.RecordBatch.from_arrays([same(f.carga, pa.int64()), same(f.fuente, pa.string()), same(f.dia, pa.date32()), *(b[c].cast(k) for c, k in zip(STORED, (pa.int64(), pa.string(), pa.string())))], SCHEMA.names)


def _batches(system: fs.FileSystem, f: File) -> Iterator[pa.RecordBatch]:
    with system.open_input_file(f.path) as at:
        yield from pq.ParquetFile(at).iter_batches(BATCH_ROWS, columns=list(STORED))


def _rows(system: fs.FileSystem, f: File) -> Iterator[tuple]:
    for b in _batches(system, f):
        for k, pos in enumerate(b["pos"].to_pylist()):
            yield (pos is None, pos or 0, f.path, k), b.slice(k, 1), f


def _newest(system: fs.FileSystem, files: list[File], limit: int) -> Iterator[pa.RecordBatch]:
    """The first rows by day, newest first, and place; files are sorted by place, and are opened a day at a time."""
    days = sorted({f.dia for f in files}, key=lambda d: (d is not None, d or date.min), reverse=True)
    for day in days:
        for _, row, f in heapq.merge(*(_rows(system, f) for f in files if f.dia == day), key=lambda x: x[0]):
            if not limit:
                return
            limit -= 1
            yield _named(row, f)


class _Reading:
    def __init__(self, options):
        self.path, self.limit = options["path"], int(options["limite"]) if options.get("limite") else None

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no files
            return
        system, _ = _system(self.path)
        if partition.limit is not None:
            yield from _newest(system, partition.files, partition.limit)
            return
        for f in partition.files:
            for b in _batches(system, f):
                yield _named(b, f)


class PageReader(_Reading, DataSourceReader):
    def __init__(self, options):
        super().__init__(options)
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("fuente",), ("dia",)):
                self.tests.append((f.attribute[0], _TESTS[type(f)], f.value))
            else:
                yield f

    def chosen(self) -> list[File]:
        def fits(f: File) -> bool:
            return all((v := getattr(f, name)) is not None and test(v, value) for name, test, value in self.tests)

        return [f for f in _files(self.path) if fits(f)]

    def partitions(self) -> list[Files]:
        files = self.chosen()
        if self.limit is None:
            return _packed(files)
        by: dict[str | None, list[File]] = {}
        for f in files:
            by.setdefault(f.fuente, []).append(f)
        return [Files(own, self.limit) for own in by.values()]


class PageStream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"cargas": 0}

    def latestOffset(self) -> dict:
        loads, n = _loads(self.path), 0
        while n in loads:  # a load that isn't whole holds up those after it
            n += 1
        return {"cargas": n}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _packed(_files(self.path, range(start["cargas"], end["cargas"])))

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PageReader(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return PageStream(self.options)


def store_pages(pages: DataFrame, folder: str, load: int, source: Column, day: Column, pos: Column) -> None:
    """Writes pages (url, html) as a load; run again, it replaces just that load. Files are sorted by place."""
    rows = pages.select(source.alias("fuente"), day.alias("dia"), pos.cast("long").alias("pos"), "url", "html")
    rows.sortWithinPartitions("fuente", "dia", "pos").write.mode("overwrite").partitionBy("fuente", "dia").parquet(f"{folder}/carga={load}")


def _ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)


def read_pages(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """The pages of all whole loads; with a limit, the newest of each source."""
    _ready(spark)
    reader = spark.read.format(NAME)
    return (reader if limit is None else reader.option("limite", limit)).load(folder)


def stream_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of loads as they become whole."""
    _ready(spark)
    return spark.readStream.format(NAME).load(folder)
