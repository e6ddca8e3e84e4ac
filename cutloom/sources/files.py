"""Corpora of binary files, read by byte ranges: of a file only what is asked for leaves the store, whatever its size.

``byte_ranges`` is a Python data source; its partitions are runs of files with about the same bytes to read. Paths are those that Arrow
file systems open: local ones, and the URIs of the shared stores it knows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.retention import classify, ends_fingerprint

SCHEMA = "path string, name string, length bigint, head binary, tail binary"
PART_BYTES, PART_FILES = 64 << 20, 4096  # of one partition
BATCH_BYTES = 16 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[5:]
    return fs.FileSystem.from_uri(path)


class FileRun(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class RangeReader(DataSourceReader):
    def __init__(self, path: str, head: int, tail: int):
        self.path, self.head, self.tail = path, head, tail

    def partitions(self) -> list[FileRun]:
        store, root = opened(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        runs, size = [[]], 0
        for file, length in files:
            cost = min(length, self.head) + min(length, self.tail)
            if runs[-1] and (size + cost > PART_BYTES or len(runs[-1]) >= PART_FILES):
                runs.append([])
                size = 0
            runs[-1].append((file, length))
            size += cost
        return [FileRun(r) for r in runs]

    def read(self, partition: FileRun) -> Iterator[pa.RecordBatch]:
        store, root = opened(self.path)
        prefix = self.path[:-len(root)] if self.path.endswith(root) else ""
        rows, size = [], 0
        for file, length in partition.files:
            head = tail = None
            if self.head or self.tail:
                with store.open_input_file(file) as f:
                    head = f.read_at(min(length, self.head), 0) if self.head else None
                    tail = f.read_at(min(length, self.tail), max(0, length - self.tail)) if self.tail else None
            rows.append((prefix + file, file.rsplit("/", 1)[-1], length, head, tail))
            size += len(head or b"") + len(tail or b"")
            if size > BATCH_BYTES or len(rows) >= 1024:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "name", "length", "head", "tail"])


class ByteRanges(DataSource):
    """Options: path, head and tail (bytes at the beginning and at the end; 0 leaves the column null)."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options["path"], int(self.options.get("head", 0)), int(self.options.get("tail", 0)))


def file_ranges(spark: SparkSession, path: str, head: int = 0, tail: int = 0) -> DataFrame:
    """(path, name, length, head, tail) of every file under ``path``; hidden files are left out. An empty folder gives no rows."""
    spark.dataSource.register(ByteRanges)
    return spark.read.format("byte_ranges").option("head", head).option("tail", tail).load(path)


def classify_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, container) of every file under ``path``, told by names and the first 189 bytes."""
    f = file_ranges(spark, path, head=189)
    return f.select("name", F.col("length").alias("bytes"), classify(F.lit(None).cast("string"), F.col("name"), F.col("head")).alias("container"))


def fingerprint_files(spark: SparkSession, path: str, kind: str = "", edge: int = 1 << 20) -> DataFrame:
    """(name, bytes, fingerprint): SHA-256 over ``size:type:`` and the first and last ``edge`` bytes of every file."""
    f = file_ranges(spark, path, head=edge, tail=edge)
    return f.select("name", F.col("length").alias("bytes"), ends_fingerprint(F.col("head"), F.col("tail"), F.col("length"), F.lit(kind)).alias("fingerprint"))


class RangeSource:
    """What a user reader gets of a file: its size, reads of byte ranges, and counts of what was read."""

    def __init__(self, file: pa.NativeFile, path: str, size: int):
        self._file, self.path, self.size, self.bytes_read, self.reads = file, path, size, 0, 0

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise ValueError(f"{self.path}: bytes {offset} to {offset + length} of {self.size}")
        self.reads += 1
        self.bytes_read += length
        return self._file.read_at(length, offset)


def demux_files(spark: SparkSession, path: str, reader: Callable[[RangeSource], Iterable[tuple]], schema: str, batch_rows: int = 8192) -> DataFrame:
    """Rows that a user reader makes of every file, with path, source_bytes and bytes_read: those read up to that row.

    The reader gets a RangeSource and yields tuples of ``schema``; only a batch of its rows is in memory. An error of the reader fails the
    job and names the file.
    """
    names = [p.split()[0] for p in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, size in zip(frame["path"], frame["length"]):
                store, inner = opened(file)
                with store.open_input_file(inner) as f:
                    source, rows = RangeSource(f, file, int(size)), []
                    try:
                        for row in reader(source):
                            rows.append((file, source.size, source.bytes_read, *row))
                            if len(rows) >= batch_rows:
                                yield pd.DataFrame(rows, columns=["path", "source_bytes", "bytes_read", *names], dtype=object)
                                rows = []
                    except Exception as e:
                        raise RuntimeError(f"reader failed on {file}: {e}") from e
                    yield pd.DataFrame(rows, columns=["path", "source_bytes", "bytes_read", *names], dtype=object)

    return file_ranges(spark, path).select("path", "length").mapInPandas(run, f"path string, source_bytes bigint, bytes_read bigint, {schema}")


def write_files(rows: DataFrame, path: str, file: str, order: list[str], content: Callable[[pd.DataFrame], bytes]) -> int:
    """One file per value of the column ``file`` (its name under ``path``) from that group's rows in order; gives the number of files.

    A group has to fit a task: choose names so that files are of a bounded number of rows. Files are written under a passing name and
    then moved, so a task that runs twice leaves whole files.
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        store, root = opened(path)
        store.create_dir(root, recursive=True)
        name = group[file].iloc[0]
        made = content(group.sort_values(order, kind="stable"))
        passing = f"{root}/.{name}-{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(passing) as out:
            out.write(made)
        store.move(passing, f"{root}/{name}")
        return pd.DataFrame({"name": [name], "bytes": [len(made)]})

    return rows.groupBy(file).applyInPandas(run, "name string, bytes bigint").count()
