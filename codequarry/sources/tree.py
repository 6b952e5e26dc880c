"""Reading trees of source files from any file system the workers can reach."""

from __future__ import annotations

import sys
from collections import deque

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codequarry.sources.intake import code_gate, decode_text, drop_binary

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LISTING = "path string, size bigint, mtime timestamp"
_RAW = "path string, size bigint, mtime timestamp, bytes binary"
_BATCH_BYTES = 64 * 1024 * 1024


def _entries(filesystem: fs.FileSystem, directory: str, recursive: bool) -> list[fs.FileInfo]:
    return filesystem.get_file_info(fs.FileSelector(directory, recursive=recursive))


class _Part(InputPartition):
    def __init__(self, directories: list[str], files: list[tuple]):
        self.directories = directories
        self.files = files


class _TreeReader(DataSourceReader):
    """The driver opens directories only until there is one per task; tasks walk the rest."""

    def __init__(self, root: str, tasks: int):
        self.root, self.tasks = root, tasks

    def partitions(self) -> list[InputPartition]:
        filesystem, root = fs.FileSystem.from_uri(self.root)
        pending, files = deque([root]), []
        while pending and len(pending) < self.tasks:
            for entry in _entries(filesystem, pending.popleft(), recursive=False):
                if entry.type == fs.FileType.Directory:
                    pending.append(entry.path)
                elif entry.type == fs.FileType.File:
                    files.append((entry.path, entry.size, entry.mtime))
        parts = [_Part([d], []) for d in pending]
        parts += [_Part([], files[i:i + 1000]) for i in range(0, len(files), 1000)]
        return parts or [_Part([], [])]

    def read(self, partition: _Part):
        filesystem, root = fs.FileSystem.from_uri(self.root)
        skip = len(root.rstrip("/")) + 1
        for path, size, mtime in partition.files:
            yield path[skip:], size, mtime
        for directory in partition.directories:
            for entry in _entries(filesystem, directory, recursive=True):
                if entry.type == fs.FileType.File:
                    yield entry.path[skip:], entry.size, entry.mtime


class CodeTree(DataSource):
    """``spark.read.format("codetree").load(uri)``: path, size and mtime of every file,
    names starting with a dot or underscore included."""

    @classmethod
    def name(cls) -> str:
        return "codetree"

    def schema(self) -> str:
        return _LISTING

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options["path"], int(self.options.get("tasks", "64")))


def list_tree(spark: SparkSession, uri: str, tasks: int = 64) -> DataFrame:
    spark.dataSource.register(CodeTree)
    return spark.read.format("codetree").option("tasks", tasks).load(uri)


def _reader(uri: str):
    def read(batches):
        filesystem, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            rows, held = [], 0
            for row in batch.to_pylist():
                with filesystem.open_input_stream(f"{root.rstrip('/')}/{row['path']}") as stream:
                    row["bytes"] = stream.read()
                rows.append(row)
                held += len(row["bytes"])
                if held > _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_arrow_raw(batch.schema))
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_arrow_raw(batch.schema))

    return read


def _arrow_raw(schema: pa.Schema) -> pa.Schema:
    return schema.append(pa.field("bytes", pa.binary()))


def read_tree(spark: SparkSession, uri: str, tasks: int = 64) -> DataFrame:
    """Raw bytes of every code file. The listing is shuffled by path first, so one
    crowded directory is still read by many tasks."""
    listing = code_gate(list_tree(spark, uri, tasks))
    return listing.repartition("path").mapInArrow(_reader(uri), _RAW)


def scan_tree(spark: SparkSession, uri: str, project: str | None = None,
              tasks: int = 64) -> DataFrame:
    """files(project, path, content, size, mtime) of a tree, binary and empty files left out.

    Without ``project`` the first directory below the root names it.
    """
    name = F.lit(project) if project is not None else F.split_part("path", F.lit("/"), F.lit(1))
    text = drop_binary(read_tree(spark, uri, tasks)).select(
        name.alias("project"), "path", decode_text(F.col("bytes")).alias("content"), "size", "mtime")
    return text.where("content <> ''")
