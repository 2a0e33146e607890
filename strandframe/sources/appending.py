"""Text tables with one header that grow by named batches, each of which counts once.

A data source for Spark's writer: tasks write into a folder of their run, and only the driver's commit moves the files of tasks
that ended well to their place and then names them in the batch's list. A task that fails and is tried again, a run that is
broken off, and a batch that is sent again leave no row twice. Files are reached through Arrow's file systems."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.sinks import insert_if_absent

HEADER, LISTS, RUNS = "0-header.csv", "_batches", "_runs"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def _there(files: fs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type != fs.FileType.NotFound


def _names(files: fs.FileSystem, folder: str) -> list[str]:
    return sorted(i.base_name for i in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.type == fs.FileType.File)


def _write(files: fs.FileSystem, path: str, content: str) -> None:
    """Whole or not at all: written beside, then renamed."""
    beside = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(beside) as out:
        out.write(content.encode())
    files.move(beside, path)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str, columns: list[str], separator: str):
        self.path, self.batch, self.columns, self.separator = path, batch, columns, separator
        self.run = uuid.uuid4().hex

    def _format(self) -> pa.csv.WriteOptions:
        return pa.csv.WriteOptions(include_header=False, delimiter=self.separator, quoting_style="needed")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _open(self.path)
        folder = posixpath.join(root, RUNS, self.run)
        files.create_dir(folder, recursive=True)
        partition = TaskContext.get().partitionId()
        name, writer = posixpath.join(folder, f"{partition:06d}-{uuid.uuid4().hex}"), None
        with files.open_output_stream(name) as out:
            for batch in iterator:
                for column in batch.columns:
                    if pa.types.is_string(column.type) and pc.any(pc.match_substring(column, "\n")).as_py():
                        raise ValueError("a text with a line break is no field of a table of lines")
                writer = writer or pa.csv.CSVWriter(out, batch.schema, write_options=self._format())
                writer.write_batch(batch)
            if writer:
                writer.close()
        return Written(partition, name)

    def commit(self, messages: list[Written]) -> None:
        files, root = _open(self.path)
        lists = posixpath.join(root, LISTS)
        files.create_dir(lists, recursive=True)
        done = posixpath.join(lists, self.batch)
        if not _there(files, done):
            for name in _names(files, root):  # of a commit that was broken off
                if name.startswith(f"{self.batch}-"):
                    files.delete_file(posixpath.join(root, name))
            head = posixpath.join(root, HEADER)
            if not _there(files, head):
                _write(files, head, self.separator.join(self.columns) + "\n")
            placed = []
            for m in sorted((m for m in messages if m), key=lambda m: m.partition):
                if files.get_file_info(m.file).size:
                    placed.append(f"{self.batch}-{m.partition:06d}.csv")
                    files.move(m.file, posixpath.join(root, placed[-1]))
            _write(files, done, "".join(f"{name}\n" for name in placed))
        self.abort(messages)

    def abort(self, messages: list[Written]) -> None:
        files, root = _open(self.path)
        folder = posixpath.join(root, RUNS, self.run)
        if _there(files, folder):
            files.delete_dir(folder)


class BatchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandframe_batches"

    def writer(self, schema: T.StructType, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("batches are appended: use mode('append')")
        return BatchWriter(self.options["path"], self.options["batch"], schema.names, self.options.get("separator", ","))


def append_batch(df: DataFrame, path: str, batch: str, separator: str = ",") -> None:
    """Append df as the named batch; a batch that is there already is left as it is. The names and order of columns are the table's
    header, which is written with the first batch and must be the same in every other. Names of batches have letters, digits, `_`.
    Null and the empty text stay apart; a text with a line break raises."""
    if not batch.replace("_", "").isalnum():
        raise ValueError("a batch's name has letters, digits and _ only")
    files, root = _open(path)
    head, own = posixpath.join(root, HEADER), separator.join(df.columns)
    if _there(files, head):
        with files.open_input_stream(head) as f:
            there = f.read().decode().rstrip("\n")
        if there != own:
            raise ValueError(f"the table's header is {there}, not {own}")
    if _there(files, posixpath.join(root, LISTS, batch)):
        return
    df.sparkSession.dataSource.register(BatchSource)
    df.write.format(BatchSource.name()).mode("append").option("batch", batch).option("separator", separator).save(path)


def read_batches(spark: SparkSession, path: str, schema: T.StructType | str, separator: str = ",") -> DataFrame:
    """Rows of all whole batches; files of a batch that is not whole yet are not read."""
    files, root = _open(path)
    names = []
    for batch in _names(files, posixpath.join(root, LISTS)):
        if "." not in batch:
            with files.open_input_stream(posixpath.join(root, LISTS, batch)) as f:
                names += f.read().decode().split()
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv([f"{path.rstrip('/')}/{n}" for n in names], sep=separator, quote='"', escape='"', multiLine=False)


def insert_batch(df: DataFrame, path: str, batch: str, key: str, order: list[Column], separator: str = ",") -> None:
    """Append as the named batch the rows of keys that the table does not have, the first of each by the order."""
    spark = df.sparkSession
    there = read_batches(spark, path, df.schema, separator)
    append_batch(insert_if_absent(df, there, key, order).select(*df.columns), path, batch, separator)
