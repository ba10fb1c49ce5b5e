"""Files by ranges of bytes: listing, reading a part of a file in a task, and a sink of named files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def file_system(path: str):
    """(file system, path in it) of a path as Spark gives it; any scheme that Arrow knows."""
    from pyarrow import fs

    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


#: Partitions of a job at most.
MOST_TASKS = 100_000
#: Bytes and pieces that a task takes, about; tasks a core at least, if there are as many pieces.
TASK_BYTES, TASK_PIECES, TASKS_A_CORE = 64 << 20, 1000, 4


class RangeFile:
    """A file that is sliced like bytes; only what is asked for is read."""

    def __init__(self, path: str):
        system, name = file_system(path)
        self.path = path
        self.handle = system.open_input_file(name)
        self.length = self.handle.size()

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.length)
        return self.handle.read_at(stop - start, start) if stop > start else b""

    def __enter__(self) -> RangeFile:
        return self

    def __exit__(self, *_) -> None:
        self.handle.close()


def list_files(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """(path, length) of the files under path with an ending, whatever its case. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length").filter(F.lower("path").endswith(ending.lower()))


def task_count(spark: SparkSession, pieces: int, size: int | None) -> int:
    """Tasks for pieces of work, such as files, that have size bytes in all. Small pieces share tasks, as the start of a
    task costs more than they do; so tasks grow with bytes, and with pieces only by TASK_PIECES."""
    by_work = -(-(size or 0) // TASK_BYTES) + pieces // TASK_PIECES
    return min(pieces, max(by_work, TASKS_A_CORE * spark.sparkContext.defaultParallelism))


def spread(rows: DataFrame, tasks: int, *keys) -> DataFrame:
    """rows dealt by keys to so many tasks. The number is given, as small rows that stand for much work would else be
    put together by their own size."""
    return rows.repartition(max(1, min(tasks, MOST_TASKS)), *keys)


@dataclass
class Written(WriterCommitMessage):
    """Files of a task under their temporary names, and the names that they get when the job is done."""

    files: list[tuple[str, str]]


class CommittedFiles:
    """What sinks of files share: tasks write under names of their own, and only a job that ends gives them theirs.

    A task that is run again leaves a file that no message names; nothing reads it, as its name ends in .unfinished.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")

    def put(self, name: str, content: bytes) -> tuple[str, str]:
        system, root = file_system(self.path)
        final = f"{root}/{name}"
        system.create_dir(final.rsplit("/", 1)[0], recursive=True)
        found = f"{final}.{uuid.uuid4().hex}.unfinished"
        with system.open_output_stream(found) as out:
            out.write(content)
        return found, final

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.path)
        for message in messages:
            for found, final in message.files if message else ():
                system.move(found, final)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.path)
        for message in messages:
            for found, _ in message.files if message else ():
                system.delete_file(found)


class NamedFilesWriter(CommittedFiles, DataSourceWriter):
    def write(self, rows: Iterator) -> Written:
        return Written([self.put(r["name"], bytes(r["content"])) for r in rows])


class NamedFiles(DataSource):
    """Sink of rows (name string, content binary): a file for each."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NamedFilesWriter(self.options)


def write_files(files: DataFrame, path: str) -> None:
    """Each row (name, content) as a file under path; files of the same name are replaced."""
    files.sparkSession.dataSource.register(NamedFiles)
    files.select("name", "content").write.format("named_files").mode("append").save(path)
