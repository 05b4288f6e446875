"""``df.write.format("documents")`` and ``writeStream``: rows as lines of JSON, each exactly once.

Options: ``path``, a folder that driver and executors share.  A task writes a file of its own under a
hidden folder and reports its name; only the driver's commit moves the files of tasks that were
accepted to where readers look, so files of failed, retried or speculative tasks are never read, and
go with the hidden folder.  A stream's batch is a folder ``batch=<id>`` that appears in one rename:
a batch run again after a restart finds it and leaves it as it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql import functions as F

STAGED = "_staged"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a URI or of a local path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class Lines:
    """What batches and streams share: staging by tasks, moving by the driver."""

    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def folder(self) -> tuple[fs.FileSystem, str, str]:
        files, path = filesystem(self.path)
        return files, path, f"{path}/{STAGED}/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _, staged = self.folder()
        files.create_dir(staged)
        name, rows = f"{staged}/{uuid.uuid4().hex}.json", 0
        with files.open_output_stream(name) as out:
            for batch in iterator:
                for line in batch.column("json").to_pylist():
                    out.write(line.encode() + b"\n")
                rows += batch.num_rows
        return Written(name, rows)

    def settle(self, messages: list[Written | None], to: str) -> None:
        """Moves accepted files with rows into ``to`` and drops the rest of the job."""
        files, _, staged = self.folder()
        files.create_dir(to)
        for m in messages:
            if m is not None and m.rows:
                files.move(m.file, f"{to}/{m.file.rpartition('/')[2]}")
        self.drop(files, staged)

    def drop(self, files: fs.FileSystem, staged: str) -> None:
        if files.get_file_info(staged).type != fs.FileType.NotFound:
            files.delete_dir(staged)


class BatchLines(Lines, DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        super().__init__(path)
        self.overwrite = overwrite

    def commit(self, messages: list[Written | None]) -> None:
        files, path, _ = self.folder()
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if not old.base_name.startswith("_"):
                    (files.delete_dir if old.type == fs.FileType.Directory else files.delete_file)(old.path)
        self.settle(messages, path)

    def abort(self, messages: list[Written | None]) -> None:
        files, _, staged = self.folder()
        self.drop(files, staged)


class StreamLines(Lines, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        files, path, staged = self.folder()
        final = f"{path}/batch={batchId}"
        if files.get_file_info(final).type != fs.FileType.NotFound:
            return self.drop_files(files, messages)
        ready = f"{staged}-{batchId}"
        files.create_dir(ready)
        for m in messages:
            if m is not None and m.rows:
                files.move(m.file, f"{ready}/{m.file.rpartition('/')[2]}")
        files.move(ready, final)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.drop_files(self.folder()[0], messages)

    def drop_files(self, files: fs.FileSystem, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and files.get_file_info(m.file).type != fs.FileType.NotFound:
                files.delete_file(m.file)


class DocumentSink(DataSource):
    """Takes one column ``json`` of lines."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "json string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BatchLines(self.options["path"], overwrite)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return StreamLines(self.options["path"])


def lines(rows: DataFrame) -> DataFrame:
    """``rows`` as one column ``json``, null fields kept."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("json"))


def save(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Writes any rows as lines of JSON (mode ``append`` or ``overwrite``)."""
    rows.sparkSession.dataSource.register(DocumentSink)
    lines(rows).write.format("documents").option("path", path).mode(mode).save()


def save_stream(rows: DataFrame, path: str, checkpoint: str):
    """A streaming query, not started with a trigger yet, that writes rows as lines of JSON."""
    rows.sparkSession.dataSource.register(DocumentSink)
    return lines(rows).writeStream.format("documents").option("path", path).option("checkpointLocation", checkpoint)


def saved(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What was written, by batches and streams alike."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
