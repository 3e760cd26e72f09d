"""File systems of Python tasks, and a data source that writes documents and archives as files.

Rows arrive sorted, so a task streams one file after the other: no file, archive or repository is held in memory. A file
is written under a name of its own and renamed when it is complete, so readers never see half of one and a repeated or
speculative task only writes the same bytes again. Tasks report counts; the driver writes them into ``_SUCCESS``.
"""

from __future__ import annotations

import json
import os
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import dealt

FORMAT = "repolumen_files"


def open_root(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and base path of a folder. Spark's names of object stores and paths without scheme are understood."""
    scheme, separator, rest = uri.partition("://")
    if not separator:
        return fs.LocalFileSystem(), os.path.abspath(uri.removeprefix("file:")).rstrip("/")
    if scheme in ("s3a", "s3n"):
        uri = f"s3://{rest}"
    filesystem, base = fs.FileSystem.from_uri(uri)
    return filesystem, base.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


class _Target:
    """The file that is being written."""

    def __init__(self, filesystem, base: str, name: str, zipped: bool) -> None:
        self.filesystem, self.final = filesystem, f"{base}/{name}"
        folder, leaf = self.final.rsplit("/", 1)
        filesystem.create_dir(folder, recursive=True)
        self.path = f"{folder}/.{leaf[:100]}.{uuid.uuid4().hex}"
        self.stream = filesystem.open_output_stream(self.path)
        self.archive = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_DEFLATED) if zipped else None
        self.member, self.member_name = None, None

    def write(self, member: str | None, content: str) -> int:
        raw = (content or "").encode()
        if self.archive is None:
            self.stream.write(raw)
        else:
            if member != self.member_name:
                self._end_member()
                self.member, self.member_name = self.archive.open(member, "w"), member
            self.member.write(raw)
        return len(raw)

    def _end_member(self) -> None:
        if self.member is not None:
            self.member.close()
            self.member = None

    def close(self) -> None:
        if self.archive is not None:
            self._end_member()
            self.archive.close()
        self.stream.close()
        self.filesystem.move(self.path, self.final)

    def drop(self) -> None:
        self.stream.close()
        self.filesystem.delete_file(self.path)


class FileWriter(DataSourceArrowWriter):
    """Rows ``(file, member, content)``, sorted; rows of one file are written one after the other. With ``zipped``, files
    are archives and rows of one ``member`` its content."""

    def __init__(self, root: str, zipped: bool) -> None:
        self.root, self.zipped = root, zipped

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        filesystem, base = open_root(self.root)
        target, name, files, size = None, None, 0, 0
        try:
            for batch in iterator:
                columns = [batch.column(c) for c in ("file", "member", "content")]
                for row in zip(*columns, strict=True):
                    file, member, content = (x.as_py() for x in row)
                    if file != name:
                        if target is not None:
                            target.close()
                        target, name, files = _Target(filesystem, base, file, self.zipped), file, files + 1
                    size += target.write(member, content)
            if target is not None:
                target.close()
        except BaseException:
            if target is not None:
                target.drop()
            raise
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        filesystem, base = open_root(self.root)
        filesystem.create_dir(base, recursive=True)
        with filesystem.open_output_stream(f"{base}/_SUCCESS") as mark:
            mark.write(json.dumps({"files": sum(m.files for m in done), "bytes": sum(m.bytes for m in done)}).encode())


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, member string, content string"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], self.options.get("zipped", "false") == "true")


def write_files(rows: DataFrame, path: str, zipped: bool = False) -> None:
    """Write rows ``(file, member, content, order...)`` as files below ``path``; rows of a file go to one task, in the
    order of the other columns."""
    order = [c for c in rows.columns if c not in ("member", "content")]
    rows.sparkSession.dataSource.register(FileSink)
    dealt(rows, "file").sortWithinPartitions(*order).select("file", "member", "content") \
        .write.format(FORMAT).option("zipped", str(zipped).lower()).mode("append").save(path)
