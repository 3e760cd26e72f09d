"""Corpus sources: checked-out trees, archives and tables of source files."""

from __future__ import annotations

import zipfile
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..session import dealt, materialize, spread
from .files import open_root

FILE_COLUMNS = ["repo", "file_path", "content"]
#: Texts that a task gathers before it passes them on: many small files, or one large one.
BATCH_BYTES, BATCH_FILES = 4 << 20, 1000
#: Members of an archive that are read at one go, by their size and number; a task opens the archive for each such piece.
PIECE_BYTES, PIECE_FILES = 64 << 20, 20_000


def decode_text(raw: Column) -> Column:
    """UTF-8 text without undecodable bytes and with ``\\n`` line ends."""
    text = F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))
    return F.regexp_replace(text, r"\r\n?", "\n")


def _bounded(files, columns: list[str]):
    """Frames of the rows ``files`` yields, of about ``BATCH_BYTES`` and at most ``BATCH_FILES`` files each."""
    rows, size = [], 0
    for row in files:
        rows.append(row)
        size += len(row[-1])
        if size >= BATCH_BYTES or len(rows) >= BATCH_FILES:
            yield pd.DataFrame(rows, columns=columns)
            rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def _walk(spark: SparkSession, root: str, enter, take) -> DataFrame:
    """Paths ``(path)`` below ``root``, relative to it, of the files whose name ``take`` accepts.

    The tree is walked level by level: each level is a table of folders, listed by tasks; folders whose name ``enter``
    refuses are pruned on the way.
    """
    def list_folders(batches):
        filesystem, base = open_root(root)
        for batch in batches:
            for folder in batch["path"]:
                found = filesystem.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/")))
                rows = [(e.path[len(base) + 1:], e.type == fs.FileType.Directory, e.base_name) for e in found]
                rows = [(path, is_dir) for path, is_dir, name in rows if (enter(name) if is_dir else take(name))]
                yield pd.DataFrame(rows, columns=["path", "is_dir"])

    levels, folders = [], spark.createDataFrame([("",)], "path string")
    while True:
        level = materialize(folders.mapInPandas(list_folders, "path string, is_dir boolean"), "tree")
        levels.append(level.where(~F.col("is_dir")).select("path"))
        folders = level.where("is_dir").select("path")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        folders = dealt(folders, "path")


def list_tree(spark: SparkSession, root: str, profile: str = "enhanced") -> DataFrame:
    """Paths below ``root`` with a known extension, as ``(path)`` relative to it.

    Spark's own file listing leaves out names that start with ``_`` or ``.``, which would lose
    files such as ``__init__.py``. Skipped folders are not entered.
    """
    skip, endings = set(rules.SKIP_DIRS[profile]), tuple(rules.LANGUAGES[profile])
    return _walk(spark, root, lambda name: name not in skip and not name.startswith("."),
                 lambda name: name.lower().endswith(endings))


def _read(listed: DataFrame, root: str) -> DataFrame:
    """``(path, raw)`` of the listed files."""
    def read(batches):
        filesystem, base = open_root(root)

        def files():
            for batch in batches:
                for path in batch["path"]:
                    with filesystem.open_input_stream(f"{base}/{path}") as stream:
                        yield path, stream.readall()
        yield from _bounded(files(), ["path", "raw"])

    return dealt(listed, "path").mapInPandas(read, "path string, raw binary")


def read_texts(spark: SparkSession, root: str, ending: str) -> DataFrame:
    """Files below ``root`` whose name has that ending, as ``(path, content)``; tasks list and read them, so the driver
    holds no list of files and a task reads many small ones."""
    listed = _walk(spark, root, lambda name: True, lambda name: name.endswith(ending))
    return _read(listed, root).select("path", F.col("raw").cast("string").alias("content"))


def scan_corpus(spark: SparkSession, root: str, profile: str = "enhanced") -> DataFrame:
    """Files below ``root`` as ``(repo, file_path, content)``; the first folder names the repo.

    Folder and extension tests run while listing, so other files are never opened.
    """
    raw = _read(list_tree(spark, root, profile).where(F.col("path").contains("/")), root)
    return raw.select(F.substring_index("path", "/", 1).alias("repo"),
                      F.regexp_replace("path", "^[^/]*/", "").alias("file_path"), decode_text(F.col("raw")).alias("content"))


def scan_zip(spark: SparkSession, path: str) -> DataFrame:
    """Members of the ``.zip`` archives in a folder as files; the archive's name is the repo. Archives are opened in
    place and dealt to tasks in pieces, so a large one is read by many; members are read one by one, so a task holds one
    member and a batch, never an archive."""
    def listed(batches):
        filesystem, base = open_root(path)
        for _ in batches:
            found = filesystem.get_file_info(fs.FileSelector(base))
            yield pd.DataFrame({"archive": [e.base_name for e in found if e.base_name.endswith(".zip")]})

    def cut(batches):
        filesystem, base = open_root(path)
        for batch in batches:
            for name in batch["archive"]:
                with filesystem.open_input_file(f"{base}/{name}") as stream, zipfile.ZipFile(stream) as archive:
                    sizes = [member.file_size for member in archive.infolist()]
                rows, first, size = [], 0, 0
                for place, more in enumerate(sizes):
                    if place > first and (size + more > PIECE_BYTES or place - first >= PIECE_FILES):
                        rows.append((name, first, place))
                        first, size = place, 0
                    size += more
                yield pd.DataFrame([*rows, (name, first, len(sizes))], columns=["archive", "first", "end"])

    def members(batches):
        filesystem, base = open_root(path)

        def files():
            for batch in batches:
                for name, first, end in batch[["archive", "first", "end"]].itertuples(index=False):
                    with filesystem.open_input_file(f"{base}/{name}") as stream, zipfile.ZipFile(stream) as archive:
                        for member in archive.infolist()[first:end]:
                            if not member.is_dir():
                                yield name.removesuffix(".zip"), member.filename, archive.read(member)
        yield from _bounded(files(), ["repo", "file_path", "raw"])

    archives = materialize(spark.createDataFrame([("",)], "path string").mapInPandas(listed, "archive string"), "archives")
    pieces = materialize(dealt(archives).mapInPandas(cut, "archive string, first long, end long"), "pieces")
    rows = dealt(pieces).mapInPandas(members, "repo string, file_path string, raw binary")
    return rows.select("repo", "file_path", decode_text(F.col("raw")).alias("content"))


def scan_table(df: DataFrame) -> DataFrame:
    """Any table with ``repo``, ``file_path`` and ``content``."""
    return spread(df.select(*FILE_COLUMNS), "repo", "file_path")
