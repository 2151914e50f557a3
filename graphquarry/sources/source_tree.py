"""Source files as ``(path, source)``."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphquarry.functions import paths
from graphquarry.sources.listing import read_texts

FORMAT = "source_folders"
#: Folders the driver opens while it looks for parts to hand out; whole trees below them go to tasks.
OPENED_FOLDERS = 1000
#: Files of one folder that one task reads.
FILES_PER_TASK = 2000

_PLACE = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:")
_NAMED = re.compile(r"[^/]\.(rs|ts|tsx)\Z")


class Folder(InputPartition):
    """A folder below the root: its whole tree, or every ``of``-th file of its own from ``turn`` on."""

    def __init__(self, below: str, whole: bool, turn: int = 0, of: int = 1) -> None:
        self.below, self.whole, self.turn, self.of = below, whole, turn, of


class SourceFolders(DataSource):
    """All scannable files below ``path``, hidden names included, read by tasks that each take folders."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, source string"

    def reader(self, schema) -> DataSourceReader:
        return SourceFoldersReader(self.options["path"], int(self.options.get("openedFolders", OPENED_FOLDERS)))


class SourceFoldersReader(DataSourceReader):
    def __init__(self, root: str, opened: int) -> None:
        self.root, self.opened = root, opened

    def _store(self) -> tuple[pafs.FileSystem, str]:
        if _PLACE.match(self.root):
            store, base = pafs.FileSystem.from_uri(self.root)
        else:
            store, base = pafs.LocalFileSystem(), self.root
        return store, base.rstrip("/")

    @staticmethod
    def _listed(store: pafs.FileSystem, base: str, below: str) -> tuple[list[str], list[str]]:
        """Folders to go into and files to read, both relative to the root, in name order."""
        folders, files = [], []
        for info in store.get_file_info(pafs.FileSelector(f"{base}/{below}".rstrip("/") or "/", recursive=False)):
            name = f"{below}/{info.base_name}".lstrip("/")
            if info.type == pafs.FileType.Directory and info.base_name not in paths.SKIPPED_DIRS:
                folders.append(name)
            elif info.type == pafs.FileType.File and _NAMED.search(name) and not name.endswith(".d.ts"):
                files.append(name)
        return sorted(folders), sorted(files)

    def partitions(self) -> list[Folder]:
        store, base = self._store()
        parts, waiting, opened = [], [""], 0
        while waiting and opened < self.opened:
            below = waiting.pop(0)
            opened += 1
            folders, files = self._listed(store, base, below)
            waiting += folders
            of = -(-len(files) // FILES_PER_TASK)
            parts += [Folder(below, False, turn, of) for turn in range(of)]
        return parts + [Folder(below, True) for below in waiting] or [Folder("", False)]

    def read(self, part: Folder) -> Iterator[tuple[str, str]]:
        store, base = self._store()
        waiting = [part.below]
        while waiting:
            folders, files = self._listed(store, base, waiting.pop())
            waiting += folders if part.whole else []
            for name in files[part.turn :: part.of]:
                with store.open_input_stream(f"{base}/{name}") as stream:
                    yield name, stream.read().decode("utf-8", "replace")


def read_source_tree(spark: SparkSession, root: str, hidden: bool = True) -> DataFrame:
    """Read every scannable file below ``root``, one row per file, path relative to it.

    Tasks list and read the folders themselves, for stores that Arrow's file systems open: shared or local folders,
    HDFS, and object stores. With ``hidden`` off Spark's own listing is used, for any store Spark reads; it leaves out
    names that begin with ``_`` or ``.``.
    """
    if hidden:
        spark.dataSource.register(SourceFolders)
        return scannable(spark.read.format(FORMAT).load(root))
    files = read_texts(spark, root, "*.{rs,ts,tsx}")
    return scannable(files.withColumnRenamed("text", "source"))


def scannable(files: DataFrame) -> DataFrame:
    return files.where(paths.is_source_file(F.col("path")))
