"""Directory listings as a Python data source: files, symbolic links and the first bytes of files."""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, kind string, size long, mtime long, symlink string, header binary, error string"


#: Directories that the driver opens, level by level, until there are so many to deal out.
SPREAD = 256


class _Part(InputPartition):
    """Some of the paths to walk: directories with all in them (deep) or only with their own files."""

    def __init__(self, paths: list[tuple[str, bool]]) -> None:
        super().__init__(paths)
        self.paths = paths


def _record(path: str, header_bytes: int) -> tuple | None:
    """One row: a regular file (also through a link to one), or a link to anything else; other nodes are passed over."""
    try:
        st = os.lstat(path)
        target = None
        if stat.S_ISLNK(st.st_mode):
            target = os.readlink(path)
            try:
                st = os.stat(path)
            except OSError:
                st = None
            if st is None or not stat.S_ISREG(st.st_mode):
                own = os.lstat(path)
                return (path, "symlink", len(os.fsencode(target)), int(own.st_mtime), target, None, None)
        if not stat.S_ISREG(st.st_mode):
            return None
        header = error = None
        if header_bytes:
            try:
                with open(path, "rb") as f:
                    header = f.read(header_bytes)
            except OSError:
                error = "bad_open"
        return (path, "file", st.st_size, int(st.st_mtime), target, header, error)
    except OSError:
        return (path, "other", None, None, None, None, "bad_stat")


def _inside(path: str) -> tuple[list[str], list[str]]:
    """(files and links, directories) in a directory, each by name."""
    with os.scandir(path) as found:
        entries = sorted(found, key=lambda e: os.fsencode(e.name))
    named = [(e.name if path == "." else os.path.join(path, e.name), e.is_dir(follow_symlinks=False)) for e in entries]
    return [p for p, folder in named if not folder], [p for p, folder in named if folder]


def walk(path: str, header_bytes: int, deep: bool = True) -> Iterator[tuple]:
    """Files first, then directories, each by name, depth first; links to directories are not followed. What can't be looked at gives a row with an error."""
    waiting = [path]
    while waiting:
        path = waiting.pop()
        if not os.path.isdir(path) or os.path.islink(path):
            row = _record(path, header_bytes)
            if row:
                yield row
            continue
        try:
            files, folders = _inside(path)
        except OSError:
            yield (path, "directory", None, None, None, None, "bad_listdir")
            continue
        for p in files:
            if row := _record(p, header_bytes):
                yield row
        if deep:
            waiting += reversed(folders)


def spread(roots: list[str], enough: int = SPREAD) -> list[tuple[str, bool]]:
    """(path, whether with all in it) for the tasks: the directories of the first levels that have `enough` of them, and those above with their own files only."""
    done, level = [], [(p, True) for p in sorted(set(roots))]
    while level and len(level) < enough:
        below = []
        for p, _ in level:
            try:
                folders = _inside(p)[1] if os.path.isdir(p) and not os.path.islink(p) else []
            except OSError:
                folders = []
            done.append((p, not folders))
            below += [(f, True) for f in folders]
        level = below
    return done + level


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.roots = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.header_bytes = int(options.get("headerbytes", options.get("headerBytes", "512")))

    def partitions(self) -> list[InputPartition]:
        """SPREAD of them at most, each with directories dealt out by turns."""
        paths = spread(self.roots)
        return [_Part(paths[k::SPREAD]) for k in range(min(SPREAD, len(paths)))]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path, deep in partition.paths:
            yield from walk(path, self.header_bytes, deep)


class ListingSource(DataSource):
    """`spark.read.format("file_listing").option("paths", '["a", "b"]').option("headerBytes", 512)`, or option path for one; 0 header bytes opens no file."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ListingSource)
