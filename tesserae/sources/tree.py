"""A directory as a table: names, kinds, modes, sizes, times and link targets, walked in parallel.

Folders down to a depth are listed first and dealt to tasks, each of which walks what lies below its own. Filters
on the path skip whole folders, those on kind and size skip rows before they leave the task.
"""

from __future__ import annotations

import os
import stat
import unicodedata
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from tesserae.workers import by_value

by_value(__name__)

# Names that are never listed, and what such names begin with.
IGNORED, IGNORED_BEGINS = (".DS_Store", "Thumbs.db", "desktop.ini"), ("._", ".tesserae")
_SCHEMA = "path string, kind string, mode int, size long, mtime_ms long, target string"


def ignored(name: str) -> bool:
    return name in IGNORED or name.startswith(IGNORED_BEGINS)


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class Tree(DataSource):
    """(path, kind, mode, size, mtime_ms, target) of everything below the option ``path``, but for ignored names.

    Paths are relative, with ``/``, in NFC; of names that are the same in NFC each has its row. Kinds are file, folder, symlink and other;
    links are told and not followed; only files have a size. What vanishes during the walk is left out. ``depth`` (1) is how deep folders are listed before they are dealt out. The folder
    must be one that all executors see.
    """

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Walk(self.options)


class _Walk(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].removeprefix("file://")
        self.depth = int(options.get("depth", 1))
        self.begins, self.tests = "", []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        compare = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if isinstance(f, StringStartsWith) and column == "path":
                if len(f.value) > len(self.begins):
                    self.begins = f.value
                yield f  # a longer one may be pushed than all of them ask for
            elif type(f) in compare and column in ("kind", "size", "mtime_ms", "mode"):
                self.tests.append((column, compare[type(f)], f.value))
            elif isinstance(f, In) and column == "kind":
                self.tests.append((column, "in", tuple(f.value)))
            else:
                yield f

    def _may_hold(self, folder: str) -> bool:
        """Whether paths that begin as asked can lie below a folder."""
        below = unicodedata.normalize("NFC", folder) + "/"
        return below.startswith(self.begins) or self.begins.startswith(below)

    def _children(self, folder: str) -> list[tuple[os.DirEntry, str]]:
        try:
            found = os.scandir(os.path.join(self.root, folder))
        except FileNotFoundError:
            if folder:
                return []
            raise
        with found:
            return sorted(((e, f"{folder}/{e.name}" if folder else e.name) for e in found if not ignored(e.name)), key=lambda p: p[0].name)

    def partitions(self) -> list[_Folder]:
        out, level = [], [""]
        for at in range(self.depth + 1):
            out += [_Folder(f, at == self.depth) for f in level]
            if at < self.depth:
                level = [p for f in level for e, p in self._children(f) if e.is_dir(follow_symlinks=False) and self._may_hold(p)]
        return out

    def read(self, partition: _Folder) -> Iterator[tuple]:
        import operator

        ops = {"==": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "in": lambda a, b: a in b}
        at = {"kind": 1, "mode": 2, "size": 3, "mtime_ms": 4}
        todo = [partition.path]
        while todo:
            for entry, path in self._children(todo.pop()):
                try:
                    s = entry.stat(follow_symlinks=False)
                    target = os.readlink(entry.path) if stat.S_ISLNK(s.st_mode) else None
                except FileNotFoundError:
                    continue
                link = stat.S_ISLNK(s.st_mode)
                kind = "symlink" if link else "folder" if stat.S_ISDIR(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else "other"
                if kind == "folder" and partition.deep and self._may_hold(path):
                    todo.append(path)
                row = (unicodedata.normalize("NFC", path), kind, stat.S_IMODE(s.st_mode), s.st_size if kind == "file" else 0, s.st_mtime_ns // 1_000_000, target)
                if row[0].startswith(self.begins) and all(ops[o](row[at[c]], v) for c, o, v in self.tests):
                    yield row


def tree(spark: SparkSession, path: str, depth: int = 1) -> DataFrame:
    spark.dataSource.register(Tree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tree").option("path", path).option("depth", str(depth)).load()
