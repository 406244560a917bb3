"""A Python data source over a directory tree: ``spark.read.format("fstree").load(root)``.

One row per regular file, and one per folder or file that cannot be read. Symbolic links and special files are
left out (so there are no cycles), hidden and empty files are not. The built-in binary source loses hidden,
underscore and empty files and follows links, hence this one.

The driver lists folders breadth first until there are enough subtrees for all tasks; each partition then walks its
subtrees on an executor with an explicit stack. The tree must be mounted where executors run.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "entry_kind string, path string, name string, size long, mtime_ms long, dev long, ino long"


def _entry(kind: str, path: str, info: os.stat_result | None = None) -> tuple:
    name = path.rsplit("/", 1)[1]
    if info is None:
        return kind, path, name, None, None, None, None
    return kind, path, name, info.st_size, info.st_mtime_ns // 1_000_000, info.st_dev, info.st_ino


def _representable(path: str) -> bool:
    """Names that are no UTF-8 cannot be columns; such entries are reported as inaccessible under an escaped name."""
    try:
        path.encode()
    except UnicodeEncodeError:
        return False
    return True


def list_folder(folder: str, excluded: frozenset[str]) -> tuple[list[tuple], list[str]]:
    """(rows, subfolders) of one folder. Folders named in ``excluded`` are neither listed nor counted."""
    rows, below = [], []
    try:
        with os.scandir(folder) as entries:
            found = list(entries)
    except OSError:
        return [_entry("inaccessible_dir", folder.encode(errors="surrogateescape").decode(errors="replace"))], []
    for e in found:
        path = f"{folder.rstrip('/')}/{e.name}"
        try:
            info = e.stat(follow_symlinks=False)
        except OSError:
            rows.append(_entry("inaccessible_file", path.encode(errors="surrogateescape").decode(errors="replace")))
            continue
        if stat.S_ISDIR(info.st_mode):
            if e.name not in excluded:
                below.append(path)
        elif stat.S_ISREG(info.st_mode):
            if _representable(path):
                rows.append(_entry("file", path, info))
            else:
                rows.append(_entry("inaccessible_file", path.encode(errors="surrogateescape").decode(errors="replace")))
    return rows, below


class Subtrees(InputPartition):
    """Rows found while planning, and folders still to walk."""

    def __init__(self, rows: list[tuple], folders: list[str]):
        self.rows, self.folders = rows, folders


class TreeReader(DataSourceReader):
    def __init__(self, root: str, excluded: frozenset[str], tasks: int):
        self.root, self.excluded, self.tasks = root, excluded, tasks

    def partitions(self) -> list[InputPartition]:
        seen, open_, limit = [], [self.root], 4 * self.tasks
        while open_ and len(open_) < self.tasks and limit:
            rows, below = list_folder(open_.pop(0), self.excluded)
            seen += rows
            open_ += below
            limit -= 1
        parts: list[InputPartition] = [Subtrees([], open_[i :: self.tasks]) for i in range(min(self.tasks, len(open_)))]
        return [Subtrees(seen, []), *parts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from partition.rows
        todo = list(partition.folders)
        while todo:
            rows, below = list_folder(todo.pop(), self.excluded)
            yield from rows
            todo += below


class TreeSource(DataSource):
    """Options: path (the root), exclude (folder names, comma-separated), tasks."""

    @classmethod
    def name(cls) -> str:
        return "fstree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        root = os.path.normpath(os.path.abspath(self.options.get("path", ".")))
        excluded = frozenset(x for x in self.options.get("exclude", "").split(",") if x)
        return TreeReader(root, excluded, int(self.options.get("tasks", "32")))


def scan_tree(spark: SparkSession, root: str, excluded: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """Entries beneath ``root``; a root that is no readable folder gives one inaccessible_dir row."""
    spark.dataSource.register(TreeSource)
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    return spark.read.format("fstree").option("exclude", ",".join(excluded or [])).option("tasks", str(tasks)).load(root)
