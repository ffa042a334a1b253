"""New and changed archives as a stream.

``spark.readStream.format("artifact_changes")`` follows a directory tree. Its offset is a
point in time: a batch holds the archives whose last change lies between two offsets, so
a path that changes again is reported again, which Spark's own file source does not do.
A change is the later one of modification and status change; an archive that was copied
with an old modification time is new all the same.

Tasks walk the tree. The driver opens a fixed number of directories at most, to deal out
what lies below them; it sees no archives.

Defined cases: a missing directory is an empty one. A batch that Spark repeats leaves out
archives that changed or vanished meanwhile; those that changed are in a later batch. A
directory that is moved into the tree as a whole keeps the times of its files and goes
unnoticed, as does an archive that is deleted; a full update finds the former.
"""

from __future__ import annotations

import os
import time
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from classatlas.sources.artifacts import children

NAME = "artifact_changes"
SCHEMA = "jar_path string, mtime_ns long, length long"

# directories the driver opens for a batch, and most tasks it deals their contents out to
_OPENED = 256
_TASKS = 64
_NANOS = 1_000_000_000


class Subtrees(InputPartition):
    """Directories of one task, ``(path, whether to go down)``, and the time between two offsets."""

    def __init__(self, directories: list[tuple[str, bool]], after: int, until: int):
        self.directories, self.after, self.until = directories, after, until


def deal_out(root: str, opened: int = _OPENED, tasks: int = _TASKS) -> list[list[tuple[str, bool]]]:
    """Every directory below ``root`` exactly once, by itself or below one that is gone down."""
    waiting, flat = deque([root]), []
    while waiting and len(flat) < opened:
        directory = waiting.popleft()
        flat.append((directory, False))
        waiting.extend(child.path for child in children(directory) if child.is_dir(follow_symlinks=False))
    parts = [*flat, *((directory, True) for directory in waiting)]
    return [parts[k::tasks] for k in range(min(tasks, len(parts)))]


def changed_between(directory: str, deep: bool, after: int, until: int) -> Iterator[tuple[str, int, int]]:
    """Archives of a directory, or of all below it, changed after the one time and not after the other."""
    waiting = [directory]
    while waiting:
        for child in children(waiting.pop()):
            if child.name.endswith(".jar") and child.name != ".jar":
                try:
                    status = child.stat()
                except FileNotFoundError:  # a link that leads nowhere, or a file deleted meanwhile
                    continue
                if after < max(status.st_mtime_ns, status.st_ctime_ns) <= until:
                    yield child.path, max(status.st_mtime_ns, 0), status.st_size
            if deep and child.is_dir(follow_symlinks=False):
                waiting.append(child.path)


class ChangeReader(DataSourceStreamReader):
    def __init__(self, root: str, settle: float, tasks: int = _TASKS):
        self.root, self.settle, self.tasks = root, settle, tasks

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - int(self.settle * _NANOS)}

    def partitions(self, start: dict, end: dict) -> list[Subtrees]:
        return [Subtrees(part, start["until"], end["until"]) for part in deal_out(self.root, tasks=self.tasks)]

    def read(self, partition: Subtrees) -> Iterator[tuple[str, int, int]]:
        for directory, deep in partition.directories:
            yield from changed_between(directory, deep, partition.after, partition.until)


class ArtifactChanges(DataSource):
    """Options: ``path``; ``settle_seconds`` (default 10), how long a change must lie back; ``tasks`` (default 64).

    The wait must exceed what the clocks of the file server and the driver differ by: a file
    may not get a time that an offset has already passed.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChangeReader:
        root = self.options.get("path", "").rstrip("/")
        if not root:
            raise ValueError("artifact_changes needs the path of a directory")
        return ChangeReader(
            root, float(self.options.get("settle_seconds", "10")), int(self.options.get("tasks", str(_TASKS))))


def artifact_changes(spark: SparkSession, root: str, settle_seconds: float = 10) -> DataFrame:
    """``(jar_path, mtime_ns, length)`` of archives below ``root`` as they come and change, two tasks per slot."""
    spark.dataSource.register(ArtifactChanges)
    stream = spark.readStream.format(NAME).option("settle_seconds", str(settle_seconds))
    return stream.option("tasks", str(2 * spark.sparkContext.defaultParallelism)).load(root)
