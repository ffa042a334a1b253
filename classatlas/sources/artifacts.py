"""Distributed listing of archives below a directory on a shared file system.

A task lists a bounded number of directories below each one it was given and hands
the rest back; those are spread over all tasks in the next round. Small trees take
one round, large ones are balanced again and again, and neither the driver nor one
task ever walks a whole tree. Every round is checkpointed, which keeps the lineage
flat and lists each directory once.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from classatlas.functions.names import parent_directories, version_of_path
from classatlas.session import ensure_checkpoint_dir

# directories one task lists below each directory of its input
_BUDGET = 256
_ROWS = 4096
_LISTING = "path string, artifact boolean, pending boolean, mtime_ns long, length long"
_LISTING_ARROW = pa.schema([
    ("path", pa.string()), ("artifact", pa.bool_()), ("pending", pa.bool_()),
    ("mtime_ns", pa.int64()), ("length", pa.int64()),
])


def default_repository() -> str:
    return str(Path.home() / ".m2" / "repository")


def children(directory: str) -> Iterator[os.DirEntry]:
    """Entries of a directory; none if it is gone. Any other failure fails the task, and Spark tries again."""
    try:
        with os.scandir(directory) as found:
            yield from found
    except (FileNotFoundError, NotADirectoryError):
        return


def _walk(top: str) -> Iterator[tuple[str, bool, bool, int, int]]:
    """Artifacts below a directory, and the directories left when the budget is spent."""
    waiting, budget = deque([top]), _BUDGET
    while waiting and budget:
        budget -= 1
        for child in children(waiting.popleft()):
            if child.name.endswith(".jar") and child.name != ".jar":
                try:
                    status = child.stat()
                    yield child.path, True, False, max(status.st_mtime_ns, 0), status.st_size
                except FileNotFoundError:  # a link that leads nowhere, or a file deleted meanwhile
                    yield child.path, True, False, 0, 0
            if child.is_dir(follow_symlinks=False):
                waiting.append(child.path)
    for directory in waiting:
        yield directory, False, True, 0, 0


def _list_directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[str, bool, bool, int, int]] = []

    def packed() -> pa.RecordBatch:
        columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), _LISTING_ARROW)]
        return pa.RecordBatch.from_arrays(columns, schema=_LISTING_ARROW)

    for batch in batches:
        for top in batch.column("path").to_pylist():
            for row in _walk(top):
                rows.append(row)
                if len(rows) >= _ROWS:
                    yield packed()
                    rows.clear()
    if rows:
        yield packed()


def disjoint(roots: DataFrame) -> DataFrame:
    """``path`` of the directories that lie below no other of them, each once.

    What they hold is what all of them hold; a subtree outside is never entered, and none twice.
    """
    paths = roots.select("path").distinct()
    above = paths.select("path", F.explode(parent_directories(F.col("path"))).alias("above"))
    covered = above.join(paths.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()
    return paths.join(covered, "path", "left_anti")


def list_artifacts(spark: SparkSession, roots: str | list[str] | DataFrame) -> DataFrame:
    """All ``*.jar`` paths below the roots (a ``path`` column, if many) with modification time and size.

    Hidden directories are searched, symbolic links to directories are not
    followed, and a directory named like an archive is reported as well.
    """
    ensure_checkpoint_dir(spark)
    slots = spark.sparkContext.defaultParallelism
    one = isinstance(roots, str)
    if isinstance(roots, DataFrame):
        frontier, one = disjoint(roots), True
    else:
        frontier = spark.createDataFrame([(root,) for root in ([roots] if one else roots)], "path string").coalesce(1)
    rounds = []
    while True:
        listed = frontier.mapInArrow(_list_directories, _LISTING).checkpoint()
        rounds.append(listed.where("artifact"))
        pending = listed.where("pending").select("path")
        if pending.isEmpty():
            break
        frontier = pending.repartition(slots, "path")
    found = reduce(DataFrame.unionByName, rounds)
    artifacts = found.select(F.col("path").alias("jar_path"), "mtime_ns", "length")
    # only nested roots can list a path twice
    return artifacts if one else artifacts.distinct()


def with_version(artifacts: DataFrame) -> DataFrame:
    return artifacts.withColumn("version", version_of_path(F.col("jar_path")))

