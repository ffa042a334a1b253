"""Index of simple names, valid by the modification times of archives.

For every state of an archive that was read, the index holds its classes by simple name.
A state is known by path and modification time: rows of an archive that has changed since,
or is gone, count for nothing, and only archives without rows of their present state are
opened. So a lookup opens as many archives as were changed since the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classatlas.operators import catalog
from classatlas.operators.skew import join_lookup

STATE = ["jar_path", "mtime_ns"]


def unread(artifacts: DataFrame, read: DataFrame) -> DataFrame:
    """``(jar_path, mtime_ns)`` of artifacts whose present state was never read."""
    return artifacts.select(*STATE).distinct().join(read.select(*STATE), STATE, "left_anti")


def of_entries(entries: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``(simple_name, fqn, jar_path, mtime_ns)`` of the entries of freshly read archives."""
    return catalog.simple_names(entries).join(artifacts.select(*STATE), "jar_path").select(
        "simple_name", "fqn", "jar_path", "mtime_ns")


def matches(index: DataFrame, wanted: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``(simple_name, jar_path, fqn)`` of the wanted names in the present states of artifacts, distinct."""
    named = join_lookup(index, wanted.select("simple_name").distinct(), ["simple_name"], "left_semi")
    return named.join(artifacts.select(*STATE), STATE, "left_semi").select("simple_name", "jar_path", "fqn").distinct()
