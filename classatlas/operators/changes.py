"""Change detection by modification time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(artifacts: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Artifacts newer than the snapshot or unknown to it; going back is not a change."""
    old = snapshot.select("jar_path", F.col("mtime_ns").alias("old_ns"))
    return (
        artifacts.join(old, "jar_path", "left")
        .where(F.coalesce("old_ns", F.lit(0)) < F.col("mtime_ns"))
        .select(*artifacts.columns)
    )


def moved_snapshot(artifacts: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``(jar_path, mtime_ns)`` rows that differ from the snapshot in any direction."""
    return artifacts.select("jar_path", "mtime_ns").join(snapshot, ["jar_path", "mtime_ns"], "left_anti")
