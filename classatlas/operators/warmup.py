"""Which artifacts to warm up, and in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classatlas.functions import names


def queue_order(tasks: DataFrame) -> DataFrame:
    """One task per artifact, in execution order.

    The most urgent task of an artifact stays, the oldest of equals; the result
    is sorted by priority, then age.
    """
    best = tasks.groupBy("jar_path").agg(
        F.max(F.struct("priority", (-F.col("seq")).alias("age"), "mode")).alias("best")
    )
    return best.select(
        "jar_path", "best.priority", (-F.col("best.age")).alias("seq"), "best.mode"
    ).orderBy(F.col("priority").desc(), F.col("seq").asc())


def group_targets(artifacts: DataFrame, group: str, limit: int | None = None, root: str = "") -> DataFrame:
    """Artifacts of a group in order of their paths, which lie below ``root``."""
    directory = f"{root}/{names.group_directory(group)}/" if root else f"{names.group_directory(group)}/"
    targets = artifacts.where(F.startswith("jar_path", F.lit(directory))).orderBy("jar_path")
    return targets if limit is None else targets.limit(limit)


def run_summary(loads: DataFrame) -> DataFrame:
    """Counters over ``(jar_path, classes_loaded, skipped, failed)`` rows."""
    return loads.agg(
        F.count("*").alias("targets"),
        F.count_if(~F.col("failed")).alias("succeeded"),
        F.count_if("failed").alias("failed"),
        F.coalesce(F.sum("classes_loaded"), F.lit(0).cast("long")).alias("classes_loaded"),
    )
