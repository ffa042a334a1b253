"""Counters over the tables of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classatlas.operators.registry import side_by_side


def table_counts(
    sources: DataFrame, registry: DataFrame, manifest: DataFrame, loaded: DataFrame, hotspots: DataFrame
) -> DataFrame:
    """One row of table sizes.

    Source entries are distinct (class, artifact) keys, indexed classes distinct
    names; both count on narrow columns.
    """
    return side_by_side(
        sources.select("fqn", "jar_path").distinct().agg(F.count("*").alias("source_entries")),
        registry.select("fqn").distinct().agg(F.count("*").alias("indexed_classes")),
        manifest.agg(F.count("*").alias("cataloged_jars")),
        loaded.agg(F.count("*").alias("loaded_jars")),
        hotspots.agg(
            F.count("*").alias("hotspot_jars"), F.count_if("warmed").alias("warmed_jars")
        ),
    )
