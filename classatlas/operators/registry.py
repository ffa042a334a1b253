"""The class registry: class name to artifacts, kept as rows.

A class that occurs in very many artifacts stays that many rows; no per-class
list is ever built, so no key can outgrow a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classatlas.operators.skew import join_lookup


def build(catalog: DataFrame) -> DataFrame:
    """``(fqn, jar_path, seq)`` from ``(fqn, jar_path, seq)`` rows with repetitions.

    ``min`` is combined before the exchange, repetitions never travel.
    """
    return catalog.groupBy("fqn", "jar_path").agg(F.min("seq").alias("seq"))


def new_pairs(catalog: DataFrame, registry: DataFrame) -> DataFrame:
    """Pairs of the catalog that the registry does not have yet."""
    return build(catalog).join(registry, ["fqn", "jar_path"], "left_anti")


def artifact_counts(registry: DataFrame) -> DataFrame:
    """Number of artifacts and the first one appended, per class."""
    return registry.groupBy("fqn").agg(
        F.count("*").alias("artifacts"), F.min_by("jar_path", "seq").alias("first_jar")
    )


def artifacts_of(registry: DataFrame, fqns: DataFrame) -> DataFrame:
    """Registered artifacts of the requested classes, ``seq`` gives append order."""
    wanted = fqns.select("fqn").distinct()
    return join_lookup(registry, wanted, ["fqn"], "left_semi").select("fqn", "jar_path", "seq")


def uncataloged(artifacts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Artifacts, or rows of artifacts, that were never cataloged."""
    return artifacts.join(manifest, "jar_path", "left_anti")


def index_summary(artifacts: DataFrame, status: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row of counters for an indexing run.

    ``status`` has one row per newly opened archive, ``catalog`` one row per class
    entry, repetitions included.
    """
    scanned = artifacts.agg(F.count("*").alias("scanned_jars"))
    opened = status.agg(
        F.count_if("readable").alias("cataloged_jars_new"),
        F.count_if(~F.col("readable")).alias("failed_jars"),
    )
    indexed = catalog.agg(F.count("*").alias("indexed_classes"))
    return side_by_side(scanned, opened, indexed)


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Put one-row results next to each other: stack them, then take the only value per column."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])
