"""Class catalogs of archives, from a DataFrame of entry names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classatlas.functions import names
from classatlas.operators.skew import join_lookup


def classes(entries: DataFrame) -> DataFrame:
    """``(jar_path, entry_idx, fqn)`` of top-level classes; duplicates stay."""
    return entries.where(names.is_top_level_class(F.col("entry_name"))).select(
        "jar_path", "entry_idx", names.class_of_entry(F.col("entry_name")).alias("fqn")
    )


def archive_status(entries: DataFrame) -> DataFrame:
    """One row per archive: ``(jar_path, readable)``."""
    return entries.where("entry_idx = -1").select("jar_path", F.isnull("error").alias("readable"))


def containing(entries: DataFrame, fqns: DataFrame) -> DataFrame:
    """Exact probe: ``(fqn, jar_path)`` of archives that hold the class file.

    Inner classes are found here as well, the catalog leaves them out. Few
    requests are broadcast by Spark's own size check, so entries only move when
    the requests are many.
    """
    wanted = fqns.select("fqn", names.entry_of_class(F.col("fqn")).alias("entry_name")).distinct()
    files = entries.where(F.endswith("entry_name", F.lit(names.CLASS_SUFFIX))).select("jar_path", "entry_name")
    return join_lookup(files, wanted, ["entry_name"]).select("fqn", "jar_path").distinct()


def simple_names(entries: DataFrame) -> DataFrame:
    """``(simple_name, jar_path, fqn)`` of top-level classes inside some package, distinct."""
    entry = F.col("entry_name")
    last = F.regexp_replace(F.substring_index(entry, "/", -1), r"\.class$", "")
    return entries.where(names.is_top_level_class(entry) & F.contains(entry, F.lit("/"))).select(
        last.alias("simple_name"),
        "jar_path",
        F.translate(F.regexp_replace(entry, r"(\.class)+$", ""), "/", ".").alias("fqn"),
    ).distinct()


def by_simple_name(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Suffix probe: ``(simple_name, jar_path, fqn)``, distinct.

    The suffix test is an equality on the last path segment, so it joins by hash
    instead of comparing every entry with every name. Classes outside any
    package never match.
    """
    return join_lookup(simple_names(entries), wanted.select("simple_name").distinct(), ["simple_name"], "left_semi")
