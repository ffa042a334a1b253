"""From requested names to artifacts: validation, tiers, ambiguity, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classatlas.functions import names
from classatlas.operators import catalog
from classatlas.operators.skew import join_lookup
from classatlas.session import ensure_checkpoint_dir


def valid_hits(hits: DataFrame, artifacts: DataFrame, entries: DataFrame) -> DataFrame:
    """Drop registry hits whose archive is gone or no longer holds the class."""
    present = hits.join(artifacts.select("jar_path"), "jar_path", "left_semi")
    holding = catalog.containing(entries, present)
    return present.join(holding, ["fqn", "jar_path"], "left_semi")


def of_version(hits: DataFrame, version: str | None) -> DataFrame:
    """Keep one version, compared as text; ``None`` keeps all."""
    if version is None:
        return hits
    return hits.where(names.version_of_path(F.col("jar_path")) == version)


def search_scopes(fqns: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``(fqn, tier, scope)``: existing package directories, tier 0 the narrowest.

    ``jar_path`` is relative to the repository root. A name without any existing
    directory gets the root, written as an empty scope.
    """
    directories = (
        artifacts.select(F.explode(names.parent_directories(F.col("jar_path"))).alias("scope")).distinct()
    )
    candidates = fqns.select("fqn").distinct().select(
        "fqn", F.posexplode(names.search_prefixes(F.col("fqn"))).alias("position", "scope")
    )
    existing = join_lookup(candidates, directories, ["scope"], "left_semi")
    # at most one row per segment of the name, so the window stays tiny
    ranked = existing.select(
        "fqn",
        (F.row_number().over(Window.partitionBy("fqn").orderBy("position")) - 1).cast("long").alias("tier"),
        "scope",
    )
    unscoped = fqns.select("fqn").distinct().join(ranked.select("fqn"), "fqn", "left_anti")
    return ranked.unionByName(unscoped.select("fqn", F.lit(0).cast("long").alias("tier"), F.lit("").alias("scope")))


def tier_of(fqn: Column, jar_path: Column) -> Column:
    """Position of the narrowest package directory that holds the artifact.

    Artifacts outside every package directory get the position after the last
    one, which is the root.
    """
    prefixes = names.search_prefixes(fqn)
    holding = F.filter(
        F.transform(
            prefixes,
            lambda p, i: F.when(F.startswith(jar_path, F.concat(p, F.lit("/"))), i),
        ),
        lambda i: i.isNotNull(),
    )
    return F.coalesce(F.get(holding, F.lit(0)), F.size(prefixes)).cast("long")


def narrowest(holding: DataFrame) -> DataFrame:
    """Tiered search: per class, the artifacts of the narrowest tier with a match.

    A tier contains all narrower ones, so the tier of an artifact is a property
    of its path and no directory is searched twice. The best tier is a
    pre-combined minimum; it joins back instead of a window per class, so that a
    class found in very many artifacts spreads over tasks.
    """
    tiered = holding.withColumn("tier", tier_of(F.col("fqn"), F.col("jar_path")))
    best = tiered.groupBy("fqn").agg(F.min("tier").alias("tier"))
    return join_lookup(tiered, best, ["fqn", "tier"], "left_semi").select("fqn", "jar_path", "tier")


def best_qualified_name(matches: DataFrame) -> DataFrame:
    """Resolve simple names: ``(simple_name, fqn, artifacts)``.

    Per archive the smallest qualified name counts; the name found in most
    archives wins, ties go to the largest name.
    """
    per_archive = matches.groupBy("simple_name", "jar_path").agg(F.min("fqn").alias("fqn"))
    counted = per_archive.groupBy("simple_name", "fqn").agg(F.count("*").alias("artifacts"))
    return counted.groupBy("simple_name").agg(
        F.max(F.struct("artifacts", "fqn")).alias("best")
    ).select("simple_name", "best.fqn", "best.artifacts")


def archives_of_best(matches: DataFrame) -> DataFrame:
    """``(simple_name, fqn, jar_path)`` of the winning name."""
    per_archive = matches.groupBy("simple_name", "jar_path").agg(F.min("fqn").alias("fqn"))
    best = best_qualified_name(matches)
    return join_lookup(
        per_archive, best.select("simple_name", "fqn"), ["simple_name", "fqn"], "left_semi"
    ).select("simple_name", "fqn", "jar_path")


def with_version(hits: DataFrame) -> DataFrame:
    return hits.withColumn("version", names.version_of_path(F.col("jar_path")))


def version_order() -> list[Column]:
    """Versions compare as text, missing ones first; the path breaks ties."""
    return [F.col("version").asc_nulls_first(), F.col("jar_path").asc()]


def positions(hits: DataFrame, *keys: str) -> DataFrame:
    """Adds ``position``, the place of a hit among those of its keys in version order, from 1.

    ``hits`` have ``version``, ``jar_path`` and keys that are not NULL. They are dealt out by
    range and written, so that one key with very many hits spreads over tasks; the sizes of
    the ranges, one row per task, and the first place of every key give the rest.
    """
    ensure_checkpoint_dir(hits.sparkSession)
    order = [F.col(k).asc() for k in keys] + version_order()
    placed = hits.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_at", F.monotonically_increasing_id()).checkpoint().withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = placed.join(F.broadcast(sizes), "_part").withColumn(
        "_place", F.col("_before") + F.col("_at") - F.shiftleft("_part", 33)).drop("_at", "_part", "_before")
    first = numbered.groupBy(*keys).agg(F.min("_place").alias("_first"))
    return join_lookup(numbered, first, list(keys)).withColumn("position", F.col("_place") - F.col("_first") + 1).drop("_place", "_first")


def default_version(hits: DataFrame) -> DataFrame:
    """Per class the artifact of the last known version, else the first one.

    The order key is a struct whose first field marks a known version; with none
    known the smallest path is wanted, which is a second aggregate.
    """
    known = F.col("version").isNotNull()
    return hits.groupBy("fqn").agg(
        F.max(F.when(known, F.struct("version", "jar_path"))).alias("last"),
        F.min("jar_path").alias("first"),
    ).select(
        "fqn",
        F.col("last.version").alias("version"),
        F.coalesce("last.jar_path", "first").alias("jar_path"),
    )
