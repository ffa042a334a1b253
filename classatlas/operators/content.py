"""Source texts of classes: cache, sources archives, decompiler output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classatlas.functions import names, text
from classatlas.operators.skew import join_lookup
from classatlas.schemas import DECOMPILED, SOURCES_JAR
from classatlas.session import ensure_checkpoint_dir

#: Keys of several texts up to which they are broadcast; more are joined by an exchange.
FEW_KEYS = 50_000


def with_sources_path(artifacts: DataFrame, existing: DataFrame) -> DataFrame:
    """Add ``sources_path``, NULL unless the sibling archive exists."""
    siblings = existing.select(F.col("jar_path").alias("sources_path"))
    wanted = artifacts.withColumn("wanted", names.sources_jar_path(F.col("jar_path")))
    return wanted.join(siblings, F.col("wanted") == F.col("sources_path"), "left").drop("wanted")


def name_sources(texts: DataFrame) -> DataFrame:
    """``(jar_path, entry_idx, fqn, content)`` of source entries, with their ``error`` if they have one."""
    return texts.select(
        "jar_path",
        "entry_idx",
        text.class_of_source(F.col("content"), F.col("entry_name")).alias("fqn"),
        "content",
        *(c for c in texts.columns if c == "error"),
    )


def readable(read: DataFrame) -> DataFrame:
    """Rows of archives all of whose entries could be read; a damaged archive counts as absent as a whole."""
    damaged = read.where("error is not null").select("jar_path").distinct()
    return read.where("error is null").drop("error").join(damaged, "jar_path", "left_anti")


def first_text(rows: DataFrame, keys: list[str], order: str, *kept: str) -> DataFrame:
    """The row of the smallest ``order`` per key, reduced to keys, ``order`` and ``kept``; one row per key.

    Of rows of equal ``order`` the one with the smallest hash of ``kept`` is taken, and one
    of equal rows. Ranking looks at keys, ``order`` and that hash only, and keeps the keys
    that occur more than once; texts are neither sorted nor aggregated. Those keys are written
    and counted here, while the plan is built: up to ``FEW_KEYS`` are broadcast and no text
    moves, only more of them are joined by an exchange. Only keys whose first row comes several
    times are reduced by an exchange of these rows; without any, there is no such part.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    mark = F.xxhash64(*kept)
    counted = rows.groupBy(*keys, F.col(order).alias("_order"), mark.alias("_mark")).agg(F.count("*").alias("_copies"))
    repeated = counted.groupBy(*keys).agg(
        F.min(F.struct("_order", "_mark", "_copies")).alias("first"), F.sum("_copies").alias("n")).where("n > 1").checkpoint()
    found = repeated.agg(F.count("*").alias("keys"), F.count_if(F.col("first._copies") > 1).alias("copied")).first()
    if not found["keys"]:
        return rows.select(*keys, order, *kept)

    def held(lookup: DataFrame, size: int) -> DataFrame:
        return (F.broadcast(lookup) if size <= FEW_KEYS else lookup).alias("f")

    same_key = reduce(
        lambda a, b: a & b, (F.col(f"r.{key}").eqNullSafe(F.col(f"f.{key}")) for key in keys)
    )
    columns = [F.col(f"r.{name}").alias(name) for name in (*keys, order, *kept)]
    is_first = F.col(f"r.{order}").eqNullSafe(F.col("f.first._order")) & (
        F.xxhash64(*(F.col(f"r.{name}") for name in kept)) == F.col("f.first._mark"))
    ranked = rows.alias("r").join(held(repeated, found["keys"]), same_key, "left")
    single = ranked.where(F.isnull("f.first") | (is_first & (F.col("f.first._copies") == 1))).select(*columns)
    if not found["copied"]:
        return single
    copies = rows.alias("r").join(held(repeated.where("first._copies > 1"), found["copied"]), same_key).where(is_first)
    return single.unionByName(copies.select(*columns).dropDuplicates(keys))


def keep_first(named: DataFrame) -> DataFrame:
    """First entry per ``(jar_path, fqn)`` in archive order."""
    return first_text(named, ["jar_path", "fqn"], "entry_idx", "content")


def keep_last(writes: DataFrame) -> DataFrame:
    """Upsert of ``(fqn, jar_path, content, source, seq)``: the last write per key wins."""
    latest = writes.withColumn("age", -F.col("seq"))
    return first_text(latest, ["fqn", "jar_path"], "age", "content", "source").drop("age")


def parse_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces of decompiler output to ``(jar_path, entry_idx, fqn, content)`` rows; a piece has one class or none."""
    return pieces.where("piece is not null").select(
        "jar_path", "entry_idx", F.explode(text.split_decompiled(F.col("piece"))).alias("found")
    ).select("jar_path", "entry_idx", F.col("found.class_name").alias("fqn"), F.col("found.content").alias("content"))


def needs_decompiling(artifacts: DataFrame, catalog: DataFrame, covered: DataFrame) -> DataFrame:
    """Artifacts with no covered class at all or with a cataloged class uncovered.

    ``(jar_path, missing)``; ``missing`` counts distinct uncovered classes.
    """
    per_jar = covered.groupBy("jar_path").agg(F.count("*").alias("covered"))
    gaps = (
        catalog.select("jar_path", "fqn")
        .distinct()
        .join(covered, ["jar_path", "fqn"], "left_anti")
        .groupBy("jar_path")
        .agg(F.count("*").alias("missing"))
    )
    return (
        artifacts.select("jar_path")
        .join(per_jar, "jar_path", "left")
        .join(gaps, "jar_path", "left")
        .where("covered is null or missing is not null")
        .select("jar_path", F.coalesce("missing", F.lit(0).cast("long")).alias("missing"))
    )


def source_wins(from_sources: DataFrame, decompiled: DataFrame) -> DataFrame:
    """Sources united with decompiled classes the sources do not cover.

    ``(jar_path, fqn, content, source)``, each class once. Both kinds are ranked
    and reduced together, which saves an anti-join over the texts.
    """
    def ranked(rows: DataFrame, rank: int, source: str) -> DataFrame:
        return rows.select(
            "jar_path", "fqn", "content", F.lit(source).alias("source"),
            F.struct(F.lit(rank).alias("rank"), "entry_idx").alias("preference"),
        )

    both = ranked(from_sources, 0, SOURCES_JAR).unionByName(ranked(decompiled, 1, DECOMPILED))
    return first_text(both, ["jar_path", "fqn"], "preference", "content", "source").drop("preference")


def skip_loaded(targets: DataFrame, loaded: DataFrame) -> DataFrame:
    """Targets with a ``skipped`` flag for those loaded before."""
    marks = loaded.select("jar_path", F.lit(True).alias("mark"))
    return targets.join(marks, "jar_path", "left").select(
        *targets.columns, F.coalesce("mark", F.lit(False)).alias("skipped")
    )


def from_cache(hits: DataFrame, cache: DataFrame) -> DataFrame:
    """Left join of hits with cached texts on class and artifact."""
    cached = cache.select("fqn", "jar_path", "content", "source")
    return hits.join(cached, ["fqn", "jar_path"], "left").withColumn(
        "cache_hit", F.col("content").isNotNull()
    )


def without_excluded(classes: DataFrame, excluded: DataFrame, top_level_only: bool) -> DataFrame:
    """Warm-up exclusions: listed classes, descriptors, and inner classes if asked."""
    fqn = F.col("fqn")
    kept = join_lookup(classes, excluded.select("fqn").distinct(), ["fqn"], "left_anti")
    for special in names.SPECIAL_CLASSES:
        kept = kept.where(~F.endswith(fqn, F.lit(special)))
    return kept.where(~F.contains(fqn, F.lit("$"))) if top_level_only else kept
