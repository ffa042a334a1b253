"""Many lookups at once: requested names to artifacts, versions and texts.

A request is a name as a user pastes it and perhaps a version. All steps are joins on
the names, so one request and a million take the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classatlas.functions import names, text
from classatlas.operators import content, resolve
from classatlas.operators.skew import join_lookup
from classatlas.schemas import DECOMPILED, SOURCES_JAR

#: Where a hit comes from, best first.
REGISTRY, SCAN = "registry", "scan"
REQUEST = ["name", "wanted"]


def normalized(requests: DataFrame) -> DataFrame:
    """Distinct ``(name, wanted)`` of ``(raw, wanted)``; ``wanted`` is a version or NULL, blank names are dropped."""
    return requests.select(names.normalize_query(F.col("raw")).alias("name"), "wanted").where("name <> ''").distinct()


def qualified(requests: DataFrame) -> DataFrame:
    return requests.where(names.is_qualified(F.col("name")))


def simple(requests: DataFrame) -> DataFrame:
    return requests.where(~names.is_qualified(F.col("name")))


def of_wanted_version(hits: DataFrame) -> DataFrame:
    """Hits of the version their request asks for, compared as text; all if it asks for none."""
    return hits.where(F.isnull("wanted") | names.version_of_path(F.col("jar_path")).eqNullSafe(F.col("wanted")))


def registered(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """``(name, wanted, fqn, jar_path)``: artifacts the registry names for qualified requests, of their versions."""
    known = registry.select(F.col("fqn").alias("name"), "jar_path")
    return of_wanted_version(known.join(requests, "name")).select(*REQUEST, F.col("name").alias("fqn"), "jar_path")


def unanswered(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """Requests without any hit."""
    r, h = requests.alias("r"), hits.select(*REQUEST).distinct().alias("h")
    same = (F.col("r.name") == F.col("h.name")) & F.col("r.wanted").eqNullSafe(F.col("h.wanted"))
    return r.join(h, same, "left_anti")


def in_narrowest_tier(requests: DataFrame, holding: DataFrame, root: str = "") -> DataFrame:
    """``(name, wanted, fqn, jar_path)``: hits of the first tier with any match, then of the wanted version.

    ``holding`` has ``(fqn, jar_path)`` of all archives that hold the class; paths lie below ``root``.
    """
    inside = F.substring("jar_path", F.lit(len(root) + 2), F.length("jar_path")) if root else F.col("jar_path")
    relative = holding.select("fqn", inside.alias("jar_path"))
    back = F.concat(F.lit(f"{root}/"), F.col("jar_path")) if root else F.col("jar_path")
    best = resolve.narrowest(relative).select("fqn", back.alias("jar_path"))
    found = best.join(requests.withColumnRenamed("name", "fqn"), "fqn").select(F.col("fqn").alias("name"), "wanted", "fqn", "jar_path")
    return of_wanted_version(found)


def of_best_name(requests: DataFrame, matches: DataFrame) -> DataFrame:
    """``(name, wanted, fqn, jar_path)``: archives of the qualified name that wins for a simple one, of the wanted version."""
    best = resolve.archives_of_best(matches).select(F.col("simple_name").alias("name"), "fqn", "jar_path")
    return of_wanted_version(best.join(requests, "name")).select(*REQUEST, "fqn", "jar_path")


def preferred_text(cached: DataFrame, original: DataFrame, decompiled: DataFrame) -> DataFrame:
    """``(fqn, jar_path, content, source, cache_hit)``: the cached text, else the source, else the decompiled one.

    ``cached`` has ``(fqn, jar_path, content, source)``, the others ``(fqn, jar_path, content)`` and
    perhaps ``entry_idx``; the first of several entries counts. All are ranked together, on keys only.
    """
    def ranked(rows: DataFrame, rank: int, source: Column) -> DataFrame:
        entry = F.col("entry_idx").cast("long") if "entry_idx" in rows.columns else F.lit(0).cast("long")
        return rows.select("fqn", "jar_path", "content", source.alias("source"), F.struct(
            F.lit(rank).alias("rank"), entry.alias("entry")).alias("preference"))

    rows = ranked(cached, 0, F.col("source")).unionByName(ranked(original, 1, F.lit(SOURCES_JAR))).unionByName(
        ranked(decompiled, 2, F.lit(DECOMPILED)))
    return content.first_text(rows, ["fqn", "jar_path"], "preference", "content", "source").select(
        "fqn", "jar_path", "content", "source", (F.col("preference.rank") == 0).alias("cache_hit"))


def answers(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """``(name, wanted, fqn, version, jar_path, content_hash, content, cache_hit, source, lookup_source)`` per hit."""
    joined = resolve.with_version(hits).join(texts, ["fqn", "jar_path"], "left")
    return joined.withColumn("content_hash", text.content_hash(F.col("content"))).select(
        *REQUEST, "fqn", "version", "jar_path", "content_hash", "content",
        F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"), "source", "lookup_source")


def outcome(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """``(name, wanted, versions)`` of every request; 0 versions is a miss."""
    counted = hits.groupBy(*REQUEST).agg(F.count("*").alias("versions"))
    return counted.unionByName(unanswered(requests, hits).select(*REQUEST, F.lit(0).cast("long").alias("versions")))
