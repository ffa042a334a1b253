"""Every operator as a named query over the given tables.

All queries run over whole tables; a constant in a query is a parameter of the
operator it shows (a version, a group, a report size).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from classatlas.functions import names, text
from classatlas.functions.structure import class_structure, has_member
from classatlas.operators import catalog, changes, content, hotspot, lookup, name_index, registry, resolve, stats, warmup
from classatlas.plans import standin
from classatlas.plans.render import text_line, version_json
from classatlas.schemas import DECOMPILED, SOURCES_JAR
from classatlas.sources.archives import existing_entries, read_entry_names, read_source_entries, read_sources
from classatlas.sources.arrivals import artifact_changes
from classatlas.sources.store import Store
from classatlas.streaming.access import replay_requests
from classatlas.streaming.indexing import write_sources

Query = Callable[[SparkSession, str], DataFrame]


# -- scans and projections --------------------------------------------------

def catalog_classes(spark: SparkSession, d: str) -> DataFrame:
    return catalog.classes(standin.entries(spark, d))


def exact_probe(spark: SparkSession, d: str) -> DataFrame:
    requests = standin.classes(spark, d).select("fqn")
    return catalog.containing(standin.entries(spark, d), requests)


def suffix_probe(spark: SparkSession, d: str) -> DataFrame:
    wanted = standin.classes(spark, d).select("simple_name")
    return catalog.by_simple_name(standin.entries(spark, d), wanted)


def sources_jar_path(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    return standin.odd_paths(spark, d).select(
        "doc_id", names.is_artifact_path(path).alias("is_artifact"),
        names.sources_jar_path(path).alias("sources_path"),
    )


def sources_sibling(spark: SparkSession, d: str) -> DataFrame:
    jars = standin.classes(spark, d).select("jar_path").distinct()
    sources = standin.sources_entries(spark, d).where(~standin.every(F.col("jar_path"), 3)).select(
        F.regexp_replace("jar_path", r"\.jar$", names.SOURCES_SUFFIX).alias("jar_path")
    ).distinct()
    return content.with_sources_path(jars, jars.unionByName(sources))


def source_entry_paths(spark: SparkSession, d: str) -> DataFrame:
    entry = names.source_entry_of_class(text.let(
        F.concat("fqn", F.lit("$Inner$1")), lambda name: name
    ))
    class_entry = names.entry_of_class(F.col("fqn"))
    kind = F.col("doc_id") % 4
    # descriptors and compiled classes are no sources of a class
    listed = F.when(kind == 1, F.regexp_replace(entry, r"[^/]+$", "package-info.java")).when(
        kind == 2, class_entry).otherwise(entry)
    return standin.classes(spark, d).select(
        "doc_id", entry.alias("entry_name"), class_entry.alias("class_entry"),
        names.class_of_source_entry(entry).alias("class_name"),
        names.is_class_source(listed).alias("is_class_source"),
    )


def source_point_read(spark: SparkSession, d: str) -> DataFrame:
    """The entry of one class from each sibling archive, first in archive order."""
    chosen = content.first_text(
        standin.sources_entries(spark, d), ["jar_path", "entry_name"], "entry_idx", "content"
    )
    hits = resolve.with_version(standin.classes(spark, d).select("fqn", "jar_path").distinct())
    requests = hits.withColumn("entry_name", names.source_entry_of_class(F.col("fqn")))
    read = requests.join(chosen, ["jar_path", "entry_name"], "left")
    return read.select("fqn", "jar_path", "version", text.content_hash(F.col("content")).alias("content_hash"))


def bulk_sources_keep_first(spark: SparkSession, d: str) -> DataFrame:
    named = content.name_sources(standin.sources_entries(spark, d))
    return content.keep_first(named).select(
        "jar_path", "fqn", "entry_idx", text.content_hash(F.col("content")).alias("content_hash")
    )


def normalize_query(spark: SparkSession, d: str) -> DataFrame:
    name = names.normalize_query(F.col("raw"))
    return standin.raw_queries(spark, d).select(
        "doc_id", name.alias("class_name"), names.is_qualified(name).alias("is_qualified")
    )


def version_from_path(spark: SparkSession, d: str) -> DataFrame:
    return standin.odd_paths(spark, d).select("doc_id", names.version_of_path(F.col("path")).alias("version"))


def version_filter(spark: SparkSession, d: str) -> DataFrame:
    hits = standin.classes(spark, d).select("fqn", "jar_path").distinct()
    return resolve.of_version(hits, "10.0")


# -- text functions ---------------------------------------------------------

def content_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = standin.with_content(standin.classes(spark, d))
    return rows.select("doc_id", text.content_hash(F.col("content")).alias("content_hash"))


def extract_class_name(spark: SparkSession, d: str) -> DataFrame:
    return standin.named_texts(spark, d).select(
        "doc_id", text.extract_class_name(F.col("content")).alias("class_name")
    )


def split_decompiled(spark: SparkSession, d: str) -> DataFrame:
    pieces = standin.decompiler_output(spark, d).select(
        "doc_id", F.posexplode(text.split_decompiled(F.col("output"))).alias("position", "piece")
    )
    return pieces.select(
        "doc_id", F.col("position").cast("long").alias("position"),
        "piece.class_name", "piece.content_hash",
    )


def collapse_whitespace(spark: SparkSession, d: str) -> DataFrame:
    rows = standin.with_content(standin.classes(spark, d))
    return rows.select("doc_id", text.content_hash(text.collapse_space(F.col("content"))).alias("collapsed_hash"))


def decode_text(spark: SparkSession, d: str) -> DataFrame:
    """Line ends of tool output."""
    return standin.decompiler_output(spark, d).select(
        "doc_id", text.content_hash(text.unix_newlines(F.col("output"))).alias("text_hash")
    )


# -- structure --------------------------------------------------------------

def _structures(spark: SparkSession, d: str) -> DataFrame:
    return standin.java_files(spark, d).select("doc_id", class_structure(F.col("content")).alias("c"))


def class_structures(spark: SparkSession, d: str) -> DataFrame:
    return _structures(spark, d).select(
        "doc_id", "c.package", F.array_join("c.imports", ",").alias("imports"),
        "c.class_declaration", "c.class_comment",
        F.size("c.fields").cast("long").alias("n_fields"),
        F.size("c.methods").cast("long").alias("n_methods"),
        F.sha2(F.array_join("c.comments", "\n"), 256).alias("comments_hash"),
    )


def structure_members(spark: SparkSession, d: str) -> DataFrame:
    def tagged(members: str, kind: str):
        return F.transform(
            F.col(members),
            lambda m, i: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("position"), m.alias("m")),
        )

    rows = _structures(spark, d).select(
        "doc_id", F.explode(F.concat(tagged("c.fields", "field"), tagged("c.methods", "method"))).alias("r")
    )
    return rows.select("doc_id", "r.kind", "r.position", "r.m.declaration", "r.m.comment")


def member_search(spark: SparkSession, d: str) -> DataFrame:
    return _structures(spark, d).select(
        "doc_id", has_member(F.col("c.fields"), "f3 =").alias("has_field"),
        has_member(F.col("c.methods"), "C3(").alias("has_method"),
    )


# -- registry ---------------------------------------------------------------

def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return standin.classes(spark, d).select("fqn", "jar_path", F.col("doc_id").alias("seq"))


def _labelled(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    return rows.join(standin.labels(spark, d).select("doc_id"), "doc_id", "left_semi")


def registry_build(spark: SparkSession, d: str) -> DataFrame:
    return registry.build(_catalog(spark, d))


def registry_counts(spark: SparkSession, d: str) -> DataFrame:
    return registry.artifact_counts(registry.build(_catalog(spark, d)))


def _known_registry(spark: SparkSession, d: str) -> DataFrame:
    known = _labelled(spark, d, standin.classes(spark, d))
    return registry.build(known.select("fqn", "jar_path", F.col("doc_id").alias("seq")))


def registry_append_new(spark: SparkSession, d: str) -> DataFrame:
    return registry.new_pairs(_catalog(spark, d), _known_registry(spark, d))


def registry_store(spark: SparkSession, d: str) -> DataFrame:
    """The stored registry after two runs, the second one over everything."""
    store = Store(spark, standin.scratch(spark, "registry"), slots=8)
    for pairs in (_known_registry(spark, d), _catalog(spark, d)):
        with store.run() as run:
            numbered = pairs.withColumn("seq", F.lit(run).cast("long"))
            store.write("class_registry", registry.new_pairs(numbered, store.registry()))
    return store.registry()


def registry_lookup(spark: SparkSession, d: str) -> DataFrame:
    requests = standin.raw_queries(spark, d).select(names.normalize_query(F.col("raw")).alias("fqn"))
    return registry.artifacts_of(registry.build(_catalog(spark, d)), requests)


def registry_validated(spark: SparkSession, d: str) -> DataFrame:
    """Hits whose artifact still exists and still holds the class."""
    hits = registry.build(_catalog(spark, d)).select("fqn", "jar_path")
    existing = _labelled(spark, d, standin.classes(spark, d)).select("jar_path").distinct()
    return resolve.valid_hits(hits, existing, standin.entries(spark, d))


def uncataloged_artifacts(spark: SparkSession, d: str) -> DataFrame:
    jars = standin.classes(spark, d).select("jar_path").distinct()
    return registry.uncataloged(jars, _known_registry(spark, d).select("jar_path").distinct())


def index_summary(spark: SparkSession, d: str) -> DataFrame:
    jars = standin.classes(spark, d).select("jar_path").distinct()
    known = _known_registry(spark, d).select("jar_path").distinct()
    entries = standin.entries(spark, d)
    fresh = registry.uncataloged(jars, known)
    # an artifact with a manifest and no class stands for an unreadable one
    status = registry.uncataloged(entries, known).groupBy("jar_path").agg(
        F.bool_or(F.endswith("entry_name", F.lit(".class"))).alias("readable")
    )
    classes = catalog.classes(entries).join(fresh, "jar_path", "left_semi")
    return registry.index_summary(jars, status, classes)


# -- resolution -------------------------------------------------------------

def search_scopes(spark: SparkSession, d: str) -> DataFrame:
    rows = standin.classes(spark, d)
    short = rows.select("simple_name").withColumnRenamed("simple_name", "fqn")
    return resolve.search_scopes(rows.select("fqn").unionByName(short), rows.select("jar_path").distinct())


def tiered_scan(spark: SparkSession, d: str) -> DataFrame:
    return resolve.narrowest(standin.classes(spark, d).select("fqn", "jar_path").distinct())


def find_fqn_versions(spark: SparkSession, d: str) -> DataFrame:
    """All requested classes with the source of every version."""
    requests = standin.raw_queries(spark, d).select(names.normalize_query(F.col("raw")).alias("fqn"))
    known = registry.artifacts_of(registry.build(_catalog(spark, d)), requests).select("fqn", "jar_path")
    hits = resolve.with_version(known)
    texts = _texts(spark, d).select("fqn", "jar_path", "content", "source", "cache_hit")
    return hits.join(texts, ["fqn", "jar_path"]).select(
        "fqn", "version", "jar_path", text.content_hash(F.col("content")).alias("content_hash"),
        "cache_hit", "source", F.lit("registry").alias("lookup_source"),
    )


def _sources_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    return standin.sources_entries(spark, d).where(~standin.every(F.col("jar_path"), 3))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Per class and artifact the cached text, else the source, else the decompiled one."""
    latest = _latest_cache(spark, d).where(~standin.every(F.col("jar_path"), 2))
    cached = latest.select("fqn", "jar_path", "content", "source").withColumn(
        "cache_hit", F.lit(True)
    )
    loaded = content.source_wins(
        _sources_with_gaps(spark, d), standin.decompiler_pieces(spark, d)
    ).withColumn("cache_hit", F.lit(False))
    fresh = loaded.join(cached.select("fqn", "jar_path"), ["fqn", "jar_path"], "left_anti")
    return cached.unionByName(fresh)


def _known_states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The simple-name index of an earlier time and the states of archives it was made from.

    Some archives were never read, others have changed since and held another class then.
    """
    states = standin.artifact_states(spark, d).where(~standin.every(F.col("jar_path"), 4))
    changed = standin.every(F.col("jar_path"), 3)
    index = name_index.of_entries(standin.entries(spark, d), states.where(~changed))
    old = states.where(changed).select("jar_path", (F.col("mtime_ns") - 1).alias("mtime_ns"))
    gone = standin.classes(spark, d).select("simple_name", "jar_path").distinct().join(old, "jar_path").select(
        "simple_name", standin.cat("org.zz.gone.", F.col("simple_name")).alias("fqn"), "jar_path", "mtime_ns")
    return index.unionByName(gone), states.where(~changed).unionByName(old)


def find_simple_best(spark: SparkSession, d: str) -> DataFrame:
    """Every simple name resolved to its best qualified name and that name's versions.

    Answered from the index of simple names, after reading the archives that it does not
    know in their present state.
    """
    artifacts = standin.artifact_states(spark, d)
    index, read = _known_states(spark, d)
    unread = name_index.unread(artifacts, read)
    opened = standin.entries(spark, d).join(unread.select("jar_path"), "jar_path", "left_semi")
    index = index.unionByName(name_index.of_entries(opened, unread))
    wanted = standin.classes(spark, d).select("simple_name")
    return resolve.with_version(resolve.archives_of_best(name_index.matches(index, wanted, artifacts)))


def find_batch(spark: SparkSession, d: str) -> DataFrame:
    """All pasted names at once, some with a version, misses included, through a store.

    The registry knows labelled documents only; archives of some versions are gone, and not
    all hold what the registry says. What is not found there is searched in tiers, simple
    names go by the index; texts come from the cache, the sources or the decompiler.
    """
    store = Store(spark, standin.scratch(spark, "find"), slots=8)
    with store.run() as run:
        store.write("class_registry", _known_registry(spark, d).withColumn("seq", F.lit(run).cast("long")))
        cached = standin.cache_writes(spark, d).where(~standin.every(F.col("jar_path"), 2))
        store.write("class_sources", content.keep_last(cached))
        states = standin.artifact_states(spark, d)
        store.write("simple_names", name_index.of_entries(standin.entries(spark, d), states))
    alive = ~standin.every(F.col("jar_path"), 5)
    artifacts, entries = states.where(alive), standin.entries(spark, d).where(alive)
    raw = standin.raw_queries(spark, d).select("raw", F.when(
        F.col("doc_id") % 5 == 0, standin.cat((F.col("doc_id") % 12).cast("string"), ".0")).alias("wanted"))
    wanted = lookup.normalized(raw).checkpoint()
    qualified, simple = lookup.qualified(wanted), lookup.simple(wanted)

    registry_rows = store.of_names("class_registry", qualified.select(F.col("name").alias("fqn")))
    known = lookup.registered(qualified, registry_rows)
    held = known.join(resolve.valid_hits(known.select("fqn", "jar_path").distinct(), artifacts, entries), ["fqn", "jar_path"], "left_semi").checkpoint()
    missed = lookup.unanswered(qualified, held)
    holding = catalog.containing(entries, missed.select(F.col("name").alias("fqn")))
    index = store.simple_names(simple.select(F.col("name").alias("simple_name")))
    named = lookup.of_best_name(simple, name_index.matches(index, simple.select(F.col("name").alias("simple_name")), artifacts))
    hits = held.withColumn("lookup_source", F.lit(lookup.REGISTRY)).unionByName(
        lookup.in_narrowest_tier(missed, holding).unionByName(named).withColumn("lookup_source", F.lit(lookup.SCAN))).checkpoint()

    pairs = hits.select("fqn", "jar_path").distinct()
    texts = lookup.preferred_text(
        store.sources(pairs.select("fqn")), _sources_with_gaps(spark, d), standin.decompiler_pieces(spark, d))
    found = lookup.answers(hits, texts).drop("content").withColumn("version_key", F.coalesce("wanted", F.lit("")))
    placed = resolve.positions(found, "name", "version_key").drop("wanted")
    outcome = lookup.outcome(wanted, hits).withColumn("version_key", F.coalesce("wanted", F.lit("")))
    return outcome.join(placed, ["name", "version_key"], "left").drop("version_key")


def archive_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Classes read from real archives."""
    archives = standin.archives(spark, d)
    classes = catalog.classes(read_entry_names(archives.select("jar_path"), suffix=names.CLASS_SUFFIX))
    return archives.select("doc_id", "jar_path").join(classes, "jar_path").select("doc_id", "fqn")


def archive_probe(spark: SparkSession, d: str) -> DataFrame:
    """Which real archives hold the class file of their class."""
    archives = standin.archives(spark, d).withColumn("entry_name", names.entry_of_class(F.col("fqn")))
    held = existing_entries(archives.select("jar_path", "entry_name"))
    return archives.join(held, ["jar_path", "entry_name"], "left_semi").select("doc_id", "fqn")


def archive_sources(spark: SparkSession, d: str) -> DataFrame:
    """Texts of real sources archives, once read whole and once by entry; invalid bytes are replaced."""
    archives = standin.archives(spark, d)
    read = content.name_sources(read_sources(archives)).checkpoint()
    whole = content.keep_first(content.readable(read)).select(
        "jar_path", "fqn", text.content_hash(F.col("content")).alias("content_hash"))
    requests = archives.withColumn("entry_name", names.source_entry_of_class(F.col("fqn")))
    single = read_source_entries(requests).select("jar_path", text.content_hash(F.col("content")).alias("entry_hash"))
    return archives.select("doc_id", "jar_path").join(whole, "jar_path").join(single, "jar_path").select(
        "doc_id", "fqn", "content_hash", "entry_hash")


def artifact_changes_stream(spark: SparkSession, d: str) -> DataFrame:
    """How often a stream that stops and goes on reports real archives; binary ones of one language change between."""
    base, root = standin.scratch(spark, "changes"), standin.archive_folder(spark)
    archives = standin.archives(spark, d, root)

    def follow() -> None:
        reports = artifact_changes(spark, root, settle_seconds=0.05).writeStream.format("parquet")
        reports.option("path", f"{base}/reports").option("checkpointLocation", f"{base}/offsets").trigger(
            availableNow=True).start().awaitTermination()

    follow()
    standin.touch(archives.where(F.startswith("fqn", F.lit("org.fr."))))
    follow()
    seen = spark.read.schema("jar_path string").parquet(f"{base}/reports").groupBy("jar_path").agg(F.count("*").alias("n"))
    return (
        archives.join(seen.withColumnRenamed("n", "binary_reports"), "jar_path", "left")
        .join(seen.select(F.col("jar_path").alias("sources_path"), F.col("n").alias("sources_reports")), "sources_path", "left")
        .select("doc_id", "fqn", "binary_reports", "sources_reports")
    )


def ambiguity(spark: SparkSession, d: str) -> DataFrame:
    wanted = standin.classes(spark, d).select("simple_name")
    return resolve.best_qualified_name(catalog.by_simple_name(standin.entries(spark, d), wanted))


def default_version(spark: SparkSession, d: str) -> DataFrame:
    hits = standin.classes(spark, d).select("fqn", "jar_path").distinct()
    return resolve.default_version(resolve.with_version(hits))


# -- content ----------------------------------------------------------------

def _latest_cache(spark: SparkSession, d: str) -> DataFrame:
    return content.keep_last(standin.cache_writes(spark, d))


def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The cache after all writes: the last one per key."""
    return _latest_cache(spark, d).select(
        names.source_key(F.col("fqn"), F.col("jar_path")).alias("cache_key"), "source",
        text.content_hash(F.col("content")).alias("content_hash"),
    )


def cache_upsert_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same cache, filled by a stream of documents."""
    base = standin.scratch(spark, "cache")
    store = Store(spark, f"{base}/store", slots=8)
    rows = standin.classes_of(standin.stream(spark, d, "documents"))
    writes = standin.cache_writes_of(rows)
    write_sources(writes, store, "documents", f"{base}/offsets").awaitTermination()
    return store.sources().select(
        names.source_key(F.col("fqn"), F.col("jar_path")).alias("cache_key"), "source",
        text.content_hash(F.col("content")).alias("content_hash"),
    )


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    hits = standin.classes(spark, d).select("fqn", "jar_path").distinct()
    # as many artifacts again that were never cached
    unknown = hits.select("fqn", standin.cat(F.col("jar_path"), ".old").alias("jar_path"))
    return content.from_cache(hits.unionByName(unknown), _latest_cache(spark, d)).select(
        "fqn", "jar_path", "cache_hit", "source", text.content_hash(F.col("content")).alias("content_hash")
    )


def missing_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = standin.classes(spark, d)
    covered = _labelled(spark, d, rows).select("jar_path", "fqn").distinct()
    return content.needs_decompiling(rows.select("jar_path").distinct(), rows, covered)


def load_union(spark: SparkSession, d: str) -> DataFrame:
    loaded = content.source_wins(_sources_with_gaps(spark, d), standin.decompiler_pieces(spark, d))
    return loaded.select("jar_path", "fqn", "source", text.content_hash(F.col("content")).alias("content_hash"))


def load_skip_flag(spark: SparkSession, d: str) -> DataFrame:
    rows = standin.classes(spark, d)
    loaded = _labelled(spark, d, rows).select("jar_path").distinct()
    return content.skip_loaded(rows.select("jar_path").distinct(), loaded)


def load_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a run: skipped, failed (no text at all) and loaded artifacts."""
    flagged = load_skip_flag(spark, d)
    # the tool fails for some artifacts
    pieces = standin.decompiler_pieces(spark, d).where(~standin.every(F.col("jar_path"), 4))
    counts = pieces.select("jar_path", "fqn").distinct().groupBy("jar_path").agg(
        F.count("*").alias("n")
    )
    loads = flagged.join(counts, "jar_path", "left").select(
        "jar_path", "skipped",
        F.when(F.col("skipped"), F.lit(0).cast("long")).otherwise(F.coalesce("n", F.lit(0).cast("long")))
        .alias("classes_loaded"),
        F.isnull("n").alias("failed"),
    )
    return warmup.run_summary(loads)


# -- hotspots, changes, warm-up ---------------------------------------------

def hotspot_state(spark: SparkSession, d: str) -> DataFrame:
    return hotspot.state(standin.access_log(spark, d))


def hotspot_requests(spark: SparkSession, d: str) -> DataFrame:
    wanted = hotspot.requests(standin.access_log(spark, d))
    return wanted.select("jar_path", F.col("order.event_id").alias("event_id"), "priority", "mode")


def hotspot_requests_late(spark: SparkSession, d: str) -> DataFrame:
    wanted = hotspot.requests(standin.access_log(spark, d), threshold=5)
    return wanted.select("jar_path", F.col("order.event_id").alias("event_id"), "priority", "mode")


def hotspot_requests_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same requests from Structured Streaming with state kept between batches."""
    return replay_requests(spark, d)


def hotspot_top10(spark: SparkSession, d: str) -> DataFrame:
    return hotspot.top_accessed(hotspot.state(standin.access_log(spark, d))).drop("class_count")


def hotspot_top_unwarmed(spark: SparkSession, d: str) -> DataFrame:
    return hotspot.top_unwarmed(hotspot.state(standin.access_log(spark, d)), 20).select(
        "jar_path", "access_count", "last_access"
    )


def store_stats(spark: SparkSession, d: str) -> DataFrame:
    jars = standin.classes(spark, d).select("jar_path").distinct()
    return stats.table_counts(
        standin.cache_writes(spark, d), registry.build(_catalog(spark, d)), jars,
        _known_registry(spark, d).select("jar_path").distinct(), hotspot.state(standin.access_log(spark, d)),
    )


def mtime_changes(spark: SparkSession, d: str) -> DataFrame:
    return changes.changed(*standin.mtimes(spark, d))


def mtime_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return changes.moved_snapshot(*standin.mtimes(spark, d))


def warmup_queue_order(spark: SparkSession, d: str) -> DataFrame:
    return warmup.queue_order(standin.warmup_tasks(spark, d))


def warmup_targets_group(spark: SparkSession, d: str) -> DataFrame:
    return warmup.group_targets(standin.classes(spark, d).select("jar_path").distinct(), "org.en")


def warmup_targets_limit(spark: SparkSession, d: str) -> DataFrame:
    return warmup.group_targets(standin.classes(spark, d).select("jar_path").distinct(), "org.de", limit=15)


def warmup_exclusions(spark: SparkSession, d: str) -> DataFrame:
    entries = standin.entries(spark, d)
    found = entries.where(F.endswith("entry_name", F.lit(".class"))).select(
        "jar_path", names.class_of_entry(F.col("entry_name")).alias("fqn")
    ).distinct()
    toxic = standin.labels(spark, d).where("toxic = 1").select("doc_id")
    excluded = standin.classes(spark, d).join(toxic, "doc_id", "left_semi").select("fqn")
    return content.without_excluded(found, excluded, top_level_only=True)


# -- output shapes ----------------------------------------------------------

def _found(spark: SparkSession, d: str) -> DataFrame:
    return find_fqn_versions(spark, d)


def find_json(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("fqn", version_json().alias("json"))


def find_text(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("fqn", text_line().alias("line"))


def structure_sources(spark: SparkSession, d: str) -> DataFrame:
    """Text a contract is taken from: the sources archive, else what was found."""
    rows = _texts(spark, d).select("fqn", "jar_path", "content", "source")
    original = content.keep_first(_sources_with_gaps(spark, d)).select(
        "fqn", "jar_path", F.col("content").alias("original")
    )
    return rows.join(original, ["fqn", "jar_path"], "left").select(
        "fqn", "jar_path",
        F.when(F.col("original").isNotNull(), F.lit(SOURCES_JAR))
        .when(F.col("source").isNotNull(), F.col("source"))
        .otherwise(F.lit(DECOMPILED)).alias("structure_source"),
        text.content_hash(F.coalesce("original", "content")).alias("content_hash"),
    )


def queries() -> dict[str, Query]:
    shown = [
        catalog_classes, exact_probe, suffix_probe, sources_jar_path, sources_sibling,
        source_entry_paths, source_point_read, bulk_sources_keep_first, normalize_query,
        version_from_path, version_filter, content_hash, extract_class_name, split_decompiled,
        collapse_whitespace, decode_text, class_structures, structure_members, member_search,
        registry_build, registry_counts, registry_append_new, registry_store, registry_lookup, registry_validated,
        uncataloged_artifacts, index_summary, search_scopes, tiered_scan, find_fqn_versions,
        find_batch, archive_catalog, archive_probe, archive_sources, artifact_changes_stream, find_simple_best, ambiguity, default_version, cache_upsert, cache_upsert_stream, cache_lookup, missing_sources,
        load_union, load_skip_flag, load_summary, hotspot_state, hotspot_requests,
        hotspot_requests_late, hotspot_requests_stream, hotspot_top10, hotspot_top_unwarmed,
        store_stats, mtime_changes, mtime_snapshot, warmup_queue_order, warmup_targets_group,
        warmup_targets_limit, warmup_exclusions, find_json, find_text, structure_sources,
    ]
    return {query.__name__: query for query in shown}
