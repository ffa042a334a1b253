"""The verbs: find, index, load, warm up, statistics, clear, incremental update.

Every verb composes operators into Spark jobs over the repository and the store.
The driver chooses plans and passes names around; rows stay distributed.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from classatlas.functions import names, text
from classatlas.functions.structure import class_structure
from classatlas.operators import catalog, changes, content, hotspot, lookup, name_index, registry, resolve, stats, warmup
from classatlas.schemas import SOURCES_JAR
from classatlas.session import ensure_checkpoint_dir
from classatlas.sources.archives import existing_entries, read_entry_names, read_source_entries, read_sources
from classatlas.sources.arrivals import artifact_changes
from classatlas.sources.artifacts import default_repository, list_artifacts
from classatlas.sources.decompile import Decompiler, decompile, decompile_archives
from classatlas.sources.store import Store, StoreLocked
from classatlas.streaming.tags import BatchTags


class ClassNotFound(LookupError):
    """No artifact holds the requested class."""


class DecompileError(RuntimeError):
    """The external decompiler failed for a requested class."""


@dataclass
class Found:
    """Result of one lookup; ``versions`` is a lazy DataFrame, one row per artifact."""

    class_name: str
    scanned_root: str
    versions: DataFrame


class Atlas:
    """Class search over one repository, backed by one store."""

    def __init__(
        self,
        spark: SparkSession,
        store_path: str,
        repository: str | None = None,
        decompiler: Decompiler | None = None,
    ):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.repository = (repository or default_repository()).rstrip("/")
        self.store = Store(spark, store_path)
        self.decompiler = decompiler

    # -- find ---------------------------------------------------------------

    def normalize(self, raw: str) -> str:
        row = self.spark.range(1).select(names.normalize_query(F.lit(raw)).alias("name")).first()
        return row["name"]

    def scopes(self, fqn: str) -> list[str]:
        """Existing package directories, narrowest first, else the root."""
        parts = fqn.split(".")
        deepest = len(parts) - 1 if len(parts) >= 3 else 0
        candidates = [os.path.join(self.repository, *parts[:n]) for n in range(deepest, 1, -1)]
        return [path for path in candidates if os.path.exists(path)] or [self.repository]

    def _still_held(self, hits: DataFrame) -> DataFrame:
        """Registry hits whose archive exists and still holds the class."""
        entry = names.entry_of_class(F.col("fqn"))
        held = existing_entries(hits.select("jar_path", entry.alias("entry_name")))
        return hits.withColumn("entry_name", entry).join(held, ["jar_path", "entry_name"], "left_semi").drop("entry_name")

    def _in_tiers(self, requests: DataFrame) -> DataFrame:
        """Hits of the narrowest package directory with any match; the root comes last.

        Every round lists the next wider directory of the names that are still open. A
        wider one contains the narrower ones, whose archives are not opened again: what
        they hold of any open name is known by then.
        """
        open_names = requests.select(F.col("name").alias("fqn")).distinct()
        opened, holding = None, None
        tier = 0
        while True:
            prefixes = names.search_prefixes(F.col("fqn"))
            directories = open_names.where(F.size(prefixes) >= tier).select(
                F.concat_ws("/", F.lit(self.repository), F.get(prefixes, F.lit(tier))).alias("path"))
            artifacts = list_artifacts(self.spark, directories).select("jar_path")
            fresh = artifacts if opened is None else artifacts.join(opened, "jar_path", "left_anti")
            found = self._holding_any(fresh, open_names).checkpoint()
            holding = found if holding is None else holding.unionByName(found)
            opened = artifacts if opened is None else opened.unionByName(fresh)
            # a match counts once the directory searched for its own name contains it
            inside = F.substring("jar_path", F.lit(len(self.repository) + 2), F.length("jar_path"))
            reached = holding.where(resolve.tier_of(F.col("fqn"), inside) <= tier).select("fqn").distinct()
            open_names = open_names.where(F.size(prefixes) > tier).join(reached, "fqn", "left_anti").checkpoint()
            if open_names.isEmpty():
                return lookup.in_narrowest_tier(requests, holding, self.repository)
            tier += 1

    def _holding_any(self, artifacts: DataFrame, fqns: DataFrame) -> DataFrame:
        """``(fqn, jar_path)``: which artifacts hold which of the classes."""
        one = fqns.limit(2).collect()
        entry = one[0]["fqn"].replace(".", "/") + names.CLASS_SUFFIX if len(one) == 1 else None
        # of one name the reader hands on the matches only
        entries = read_entry_names(artifacts, exact=entry, suffix=names.CLASS_SUFFIX)
        return catalog.containing(entries.where("entry_idx >= 0"), fqns)

    def _read_names(self, artifacts: DataFrame) -> DataFrame | None:
        """Open archives whose present state is not in the index of simple names; their rows, stored as well.

        A store that stays locked is not written, the rows serve this lookup all the same.
        """
        unread = name_index.unread(artifacts, self.store.name_archives()).checkpoint()
        if unread.isEmpty():
            return None
        entries = read_entry_names(unread, suffix=names.CLASS_SUFFIX).where("entry_idx >= 0")
        fresh = name_index.of_entries(entries, unread).checkpoint()
        try:
            with self.store.run():
                self._store_names(fresh, unread)
        except StoreLocked:
            pass
        return fresh

    def _store_names(self, rows: DataFrame, states: DataFrame) -> None:
        self.store.write("simple_names", rows)
        self.store.write("name_archives", states)

    def _by_simple_name(self, requests: DataFrame) -> DataFrame:
        artifacts = list_artifacts(self.spark, self.repository)
        fresh = self._read_names(artifacts)
        wanted = requests.select(F.col("name").alias("simple_name"))
        index = self.store.simple_names(wanted)
        index = index if fresh is None else index.unionByName(fresh)
        return lookup.of_best_name(requests, name_index.matches(index, wanted, artifacts).checkpoint())

    def find_all(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All versions of many classes at once, from ``(raw, wanted)`` rows; ``wanted`` is a version or NULL.

        Returns the answers, one row per request and artifact, and the outcome, one row
        per request with its number of versions, 0 for a miss. Registry first; what it
        does not know, or not in the wanted version, is searched in tiers, where the
        version comes after the tiers: the first tier with any match decides.
        """
        wanted = lookup.normalized(requests).checkpoint()
        hits = self._hits(wanted)
        return lookup.answers(hits, self._texts(hits)), lookup.outcome(wanted, hits)

    def _hits(self, wanted: DataFrame) -> DataFrame:
        """``(name, wanted, fqn, jar_path, lookup_source)`` of normalized requests."""
        parts = []

        def add(hits: DataFrame, origin: str) -> DataFrame:
            parts.append(hits.withColumn("lookup_source", F.lit(origin)).checkpoint())
            return parts[-1]

        is_qualified = names.is_qualified(F.col("name"))
        kinds = wanted.agg(F.count_if(is_qualified).alias("qualified"), F.count_if(~is_qualified).alias("simple")).first()
        qualified = lookup.qualified(wanted)
        if kinds["qualified"]:
            registry = self.store.of_names("class_registry", qualified.select(F.col("name").alias("fqn")))
            known = add(self._still_held(lookup.registered(qualified, registry)), lookup.REGISTRY)
            missed = lookup.unanswered(qualified, known).checkpoint()
            if not missed.isEmpty():
                add(self._in_tiers(missed), lookup.SCAN)
        if kinds["simple"]:
            add(self._by_simple_name(lookup.simple(wanted)), lookup.SCAN)
        if not parts:
            return self.spark.createDataFrame([], "name string, wanted string, fqn string, jar_path string, lookup_source string")
        return reduce(DataFrame.unionByName, parts)

    def find(self, raw: str, version: str | None = None) -> Found:
        """All versions of one class with their source, in version order: a batch of one request."""
        request = self.spark.createDataFrame([(raw, version)], "raw string, wanted string")
        hits = self._hits(lookup.normalized(request).checkpoint())
        first = hits.select("fqn", "jar_path", "lookup_source").first()
        name = first["fqn"] if first else self.normalize(raw)
        scopes = self.scopes(name) if "." in raw else [self.repository]
        if first is None:
            raise ClassNotFound(f"Class {name} not found (scan dir: {self.repository if '.' not in raw else scopes[0]})")
        root = scopes[0]
        if first["lookup_source"] == lookup.SCAN:
            # the directory that was searched when the class was found
            root = next((s for s in scopes if first["jar_path"].startswith(f"{s}/")), self.repository)
        versions = lookup.answers(hits, self._texts(hits)).drop(*lookup.REQUEST).orderBy(*resolve.version_order())
        return Found(name, root, versions)

    def _texts(self, hits: DataFrame) -> DataFrame:
        """``(fqn, jar_path, content, source, cache_hit)``: cached text, else the sources archive, else the decompiler."""
        wanted = hits.select("fqn", "jar_path").distinct().checkpoint()
        cached = self.store.sources(wanted.select("fqn")).join(wanted, ["fqn", "jar_path"], "left_semi").checkpoint()
        missing = wanted.join(cached.select("fqn", "jar_path"), ["fqn", "jar_path"], "left_anti").checkpoint()
        read = self._read_sources_of(missing).checkpoint()
        rest = missing.join(read.select("fqn", "jar_path"), ["fqn", "jar_path"], "left_anti")
        return lookup.preferred_text(cached, read, self._decompile_class(rest))

    def _read_sources_of(self, hits: DataFrame) -> DataFrame:
        """``(fqn, jar_path, content)`` of the classes in the sibling archives that have them."""
        requests = hits.select(
            "fqn", "jar_path",
            names.sources_jar_path(F.col("jar_path")).alias("sources_path"),
            names.source_entry_of_class(F.col("fqn")).alias("entry_name"),
        ).where("sources_path is not null")
        found = read_source_entries(requests.drop("fqn").distinct()).select("jar_path", "entry_name", "content")
        # inner classes share the entry of their outer class
        return requests.join(found, ["jar_path", "entry_name"]).select("fqn", "jar_path", "content")

    def _decompile_class(self, hits: DataFrame) -> DataFrame:
        """``(fqn, jar_path, content)``; nothing without a tool."""
        if self.decompiler is None:
            return hits.select("fqn", "jar_path", F.lit(None).cast("string").alias("content")).limit(0)
        outputs = decompile(hits, self.decompiler)
        failure = outputs.where("error is not null").first()
        if failure is not None:
            raise DecompileError(failure["error"])
        return outputs.select(
            "fqn", "jar_path", text.content_for_class(F.col("output"), F.col("fqn")).alias("content"))

    def structures(self, found: Found) -> DataFrame:
        """Contract per version; the sources archive wins even over a cached text."""
        versions = found.versions.select("fqn", "version", "jar_path", "content", "source")
        original = self._read_sources_of(versions).withColumnRenamed("content", "original")
        chosen = versions.join(original, ["fqn", "jar_path"], "left")
        return chosen.select(
            "fqn", "version", "jar_path",
            F.when(F.col("original").isNotNull(), F.lit(SOURCES_JAR))
            .otherwise(F.col("source")).alias("structure_source"),
            class_structure(F.coalesce("original", "content")).alias("structure"),
        ).orderBy(*resolve.version_order())

    def backfill(self, found: Found) -> DataFrame:
        """Load every artifact whose text was not cached yet; failures are rows."""
        return self.load(found.versions.where(~F.col("cache_hit")).select("jar_path").distinct())

    # -- index --------------------------------------------------------------

    def _append_registry(self, classes: DataFrame, cataloged: DataFrame, run: int) -> None:
        pairs = classes.withColumn("seq", F.lit(run).cast("long"))
        self.store.write("class_registry", registry.new_pairs(pairs, self.store.registry()))
        self.store.write("artifact_manifest", registry.uncataloged(cataloged, self.store.manifest()))

    def index(self, path: str | None = None) -> DataFrame:
        """Catalog every artifact not cataloged before; one row of counters."""
        artifacts = list_artifacts(self.spark, path or self.repository)
        fresh = registry.uncataloged(artifacts, self.store.manifest())
        entries = read_entry_names(fresh, suffix=names.CLASS_SUFFIX).checkpoint()
        status, classes = catalog.archive_status(entries), catalog.classes(entries)
        unread = name_index.unread(artifacts.join(fresh.select("jar_path"), "jar_path", "left_semi"), self.store.name_archives()).checkpoint()
        with self.store.run() as run:
            self._append_registry(classes, status.where("readable").select("jar_path"), run)
            # what was opened anyway also answers lookups of simple names
            self._store_names(name_index.of_entries(entries.where("entry_idx >= 0"), unread), unread)
        return registry.index_summary(artifacts, status, classes).withColumn(
            "root", F.lit(path or self.repository)
        )

    def update(self) -> DataFrame:
        """Catalog artifacts that changed since the last call; one row of counters.

        The snapshot moves for every artifact, also for one that cannot be read.
        """
        artifacts = list_artifacts(self.spark, self.repository)
        status, classes = self._take_in(artifacts, self.store.mtimes())
        return registry.side_by_side(
            artifacts.agg(F.count("*").alias("scanned_jars")),
            status.agg(
                F.count("*").alias("changed_jars"), F.count_if(~F.col("readable")).alias("failed_jars")
            ),
            classes.agg(F.count("*").alias("indexed_classes")),
        ).withColumn("root", F.lit(self.repository))

    def _take_in(self, artifacts: DataFrame, snapshot: DataFrame, tag: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Catalog those of ``artifacts`` that changed since ``snapshot`` in one run; their status and classes."""
        changed = changes.changed(artifacts, snapshot).checkpoint()
        moved = changes.moved_snapshot(artifacts, snapshot).checkpoint()
        entries = read_entry_names(changed, suffix=names.CLASS_SUFFIX).checkpoint()
        status, classes = catalog.archive_status(entries), catalog.classes(entries)
        with self.store.run(tag) as run:
            self.store.write("jar_mtime", moved)
            self._append_registry(classes, status.where("readable").select("jar_path"), run)
        return status, classes

    def follow(
        self, checkpoint: str, settle_seconds: float = 10, compact_every: int = 100, **trigger
    ) -> StreamingQuery:
        """Keep the catalog up to date by a stream of changed artifacts; what ``update`` does, without a full listing.

        A batch is one run of the store, and none if nothing changed. A repeated batch is
        recognised by its tag; one that found other artifacts when it was repeated takes
        in nothing twice, since the snapshot moves with every run.
        """
        tags = BatchTags("follow", checkpoint)

        def take_in(batch: DataFrame, number: int) -> None:
            tag = tags.of(batch.sparkSession, number)
            if self.store.has_run(tag):
                return
            # each reading of the batch would walk the tree again
            artifacts = batch.checkpoint()
            if not artifacts.isEmpty():
                self._take_in(artifacts, self.store.mtimes(artifacts), tag)
            if number % compact_every == compact_every - 1:
                self.store.compact("jar_mtime")

        return (
            artifact_changes(self.spark, self.repository, settle_seconds)
            .writeStream.foreachBatch(take_in)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    # -- load and warm up ---------------------------------------------------

    def _classes_of(
        self, targets: DataFrame, classes: DataFrame, excluded: DataFrame | None, top_level_only: bool
    ) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``(jar_path, fqn, content, source)``, the artifacts that failed, and those with gaps.

        Gaps, ``(jar_path, missing)``, are cataloged classes without any text; only
        artifacts that could not be decompiled have them.
        """
        def allowed(rows: DataFrame) -> DataFrame:
            return rows if excluded is None else content.without_excluded(rows, excluded, top_level_only)

        pairs = targets.select(
            "jar_path", names.sources_jar_path(F.col("jar_path")).alias("sources_path")
        ).where("sources_path is not null")
        # each archive is read once; what follows ranks keys and passes texts on
        read = content.name_sources(read_sources(pairs)).checkpoint()
        sources = allowed(content.keep_first(content.readable(read)))
        gaps = content.needs_decompiling(targets, classes, sources.select("jar_path", "fqn"))
        if self.decompiler is None:
            # originals are all there is: only artifacts without any are failures
            failed = targets.join(sources, "jar_path", "left_anti")
            kept = sources.select("jar_path", "fqn", "content", F.lit(SOURCES_JAR).alias("source"))
            return kept, failed, gaps.join(failed, "jar_path", "left_anti")
        outputs = decompile_archives(gaps, self.decompiler)
        failed = outputs.where("error is not null").select("jar_path")
        decompiled = allowed(content.parse_pieces(outputs))
        kept = content.source_wins(sources, decompiled).join(failed, "jar_path", "left_anti")
        return kept, failed, gaps.limit(0)

    def _store_classes(
        self, targets: DataFrame, loaded: DataFrame, failed: DataFrame, gaps: DataFrame
    ) -> DataFrame:
        """Write texts and, for artifacts without gaps, warm marks; ``(jar_path, classes_loaded)``."""
        done = targets.select("jar_path").join(failed, "jar_path", "left_anti")
        counts = loaded.groupBy("jar_path").agg(F.count("*").alias("n"))
        counted = done.join(counts, "jar_path", "left").select(
            "jar_path", F.coalesce("n", F.lit(0).cast("long")).alias("classes_loaded")
        ).checkpoint()
        self.store.write("class_sources", loaded)
        self.store.write(
            "jar_hotspot",
            hotspot.warmed_marks(
                counted.join(gaps, "jar_path", "left_anti").withColumnRenamed("classes_loaded", "class_count")
            ),
        )
        return counted

    def load(self, targets: DataFrame | str) -> DataFrame:
        """Cache all classes of artifacts; ``(jar_path, classes_loaded, skipped, failed, gaps)``.

        Texts and the loaded mark become visible together. An artifact that fails
        is reported and leaves no texts behind. One with ``gaps``, classes that have
        no text as there is no decompiler, gets no mark and is loaded again next time.
        """
        if isinstance(targets, str):
            targets = self.spark.createDataFrame([(targets,)], "jar_path string")
        flagged = content.skip_loaded(targets.select("jar_path").distinct(), self.store.loaded()).checkpoint()
        pending = flagged.where(~F.col("skipped")).select("jar_path")
        classes = catalog.classes(read_entry_names(flagged, suffix=names.CLASS_SUFFIX)).checkpoint()
        fresh = registry.uncataloged(classes, self.store.manifest())
        loaded, failed, gaps = self._classes_of(pending, classes, None, False)
        loaded, failed, gaps = loaded.checkpoint(), failed.checkpoint(), gaps.checkpoint()
        with self.store.run() as run:
            self._append_registry(fresh, fresh.select("jar_path").distinct(), run)
            counted = self._store_classes(pending, loaded, failed, gaps)
            self.store.write("jars", counted.join(gaps, "jar_path", "left_anti"))
        marks = failed.select("jar_path", F.lit(True).alias("failed_mark")).distinct()
        described = flagged.join(counted, "jar_path", "left").join(marks, "jar_path", "left").join(gaps, "jar_path", "left")
        return described.select(
            "jar_path",
            F.coalesce("classes_loaded", F.lit(0).cast("long")).alias("classes_loaded"),
            "skipped",
            F.coalesce("failed_mark", F.lit(False)).alias("failed"),
            F.coalesce("missing", F.lit(0).cast("long")).alias("gaps"),
        )

    def warm(self, tasks: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
        """Run queued warm-up tasks ``(jar_path, priority, seq, mode)``.

        One task per artifact, urgent ones submitted first; neither loaded marks
        nor the registry take part. Result as for ``load``.
        """
        excluded = excluded if excluded is not None else self.spark.createDataFrame([], "fqn string")
        queue = warmup.queue_order(tasks).checkpoint()
        parts = []
        for mode, top_level_only in ((hotspot.ALL_CLASSES, False), (hotspot.TOP_LEVEL_ONLY, True)):
            targets = queue.where(F.col("mode") == mode).select("jar_path")
            classes = catalog.classes(read_entry_names(targets, suffix=names.CLASS_SUFFIX)).checkpoint()
            loaded, failed, gaps = self._classes_of(targets, classes, excluded, top_level_only)
            parts.append((targets, loaded.checkpoint(), failed.checkpoint(), gaps.checkpoint()))
        targets, loaded, failed, gaps = (a.unionByName(b) for a, b in zip(*parts))
        with self.store.run():
            counted = self._store_classes(targets, loaded, failed, gaps)
        rows = counted.select("jar_path", "classes_loaded", F.lit(False).alias("failed"))
        lost = failed.select("jar_path", F.lit(0).cast("long").alias("classes_loaded"), F.lit(True).alias("failed"))
        return rows.unionByName(lost).withColumn("skipped", F.lit(False))

    def warmup_targets(
        self, jar_path: str | None = None, hot: bool = False, group: str | None = None,
        top: int = 20, limit: int | None = None,
    ) -> DataFrame:
        """Artifacts to warm up: hot ones, else a group, else one path."""
        if hot:
            targets = hotspot.top_unwarmed(self.store.hotspots(), top)
        elif group is not None:
            directory = os.path.join(self.repository, names.group_directory(group))
            # only the group's own directory is listed
            targets = warmup.group_targets(list_artifacts(self.spark, directory), group, limit, self.repository)
        elif jar_path is not None:
            targets = self.spark.createDataFrame([(jar_path,)], "jar_path string")
        else:
            raise ValueError("warmup requires jar_path, or hot / group")
        targets = targets.select("jar_path")
        return targets if limit is None else targets.limit(limit)

    def warmup(self, **choice) -> tuple[DataFrame, DataFrame]:
        """Load the chosen targets; summary row and one row per target."""
        loads = self.load(self.warmup_targets(**choice).checkpoint())
        return warmup.run_summary(loads), loads

    # -- cache and counters -------------------------------------------------

    def put_sources(self, writes: DataFrame) -> int:
        """Upsert ``(fqn, jar_path, content, source, seq)``; the number of keys written."""
        rows = content.keep_last(writes).checkpoint()
        written = rows.count()
        if written:
            with self.store.run():
                self.store.write("class_sources", rows)
        return written

    def record_access(self, log: DataFrame, threshold: int = hotspot.WARMUP_THRESHOLD) -> DataFrame:
        """Count a batch of accesses ``(jar_path, epoch, order, warmed, class_count)``.

        Returns the warm-up requests the batch triggers given the counters so far.
        """
        wanted = hotspot.requests(log, threshold, self.store.hotspots()).checkpoint()
        with self.store.run():
            self.store.write("jar_hotspot", hotspot.increments(log))
        return wanted

    def record_lookup(self, found: Found) -> DataFrame:
        """Count one access to each artifact a lookup returned, at the current time."""
        log = found.versions.select("jar_path").select(
            "jar_path",
            F.unix_timestamp().alias("epoch"),
            F.lit(0).cast("long").alias("order"),
            F.lit(False).alias("warmed"),
            F.lit(0).cast("long").alias("class_count"),
        )
        return self.record_access(log)

    def stats(self) -> tuple[DataFrame, DataFrame]:
        """One row of counters and the most accessed artifacts."""
        hotspots = self.store.hotspots()
        counts = stats.table_counts(
            self.store.rows("class_sources"), self.store.registry(), self.store.manifest(),
            self.store.loaded(), hotspots,
        ).select(
            F.lit(self.store.path).alias("db_path"), "*",
            # writes are jobs: none is pending once a verb returned
            F.lit(0).cast("long").alias("write_buffer_pending"),
            F.lit(hotspot.WARMUP_THRESHOLD).cast("long").alias("warmup_threshold"),
            F.lit(0).cast("long").alias("warmup_pending_tasks"),
        )
        return counts, hotspot.top_accessed(hotspots).drop("class_count")

    def clear(self) -> None:
        self.store.clear()
