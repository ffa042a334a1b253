"""Persistent tables: append-only Parquet, grouped into committed runs.

Every change is one run: its rows are appended to the tables it touches and one
row in ``commits`` then makes all of them visible together. A run that failed
half-way, or whose executors were lost, never gets that row and stays unseen.
A run holds the store's writer lock, a file created exclusively; whoever finds it
there waits, fails after ``wait`` seconds and changes nothing. Only a driver that died
leaves it behind; ``release`` removes it then.
Rows are never rewritten, so the cost of a change follows the change and not the
size of the store; readers merge by key.

The tables looked up by a name are partitioned by a hash of the name and carry a
Bloom filter on it, so a lookup opens a fraction of the files; a lookup of several
names prunes partitions at run time. The number of partitions is fixed when the store
is first written and read back later.

The list of commits is one small file per run. Every ``FOLD`` runs it is written anew
as one file in a folder of its own, which counts once it is complete; the folder before
stays for readers that still use it.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from classatlas import schemas

# Names of the tables
TABLES = {
    "class_sources": schemas.CLASS_SOURCES,
    "jars": schemas.JAR_KEYS,
    "class_registry": schemas.CLASS_REGISTRY,
    "artifact_manifest": schemas.JAR_KEYS,
    "jar_hotspot": schemas.JAR_HOTSPOT,
    "jar_mtime": schemas.JAR_MTIME,
    "simple_names": schemas.SIMPLE_NAMES,
    "name_archives": schemas.JAR_MTIME,
}
#: Tables partitioned by a hash of this column.
BY_NAME = {"class_sources": "fqn", "class_registry": "fqn", "simple_names": "simple_name"}
#: Runs after which the list of commits is folded.
FOLD = 64
#: Requests up to which their names are broadcast; more are joined by an exchange.
FEW_REQUESTS = 10_000
_COMMITS = T.StructType([
    T.StructField("run", T.LongType()),
    T.StructField("tag", T.StringType()),
    # table that this run rewrote as a whole, so that older runs of it are obsolete
    T.StructField("base_of", T.StringType()),
])
_LAYOUT = T.StructType([T.StructField("slots", T.IntegerType())])


class StoreLocked(RuntimeError):
    """Another run is open on this store."""


def name_slot(name: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(slots)).cast("int")


class Store:
    """Tables below one directory of a file system shared by the cluster."""

    def __init__(self, spark: SparkSession, path: str, slots: int = 64, wait: float = 60.0):
        self.spark = spark
        self.path = path.rstrip("/")
        self.wait = wait
        self._wanted_slots = slots
        self._stored_slots: int | None = None
        self._open_run: int | None = None

    def _location(self, table: str) -> str:
        return f"{self.path}/{table}"

    def _filesystem(self, location: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(location)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, location: str) -> bool:
        files, path = self._filesystem(location)
        return files.exists(path)

    @property
    def slots(self) -> int:
        """Hash partitions of the tables by class: what the store was written with, else what was asked for."""
        if self._stored_slots is None and self._exists(self._location("layout")):
            self._stored_slots = self.spark.read.schema(_LAYOUT).parquet(self._location("layout")).first()["slots"]
        return self._stored_slots or self._wanted_slots

    def _keep_layout(self) -> None:
        slots = self.slots
        if self._stored_slots is None:
            self.spark.createDataFrame([(slots,)], _LAYOUT).coalesce(1).write.mode("overwrite").parquet(
                self._location("layout"))

    def _lock(self) -> None:
        files, path = self._filesystem(self._location("writer.lock"))
        pause, until, strange = 0.05, time.monotonic() + self.wait, 0
        while True:
            try:
                files.create(path, False).close()
                return
            except Exception as failure:
                if not files.exists(path):
                    # the holder may have gone between both calls; anything else comes again at once
                    strange += 1
                    if strange > 3:
                        raise
                elif time.monotonic() >= until:
                    raise StoreLocked(f"another run is writing to {self.path}") from failure
            time.sleep(pause)
            pause = min(2 * pause, 1.0)

    def release(self) -> None:
        """Remove the writer lock of a driver that died; no run may be open."""
        files, path = self._filesystem(self._location("writer.lock"))
        files.delete(path, False)

    def _schema(self, table: str) -> T.StructType:
        fields = [*TABLES[table].fields, T.StructField("run", T.LongType())]
        if table in BY_NAME:
            fields.append(T.StructField("slot", T.IntegerType()))
        return T.StructType(fields)

    def _folds(self) -> list[int]:
        """Numbers of the complete folders of commits, in order."""
        files, path = self._filesystem(self._location("commits"))
        if not files.exists(path):
            return []
        numbers = (int(s.getPath().getName().removeprefix("fold-")) for s in files.listStatus(path))
        return sorted(n for n in numbers if self._exists(f"{self._location('commits')}/fold-{n}/_SUCCESS"))

    def _commits(self) -> DataFrame | None:
        folds = self._folds()
        return self.spark.read.schema(_COMMITS).parquet(f"{self._location('commits')}/fold-{folds[-1]}") if folds else None

    def _commit(self, number: int, tag: str | None, base_of: str | None) -> None:
        folds, row = self._folds(), self.spark.createDataFrame([(number, tag, base_of)], _COMMITS)
        fold = folds[-1] if folds else 0
        row.coalesce(1).write.mode("append").parquet(f"{self._location('commits')}/fold-{fold}")
        if number % FOLD == 0:
            # an unfinished folder of this number does not count and is replaced
            self._commits().coalesce(1).write.mode("overwrite").parquet(f"{self._location('commits')}/fold-{fold + 1}")
            for old in folds[:-1]:
                files, path = self._filesystem(f"{self._location('commits')}/fold-{old}")
                files.delete(path, True)

    def last_run(self) -> int:
        """Number of committed runs; they are numbered from 1 without gaps."""
        return self._visible(None)[1]

    def _visible(self, table: str | None) -> tuple[int, int]:
        """First and last run a reader of a table has to look at."""
        commits = self._commits()
        if commits is None:
            return 0, 0
        bounds = commits.agg(
            F.coalesce(F.max(F.when(F.col("base_of") == table, F.col("run"))), F.lit(0)).alias("first"),
            F.coalesce(F.max("run"), F.lit(0)).alias("last"),
        ).first()
        return bounds["first"], bounds["last"]

    def has_run(self, tag: str) -> bool:
        """Whether a run with this tag was committed, e.g. a repeated stream batch."""
        commits = self._commits()
        return commits is not None and not commits.where(F.col("tag") == tag).isEmpty()

    def rows(self, table: str) -> DataFrame:
        """Rows of all committed runs, with ``run``; opening does not write anything."""
        location = self._location(table)
        if not self._exists(location):
            return self.spark.createDataFrame([], self._schema(table))
        first, last = self._visible(table)
        return (
            self.spark.read.schema(self._schema(table)).parquet(location).where(F.col("run").between(first, last))
        )

    def of_class(self, table: str, name: str) -> DataFrame:
        """Point lookup that touches one hash partition."""
        hit = F.col(BY_NAME[table]) == name
        return self.rows(table).where((F.col("slot") == name_slot(F.lit(name), self.slots)) & hit)

    def of_names(self, table: str, requests: DataFrame) -> DataFrame:
        """Rows of a table for all names in ``requests``, which has the table's name column.

        The join includes the partition, so that partitions without a requested name are
        not opened. A number of names that was counted to be small is broadcast; more of
        them are joined by an exchange, and then most partitions hold one anyway.
        """
        key = BY_NAME[table]
        wanted = requests.select(key).where(F.col(key) != "").distinct().checkpoint()
        found = wanted.limit(FEW_REQUESTS + 1).count()
        if not found:
            return self.rows(table).limit(0)
        # a comparison tells the optimizer that pruning by these rows pays; this one always holds
        slotted = wanted.withColumn("slot", name_slot(F.col(key), self.slots)).where("slot >= 0")
        return self.rows(table).join(F.broadcast(slotted) if found <= FEW_REQUESTS else slotted, ["slot", key])

    @contextmanager
    def run(self, tag: str | None = None, base_of: str | None = None) -> Iterator[int]:
        """Open a run; leaving the block without an error commits it.

        One writer at a time, as with a single write transaction: others wait for
        an open run to end, and raise ``StoreLocked`` if it takes too long. Left-overs
        of a failed run under the same number are removed first.
        """
        self._lock()
        try:
            self._open_run = self.last_run() + 1
            self._keep_layout()
            for table in TABLES:
                files, left_over = self._filesystem(f"{self._location(table)}/run={self._open_run}")
                if files.exists(left_over):
                    files.delete(left_over, True)
            yield self._open_run
            self._commit(self._open_run, tag, base_of)
        finally:
            self._open_run = None
            self.release()

    def write(self, table: str, rows: DataFrame) -> None:
        """Add rows to a table within the open run."""
        if self._open_run is None:
            raise RuntimeError("write outside a run")
        columns = TABLES[table].fieldNames()
        target = f"{self._location(table)}/run={self._open_run}"
        ready = rows.select(*columns)
        if table in BY_NAME:
            key = BY_NAME[table]
            # adaptive execution merges small slots and splits a slot that grew large
            ready = ready.withColumn("slot", name_slot(F.col(key), self.slots)).hint("rebalance", F.col("slot"))
            ready = ready.sortWithinPartitions("slot", key)
            writer = ready.write.partitionBy("slot").option(f"parquet.bloom.filter.enabled#{key}", "true")
        else:
            writer = ready.write
        writer.mode("overwrite").option("partitionOverwriteMode", "static").parquet(target)

    def registry(self) -> DataFrame:
        """``(fqn, jar_path, seq)``; appends are anti-joined, so each pair occurs once."""
        return self.rows("class_registry").select(*schemas.CLASS_REGISTRY.fieldNames())

    def manifest(self) -> DataFrame:
        return self.rows("artifact_manifest").select("jar_path")

    def loaded(self) -> DataFrame:
        return self.rows("jars").select("jar_path")

    def sources(self, requests: DataFrame | str | None = None) -> DataFrame:
        """``(fqn, jar_path, content, source)``; the latest run of a key wins.

        All classes, one, or those in ``requests``. Keys written more than once are few
        and found on narrow columns, so the texts themselves are not shuffled while that
        set is small.
        """
        if requests is None:
            rows = self.rows("class_sources")
        elif isinstance(requests, str):
            rows = self.of_class("class_sources", requests)
        else:
            rows = self.of_names("class_sources", requests)
        rewritten = (
            rows.groupBy("fqn", "jar_path")
            .agg(F.max("run").alias("latest"), F.count("*").alias("n"))
            .where("n > 1")
            .drop("n")
        )
        kept = rows.join(rewritten, ["fqn", "jar_path"], "left")
        return kept.where("latest is null or run = latest").select(*schemas.CLASS_SOURCES.fieldNames())

    def hotspots(self) -> DataFrame:
        """Current counters per artifact.

        Runs carry increments: accesses add up, warmth sticks, the class count of
        the latest warming run holds.
        """
        rows = self.rows("jar_hotspot")
        return rows.groupBy("jar_path").agg(
            F.sum("access_count").alias("access_count"),
            F.max("last_access").alias("last_access"),
            F.bool_or("warmed").alias("warmed"),
            F.coalesce(
                F.max_by("class_count", F.when(F.col("warmed"), F.col("run"))), F.lit(0)
            ).alias("class_count"),
        )

    def mtimes(self, artifacts: DataFrame | None = None) -> DataFrame:
        """``(jar_path, mtime_ns)`` as last seen, of all or of some artifacts; of few, no others are shuffled."""
        return self._latest_times("jar_mtime", artifacts)

    def name_archives(self) -> DataFrame:
        """``(jar_path, mtime_ns)``: what archives looked like when their simple names were read."""
        return self._latest_times("name_archives")

    def _latest_times(self, table: str, artifacts: DataFrame | None = None) -> DataFrame:
        rows = self.rows(table)
        if artifacts is not None:
            rows = rows.join(artifacts.select("jar_path"), "jar_path", "left_semi")
        return rows.groupBy("jar_path").agg(F.max_by("mtime_ns", "run").alias("mtime_ns"))

    def simple_names(self, requests: DataFrame | None = None) -> DataFrame:
        """``(simple_name, fqn, jar_path, mtime_ns)``, of all names or those in ``requests``; old states of archives are in it."""
        rows = self.rows("simple_names") if requests is None else self.of_names("simple_names", requests)
        return rows.select(*schemas.SIMPLE_NAMES.fieldNames())

    def compact(self, table: str) -> None:
        """Replace the history of a table by its current rows, one per key.

        Keeps the cost of reading proportional to the content however many runs
        there were. Runs replaced just now stay on disk for readers that still use
        them; those replaced by the compaction before are removed.
        """
        self.vacuum(table)
        current = {
            "class_sources": self.sources,
            "class_registry": self.registry,
            "artifact_manifest": self.manifest,
            "jars": self.loaded,
            "jar_hotspot": self.hotspots,
            "jar_mtime": self.mtimes,
            "name_archives": self.name_archives,
            # only the latest state of each archive
            "simple_names": lambda: self.simple_names().join(self.name_archives(), ["jar_path", "mtime_ns"], "left_semi").distinct(),
        }[table]()
        with self.run(base_of=table):
            self.write(table, current)

    def vacuum(self, table: str) -> None:
        """Delete runs of a table that a compaction made obsolete; no reader may be left."""
        first, _ = self._visible(table)
        files, location = self._filesystem(self._location(table))
        if not files.exists(location):
            return
        for status in files.listStatus(location):
            name = status.getPath().getName()
            if name.startswith("run=") and int(name.removeprefix("run=")) < first:
                files.delete(status.getPath(), True)

    def clear(self) -> None:
        """Drop the tables of the store and nothing else; a missing store is fine, an open run is waited for."""
        if not self._exists(self.path):
            return
        self._lock()
        try:
            for table in ("commits", "layout", *TABLES):
                files, path = self._filesystem(self._location(table))
                if files.exists(path):
                    files.delete(path, True)
            self._stored_slots = None
        finally:
            self.release()
