"""Tables of the engine's data model derived from the given Parquet tables.

The given tables hold no archives. Every document stands for one class entry of
one artifact, every event for an access to an artifact. The functions here only
rename and concatenate columns; selections belong to the operators.
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from classatlas.functions import names
from classatlas.functions.text import DECOMPILED_BANNER
from classatlas.operators import hotspot
from classatlas.session import ensure_checkpoint_dir, use_all_slots

#: Folders that archives are dealt out to; each is filled by one task.
FOLDERS = 1024
#: Entries of archives up to this length are not worth a compressor.
STORED_BYTES = 100


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def stream(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A given table as a stream of files, be it one file or a folder of them.

    A source of files wants a folder; only a pattern may name either, also one without a choice.
    """
    schema = table(spark, directory, name).schema
    return spark.readStream.schema(schema).parquet(f"{directory}/{{{name}.parquet}}")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def classes(spark: SparkSession, directory: str) -> DataFrame:
    return classes_of(table(spark, directory, "documents"))


def classes_of(documents: DataFrame) -> DataFrame:
    """``doc_id, lang, source, text, jar_path, version, simple_name, fqn``.

    Artifacts lie below the package's own directory, below its parent or in a
    mirror, depending on the class, so that all search tiers occur.
    """
    doc, lang, source = F.col("doc_id"), F.col("lang"), F.col("source")
    version = cat((doc % 12).cast("string"), ".0")
    home = (
        F.when((doc % 7 == 4) | (doc % 11 == 0), cat("mirror/", source))
        .when((doc % 7 < 2) & (doc % 5 == 0), cat("org/", lang, "/core"))
        .otherwise(cat("org/", lang, "/", source))
    )
    simple = cat("C", (doc % 7).cast("string"))
    return documents.select(
        "doc_id", "lang", "source", "text",
        cat(home, "/", version, "/", source, "-", version, ".jar").alias("jar_path"),
        version.alias("version"),
        simple.alias("simple_name"),
        cat("org.", lang, ".core.", simple).alias("fqn"),
    )


def documents_spread(spark: SparkSession, directory: str) -> DataFrame:
    """Classes with their texts, over all task slots, for costly work per text.

    The given tables are single files; archives are spread by path when they are read.
    """
    wanted = classes(spark, directory).select("doc_id", "lang", "source", "simple_name", "text")
    return use_all_slots(wanted)


def entry_name() -> Column:
    """Name of the entry that a class stands for: classes, inner classes, descriptors, manifests and odd names."""
    path = cat("org/", F.col("lang"), "/core/", F.col("simple_name"))
    kind = F.col("doc_id") % 9
    return (
        F.when(kind == 0, cat(path, "$Inner.class"))
        .when(kind == 1, F.lit("META-INF/MANIFEST.MF"))
        .when(kind == 2, cat(F.col("simple_name"), ".class"))
        .when(kind == 3, cat(path, ".class.class"))
        .when(kind == 4, cat("org\\", F.col("lang"), "\\core\\", F.col("simple_name"), ".class"))
        .when(kind == 5, cat("org/", F.col("lang"), "/core/package-info.class"))
        .otherwise(cat(path, ".class"))
    )


def entries(spark: SparkSession, directory: str) -> DataFrame:
    """Archive entries, one per document."""
    return classes(spark, directory).select(
        "doc_id", "jar_path", F.col("doc_id").alias("entry_idx"), entry_name().alias("entry_name"),
        "fqn", "simple_name",
    )


def artifact_states(spark: SparkSession, directory: str) -> DataFrame:
    """``(jar_path, mtime_ns)``: the newest document of an artifact stands for its modification time."""
    return classes(spark, directory).groupBy("jar_path").agg(F.max("doc_id").alias("mtime_ns"))


def _write_archive(path: str, *entries: tuple[str, str | bytes]) -> None:
    """Made in memory and written at once, as an archive of one text is small; only longer entries are deflated."""
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as archive:
        for name, data in entries:
            method = zipfile.ZIP_DEFLATED if len(data) > STORED_BYTES else zipfile.ZIP_STORED
            archive.writestr(zipfile.ZipInfo(name), data, method, 1)
    with open(path, "wb") as file:
        file.write(made.getbuffer())


def _write_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One binary archive per row and a sources archive beside it; only paths leave the task."""
    folders = set()
    for batch in batches:
        for row in batch.to_pylist():
            folder = os.path.dirname(row["jar_path"])
            if folder not in folders:
                os.makedirs(folder, exist_ok=True)
                folders.add(folder)
            _write_archive(row["jar_path"], ("META-INF/MANIFEST.MF", ""), (row["entry_name"], row["fqn"]))
            _write_archive(
                row["sources_path"], ("org/package-info.java", "package org;"),
                (row["source_entry"], row["content"].encode() + b"// \xff\r\n"))
        yield batch.select(["doc_id", "jar_path", "sources_path", "fqn"])


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives, as a path that file functions of tasks take."""
    return re.sub("^file:/*", "/", scratch(spark, "archives"))


def archives(spark: SparkSession, directory: str, base: str | None = None) -> DataFrame:
    """``doc_id, jar_path, sources_path, fqn`` of real archives, two per document, written by tasks.

    The sources end in a line with an invalid byte and a line end of another system.
    """
    base = base or archive_folder(spark)
    folder = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDERS))
    home = cat(base, "/", folder.cast("string"), "/", F.col("doc_id").cast("string"))
    tasks = 4 * spark.sparkContext.defaultParallelism
    # texts move once, and whole folders to a task
    dealt = table(spark, directory, "documents").where("doc_id is not null").repartition(tasks, folder)
    rows = with_content(classes_of(dealt)).select(
        "doc_id", cat(home, ".jar").alias("jar_path"), cat(home, names.SOURCES_SUFFIX).alias("sources_path"), "fqn",
        entry_name().alias("entry_name"), names.source_entry_of_class(F.col("fqn")).alias("source_entry"), "content")
    written = rows.mapInArrow(_write_archives, "doc_id long, jar_path string, sources_path string, fqn string")
    return written.checkpoint()


def _touch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("jar_path").to_pylist():
            os.utime(path)
        yield batch


def touch(archives: DataFrame) -> None:
    """Give archives the present as their modification time."""
    archives.select("jar_path").mapInArrow(_touch, "jar_path string").write.format("noop").mode("overwrite").save()


def source_text(text: Column) -> Column:
    """A compilation unit around a whole document."""
    return cat(
        "package org.", F.col("lang"), ".core;\n\npublic class ", F.col("simple_name"),
        " {\n// ", text, "\n}\n",
    )


def with_content(rows: DataFrame) -> DataFrame:
    return rows.withColumn("content", source_text(F.col("text")))


def labels(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "labels")


def every(jar_path: Column, n: int) -> Column:
    """Artifacts whose version is a multiple of ``n``: keys left out where an anti-join needs gaps."""
    return names.version_of_path(jar_path).cast("double") % n == 0


def cache_writes(spark: SparkSession, directory: str) -> DataFrame:
    """Texts written to the cache, one per document, ``seq`` in writing order."""
    return cache_writes_of(classes(spark, directory))


def cache_writes_of(rows: DataFrame) -> DataFrame:
    return with_content(rows).select(
        "fqn", "jar_path", "content", F.lit("sources-jar").alias("source"), F.col("doc_id").alias("seq")
    )


def sources_entries(spark: SparkSession, directory: str) -> DataFrame:
    """Entries of sources archives, one per document."""
    return with_content(classes(spark, directory)).select(
        "jar_path", F.col("doc_id").alias("entry_idx"), "fqn", "content",
        names.source_entry_of_class(F.col("fqn")).alias("entry_name"),
    )


def decompiler_pieces(spark: SparkSession, directory: str) -> DataFrame:
    """What a decompiler yields: every document."""
    return with_content(classes(spark, directory)).select(
        "jar_path", F.col("doc_id").alias("entry_idx"), "fqn", "content"
    )


def decompiler_output(spark: SparkSession, directory: str) -> DataFrame:
    """Raw tool output per document: noise, a class with the text, noise, a second class."""
    banner = DECOMPILED_BANNER + " 0.152.\n */\n"
    second = cat("package org.", F.col("lang"), ".alt;\n\ninterface I<T> {\n}\n")
    return documents_spread(spark, directory).select(
        "doc_id",
        cat(
            "Processing\r\n", banner, source_text(F.col("text")), banner, "// nothing here\r\n",
            banner, second,
        ).alias("output"),
    )


def access_log(spark: SparkSession, directory: str) -> DataFrame:
    return access_log_of(table(spark, directory, "events"))


def access_log_of(events: DataFrame) -> DataFrame:
    """``jar_path, epoch, order, warmed, class_count`` from events, batch or stream.

    A sign-up with a small counter marks the artifact warm, all else is access.
    """
    count = F.get_json_object("props", "$.k").cast("long")
    at = F.col("ts").cast("timestamp")
    return events.select(
        cat("user/", F.col("user_id").cast("string"), ".jar").alias("jar_path"),
        F.unix_seconds(at).alias("epoch"),
        F.struct("ts", "event_id").alias("order"),
        ((F.col("event_type") == "signup") & (count < 5)).alias("warmed"),
        count.alias("class_count"),
    )


def mtimes(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Modification time per path now, and in an older snapshot, in nanoseconds.

    Every event modifies its path. The snapshot knows the paths that were modified
    more than once: for every third user as they are now, else as they were first.
    """
    path = cat("u", F.col("user_id").cast("string"), "/", F.get_json_object("props", "$.k"), ".jar")
    at = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    paths = table(spark, directory, "events").groupBy(path.alias("jar_path")).agg(
        F.max(at).alias("last"), F.min(at).alias("first"), F.count("*").alias("n"), F.min("user_id").alias("user_id")
    )
    before = F.when(F.col("user_id") % 3 == 0, F.col("last")).otherwise(F.col("first"))
    return (
        paths.select("jar_path", F.col("last").alias("mtime_ns")),
        paths.where("n > 1").select("jar_path", before.alias("mtime_ns")),
    )


def warmup_tasks(spark: SparkSession, directory: str) -> DataFrame:
    priority = (
        F.when(F.col("event_type") == "purchase", F.lit(hotspot.HIGH))
        .when(F.col("event_type") == "click", F.lit(hotspot.NORMAL))
        .otherwise(F.lit(hotspot.LOW))
    )
    return table(spark, directory, "events").select(
        cat("user/", F.col("user_id").cast("string"), ".jar").alias("jar_path"),
        priority.cast("long").alias("priority"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "purchase", F.lit(hotspot.ALL_CLASSES))
        .otherwise(F.lit(hotspot.TOP_LEVEL_ONLY)).alias("mode"),
    )


def raw_queries(spark: SparkSession, directory: str) -> DataFrame:
    """Names as users paste them, one per document."""
    kind = F.col("doc_id") % 6
    fqn, lang, simple = F.col("fqn"), F.col("lang"), F.col("simple_name")
    raw = (
        F.when(kind == 0, cat("  import org.", lang, ". core. ", simple, " ; "))
        .when(kind == 1, cat("import ", fqn, ";;;"))
        .when(kind == 2, cat("\timport\torg.", lang, ".core.", simple, "\n"))
        .when(kind == 3, cat("important.", simple))
        .when(kind == 5, cat(" import ", simple, " ;"))
        .otherwise(cat(fqn, " "))
    )
    return classes(spark, directory).select("doc_id", raw.alias("raw"))


def odd_paths(spark: SparkSession, directory: str) -> DataFrame:
    """Paths of binary archives, sources archives and other files."""
    kind = F.col("doc_id") % 6
    stem = F.regexp_replace("jar_path", r"\.jar$", "")
    path = (
        F.when(kind == 0, cat(stem, "-sources.jar"))
        .when(kind == 1, cat(stem, ".JAR"))
        .when(kind == 2, cat(stem, ".jar.zip"))
        .when(kind == 3, cat(F.col("source"), ".jar"))
        .when(kind == 4, cat("/", F.col("source"), ".jar"))
        .otherwise(F.col("jar_path"))
    )
    return classes(spark, directory).select("doc_id", path.alias("path"))


def named_texts(spark: SparkSession, directory: str) -> DataFrame:
    """Source texts whose first type line takes every form the name rule knows."""
    kind = F.col("doc_id") % 8
    simple = F.col("simple_name")
    head = (
        F.when(kind == 0, cat("public final class ", simple, "<T> extends Bar {"))
        .when(kind == 1, cat("  interface   ", simple, "{"))
        .when(kind == 2, cat("enum ", simple, " {"))
        .when(kind == 3, cat("record ", simple, "(int x) {"))
        .when(kind == 4, cat(" * the class of this file\nclass ", simple, " {"))
        .when(kind == 5, cat("@interface ", simple, " {"))
        .when(kind == 6, cat("class {\nenum ", simple, " {"))
        .otherwise(F.lit("// nothing declared"))
    )
    package = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(
        cat("package  org.", F.col("lang"), " ;;\r\n")
    )
    return documents_spread(spark, directory).select(
        "doc_id", cat("\n", package, head, "\n// ", F.col("text"), "\n}\n").alias("content")
    )


def java_files(spark: SparkSession, directory: str) -> DataFrame:
    """A Java file per document: each line of the text comments a field of its own."""
    lines = F.split("text", "\n")
    fields = F.array_join(
        F.transform(
            lines,
            lambda line, i: cat(
                "    // ", line, "\n    private   String f", i.cast("string"),
                ' = "', i.cast("string"), '; {", g', i.cast("string"), "[] = {};\n",
            ),
        ),
        "",
    )
    lang, source, simple = F.col("lang"), F.col("source"), F.col("simple_name")
    return documents_spread(spark, directory).select(
        "doc_id", "lang", "source", "simple_name",
        cat(
            "package org.", lang, ".core;\n\nimport java.util.*;\nimport static org.", lang, ".util.",
            source, ";\n\n/** ", source, " */\n@Tag(names = {\"{\", \";\"})\npublic  final class ", simple,
            "<T extends Base<T>>\n    extends Base<T>   implements A,\n B {\n", fields,
            "    /* a */ /* total */\n    @Override\n    public  <K> int size (List<K> x, int[] y)  throws E {\n"
            "        if (x < y) { return ", F.size(lines).cast("string"),
            "; } // }\n    }\n    static { run(); }\n    class Inner { int hidden; }\n    ", simple,
            "() { }\n}\n",
        ).alias("content"),
    )
