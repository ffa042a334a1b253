"""Explicit schemas of every table the engine reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

SOURCES_JAR = "sources-jar"
DECOMPILED = "decompiled"

ARTIFACTS = T.StructType([
    T.StructField("jar_path", T.StringType()),
    T.StructField("mtime_ns", T.LongType()),
    T.StructField("length", T.LongType()),
])

# one header row per archive (entry_idx = -1, error set when it cannot be read)
# followed by one row per entry
ENTRIES = T.StructType([
    T.StructField("jar_path", T.StringType()),
    T.StructField("entry_idx", T.LongType()),
    T.StructField("entry_name", T.StringType()),
    T.StructField("error", T.StringType()),
])

ENTRY_TEXT = T.StructType([
    T.StructField("jar_path", T.StringType()),
    T.StructField("entry_idx", T.LongType()),
    T.StructField("entry_name", T.StringType()),
    T.StructField("content", T.StringType()),
])

DECOMPILER_OUTPUT = T.StructType([
    T.StructField("jar_path", T.StringType()),
    T.StructField("fqn", T.StringType()),
    T.StructField("output", T.StringType()),
    T.StructField("error", T.StringType()),
])

CLASS_REGISTRY = T.StructType([
    T.StructField("fqn", T.StringType()),
    T.StructField("jar_path", T.StringType()),
    T.StructField("seq", T.LongType()),
])

JAR_KEYS = T.StructType([T.StructField("jar_path", T.StringType())])

CLASS_SOURCES = T.StructType([
    T.StructField("fqn", T.StringType()),
    T.StructField("jar_path", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("source", T.StringType()),
])

JAR_HOTSPOT = T.StructType([
    T.StructField("jar_path", T.StringType()),
    T.StructField("access_count", T.LongType()),
    T.StructField("last_access", T.LongType()),
    T.StructField("warmed", T.BooleanType()),
    T.StructField("class_count", T.LongType()),
])

JAR_MTIME = T.StructType([
    T.StructField("jar_path", T.StringType()),
    T.StructField("mtime_ns", T.LongType()),
])

SIMPLE_NAMES = T.StructType([
    T.StructField("simple_name", T.StringType()),
    T.StructField("fqn", T.StringType()),
    T.StructField("jar_path", T.StringType()),
    T.StructField("mtime_ns", T.LongType()),
])

MEMBER = T.StructType([
    T.StructField("declaration", T.StringType()),
    T.StructField("comment", T.StringType()),
])

CLASS_STRUCTURE = T.StructType([
    T.StructField("package", T.StringType()),
    T.StructField("imports", T.ArrayType(T.StringType())),
    T.StructField("class_declaration", T.StringType()),
    T.StructField("class_comment", T.StringType()),
    T.StructField("comments", T.ArrayType(T.StringType())),
    T.StructField("fields", T.ArrayType(MEMBER)),
    T.StructField("methods", T.ArrayType(MEMBER)),
])
