"""Column functions on class names, entry names and artifact paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Archive and source conventions
CLASS_SUFFIX = ".class"
JAVA_SUFFIX = ".java"
SOURCES_SUFFIX = "-sources.jar"
SPECIAL_SOURCES = ("package-info.java", "module-info.java")
SPECIAL_CLASSES = ("package-info", "module-info")


def strip_space(text: Column) -> Column:
    """Remove leading and trailing Unicode white space (``trim`` knows only blanks).

    The look-behind keeps long runs of white space inside a text linear.
    """
    return F.regexp_replace(text, r"(?U)^\s++|(?<!\s)\s++$", "")


def normalize_query(raw: Column) -> Column:
    """Turn a pasted ``import a.b. C ;`` line into the bare class name.

    ``import`` is removed as a plain prefix, no blank is required after it.
    """
    without_import = F.regexp_replace(strip_space(raw), r"^import", "")
    without_semicolons = F.regexp_replace(strip_space(without_import), r"(?<!;);++$", "")
    return F.regexp_replace(without_semicolons, r"(?U)\s+", "")


def is_qualified(name: Column) -> Column:
    """Whether a query names a package, which selects the registry-first plan."""
    return F.contains(name, F.lit("."))


def is_top_level_class(entry_name: Column) -> Column:
    """Class files outside inner classes; a ``$`` anywhere in the path excludes."""
    return F.endswith(entry_name, F.lit(CLASS_SUFFIX)) & ~F.contains(entry_name, F.lit("$"))


def class_of_entry(entry_name: Column) -> Column:
    """``org/a/B.class`` to ``org.a.B``; a repeated suffix is stripped as a whole."""
    return F.translate(F.regexp_replace(entry_name, r"(\.class)+$", ""), "/\\", "..")


def entry_of_class(fqn: Column) -> Column:
    """``org.a.B`` to ``org/a/B.class``."""
    return F.concat(F.translate(fqn, ".", "/"), F.lit(CLASS_SUFFIX))


def source_entry_of_class(fqn: Column) -> Column:
    """The ``.java`` entry holding a class; inner classes live in their outer file."""
    return F.concat(F.translate(F.substring_index(fqn, "$", 1), ".", "/"), F.lit(JAVA_SUFFIX))


def is_class_source(entry_name: Column) -> Column:
    special = F.lit(False)
    for suffix in SPECIAL_SOURCES:
        special = special | F.endswith(entry_name, F.lit(suffix))
    return F.endswith(entry_name, F.lit(JAVA_SUFFIX)) & ~special


def class_of_source_entry(entry_name: Column) -> Column:
    """Class name implied by the path of a ``.java`` entry."""
    return F.translate(F.regexp_replace(entry_name, r"\.java$", ""), "/\\", "..")


def version_of_path(jar_path: Column) -> Column:
    """Name of the directory holding the artifact; NULL when there is none."""
    return F.nullif(F.try_element_at(F.split(jar_path, "/"), F.lit(-2)), F.lit(""))


def is_artifact_path(path: Column) -> Column:
    """Extension is exactly ``jar`` and the file name has a stem."""
    return F.rlike(path, F.lit(r"(^|/)[^/]+\.jar$"))


def sources_jar_path(jar_path: Column) -> Column:
    """Sibling ``<stem>-sources.jar``; NULL for other files and for sources jars."""
    return F.when(
        is_artifact_path(jar_path) & ~F.endswith(jar_path, F.lit(SOURCES_SUFFIX)),
        F.regexp_replace(jar_path, r"\.jar$", SOURCES_SUFFIX),
    )


def search_prefixes(fqn: Column) -> Column:
    """Package directories to search, narrowest first, never a single segment.

    Empty for names of fewer than three segments, which are searched at the root.
    """
    parts = F.split(fqn, r"\.")
    longest = F.greatest(F.size(parts) - 1, F.lit(2))
    return F.when(
        F.size(parts) >= 3,
        F.transform(
            F.sequence(longest, F.lit(2), F.lit(-1)),
            lambda n: F.array_join(F.slice(parts, 1, n), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))


def parent_directories(jar_path: Column) -> Column:
    """All directories above a path, as ``a``, ``a/b``, ..."""
    parts = F.split(jar_path, "/")
    return F.when(
        F.size(parts) >= 2,
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
            lambda n: F.array_join(F.slice(parts, 1, n), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))


def group_directory(group: str) -> str:
    """``org.a`` to ``org/a``."""
    return group.replace(".", "/")


def source_key(fqn: Column, jar_path: Column) -> Column:
    """Display form of the cache key; joins use the two columns."""
    return F.concat_ws("::", fqn, jar_path)
