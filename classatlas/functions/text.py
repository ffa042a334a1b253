"""Column functions on source text: splitting, naming, hashing, white space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from classatlas.functions.names import class_of_source_entry, strip_space

# Banner that opens every class in decompiler output, and the
# keywords that announce a type, in the order in which they are tried
DECOMPILED_BANNER = "/*\n * Decompiled with CFR"
TYPE_KEYWORDS = ("class ", "interface ", "enum ", "record ", "@interface ")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a costly expression once inside a larger one."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unix_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def collapse_space(text: Column) -> Column:
    """Every run of white space becomes one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def type_name_of_line(line: Column) -> Column:
    """Type announced by one trimmed line, comments included."""

    def after(keyword: str) -> Column:
        rest = F.substring_index(line, keyword, 1)
        tail = F.substr(line, F.length(rest) + F.lit(len(keyword) + 1))
        token = F.regexp_replace(F.regexp_extract(tail, r"(?U)^\s*(\S+)", 1), r"(?<!\{)\{++$", "")
        return F.when(
            F.contains(line, F.lit(keyword)), F.nullif(F.substring_index(token, "<", 1), F.lit(""))
        )

    return F.coalesce(*[after(keyword) for keyword in TYPE_KEYWORDS])


def _package_of_line(line: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(line, r"^(package )+", ""), r"(?<!;);++$", "")
    return F.when(F.startswith(line, F.lit("package ")), F.nullif(strip_space(name), F.lit("")))


def _first_not_null(items: Column, of: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(F.transform(items, of), lambda x: x.isNotNull()), F.lit(0))


def _may_name_type(line: Column) -> Column:
    found = F.contains(line, F.lit(TYPE_KEYWORDS[0]))
    for keyword in TYPE_KEYWORDS[1:]:
        found = found | F.contains(line, F.lit(keyword))
    return found


def extract_class_name(text: Column) -> Column:
    """``package.Type`` from the first package line and the first type line.

    Lines that cannot name anything are dropped by a cheap test before the
    per-line extraction runs.
    """
    def package(lines: Column) -> Column:
        return _first_not_null(
            F.filter(lines, lambda x: F.contains(x, F.lit("package "))),
            lambda x: _package_of_line(strip_space(x)),
        )

    def kind(lines: Column) -> Column:
        return _first_not_null(
            F.filter(lines, _may_name_type), lambda x: type_name_of_line(strip_space(x))
        )

    def named(lines: Column) -> Column:
        return let(kind(lines), lambda k: F.when(k.isNotNull(), F.concat_ws(".", package(lines), k)))

    return let(F.split(text, "\n"), named)


def class_of_source(text: Column, entry_name: Column) -> Column:
    """Name found in the text, else the one implied by the entry path."""
    return F.coalesce(extract_class_name(text), class_of_source_entry(entry_name))


def split_decompiled(output: Column) -> Column:
    """Decompiler output as ``array<struct<class_name, content, content_hash>>``.

    Text before the first banner is dropped and pieces without a nameable class
    are dropped; output without any banner is one class, kept untrimmed.
    """
    def pieces(text: Column) -> Column:
        return let(
            F.split(text, r"\Q" + DECOMPILED_BANNER + r"\E"),
            lambda parts: F.when(F.size(parts) == 1, parts).otherwise(
                F.transform(
                    F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
                    lambda p: strip_space(F.concat(F.lit(DECOMPILED_BANNER), p)),
                )
            ),
        )

    named = F.transform(
        let(unix_newlines(output), pieces),
        lambda p: F.struct(extract_class_name(p).alias("class_name"), p.alias("content")),
    )
    return F.transform(
        F.filter(named, lambda c: c["class_name"].isNotNull()),
        lambda c: F.struct(
            c["class_name"].alias("class_name"),
            c["content"].alias("content"),
            content_hash(c["content"]).alias("content_hash"),
        ),
    )


def content_for_class(output: Column, fqn: Column) -> Column:
    """The piece of decompiler output for one class, else the whole output."""
    match = F.filter(split_decompiled(output), lambda c: c["class_name"] == fqn)
    return F.coalesce(F.get(match, F.lit(0))["content"], output)
