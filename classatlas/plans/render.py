"""Output shapes of a lookup."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classatlas.operators import resolve
from classatlas.plans.engine import Atlas, Found

# Names of the formats
FORMATS = ("json", "text", "code", "structure")


def version_json() -> Column:
    """One version as JSON without its text, NULLs spelled out."""
    return F.to_json(
        F.struct("version", "jar_path", "content_hash", "cache_hit", "source", "lookup_source"),
        {"ignoreNullFields": "false"},
    )


def text_line() -> Column:
    """One version as a line of the plain summary.

    Fixed values: the wording of the line and the spelling of a version.
    """
    version = F.when(F.col("version").isNull(), F.lit("None")).otherwise(
        F.concat(F.lit('Some("'), F.col("version"), F.lit('")'))
    )
    return F.concat(
        F.lit("- version: "), version,
        F.lit(", source: "), F.col("source"),
        F.lit(", lookup_source: "), F.col("lookup_source"),
        F.lit(", cache_hit: "), F.col("cache_hit").cast("string"),
        F.lit(", jar: "), F.col("jar_path"),
    )


def code(found: Found) -> str:
    """Text of the default version; the other versions' texts stay where they are."""
    choice = resolve.default_version(found.versions)
    row = found.versions.join(choice.select("jar_path"), "jar_path", "left_semi").select("content").first()
    if row is None:
        raise LookupError("No available source result")
    return row["content"] or ""


def _drop_missing(structure: dict | None) -> dict | None:
    if structure is None:
        return None
    for key in ("class_comment", "comments"):
        if not structure.get(key):
            structure.pop(key, None)
    for member in structure["fields"] + structure["methods"]:
        if member.get("comment") is None:
            member.pop("comment", None)
    return structure


def _rows(frame: DataFrame) -> Iterator[dict]:
    """Rows one at a time, in order; only one partition is held at once."""
    for row in frame.toLocalIterator():
        yield row.asDict(recursive=True)


def lines(atlas: Atlas, found: Found, style: str, elapsed_ms: int) -> Iterator[str]:
    """The report line by line."""
    if style == "code":
        yield code(found)
        return
    matched = found.versions.count()
    if style == "text":
        yield f"class_name: {found.class_name}"
        yield f"matched_jars: {matched}"
        yield f"duration_ms: {elapsed_ms}"
        for row in _rows(found.versions.select(text_line().alias("line"))):
            yield row["line"]
        return
    header = {"class_name": found.class_name}
    if style == "json":
        header["scanned_root"] = found.scanned_root
        rows = _rows(found.versions.drop("fqn"))
    else:
        rows = _rows(atlas.structures(found).drop("fqn"))
    header |= {"matched_jars": matched, "duration_ms": elapsed_ms}
    yield json.dumps(header, indent=2, ensure_ascii=False)[:-2] + ',\n  "versions": ['
    for number, row in enumerate(rows):
        if "structure" in row and _drop_missing(row["structure"]) is None:
            row.pop("structure")
        body = json.dumps(row, indent=2, ensure_ascii=False).replace("\n", "\n    ")
        yield ("    " if number == 0 else "    ,") + body
    yield "  ]\n}"


def document(summary: DataFrame, name: str | None, items: DataFrame | None) -> Iterator[str]:
    """One JSON document: the only row of a summary, with ``items`` as a list inside."""
    head = json.dumps(summary.first().asDict(recursive=True), indent=2, ensure_ascii=False)
    if items is None:
        yield head
        return
    yield head[:-2] + f',\n  {json.dumps(name)}: ['
    for number, row in enumerate(_rows(items)):
        yield ("    " if number == 0 else "    ,") + json.dumps(row, ensure_ascii=False)
    yield "  ]\n}"


def write(report: Iterator[str], output: str | None) -> None:
    """To standard output, or to a file whose folders are created; lines are written as they come."""
    if output is None:
        for line in report:
            print(line, end="" if line.endswith("\n") else "\n")
        return
    folder = os.path.dirname(output)
    if folder:
        os.makedirs(folder, exist_ok=True)
    with open(output, "w", encoding="utf-8") as target:
        for number, line in enumerate(report):
            target.write(("\n" if number else "") + line)
