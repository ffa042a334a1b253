"""Command line: ``python -m classatlas [--m2 DIR] [--db DIR] [--cfr JAR] VERB ...``."""

from __future__ import annotations

import argparse
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from classatlas.plans import render
from classatlas.plans.engine import Atlas
from classatlas.session import configure
from classatlas.sources.decompile import Decompiler

VERBS = ("find", "load", "warmup", "index", "stats", "clear", "help")


def parse(arguments: list[str]) -> argparse.Namespace:
    """Options of all verbs may stand anywhere; a first bare word that is no verb is looked up."""
    shared = argparse.ArgumentParser(add_help=False, allow_abbrev=False)
    shared.add_argument("--m2", metavar="PATH")
    shared.add_argument("--cfr", metavar="FILE", default=os.environ.get("CFR_JAR"))
    shared.add_argument("--db", metavar="PATH", default=str(Path.home() / ".local/share/classatlas/store"))
    options, rest = shared.parse_known_args(arguments)
    rest = rest[1:] if rest[:1] == ["--"] else rest
    if rest and rest[0] not in VERBS and not rest[0].startswith("-"):
        rest = ["find", *rest]
    return _verbs(shared).parse_args(rest, options)


def _verbs(shared: argparse.ArgumentParser) -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="classatlas", parents=[shared])
    verbs = top.add_subparsers(dest="verb", required=True)
    find = verbs.add_parser("find")
    find.add_argument("class_name")
    find.add_argument("-f", "--format", choices=render.FORMATS, default="json")
    find.add_argument("--code-only", action="store_true")
    find.add_argument("-v", "--version")
    find.add_argument("-o", "--output")
    verbs.add_parser("load").add_argument("jar_path")
    warm = verbs.add_parser("warmup")
    warm.add_argument("jar_path", nargs="?")
    warm.add_argument("--hot", action="store_true")
    warm.add_argument("--group")
    warm.add_argument("--top", type=int, default=20)
    warm.add_argument("--limit", type=int)
    verbs.add_parser("index").add_argument("--path")
    verbs.add_parser("stats")
    verbs.add_parser("clear")
    return top


def run(spark: SparkSession, options: argparse.Namespace) -> None:
    tool = Decompiler(options.cfr) if options.cfr else None
    atlas = Atlas(configure(spark), options.db, options.m2, tool)
    started = time.monotonic()
    if options.verb == "find":
        found = atlas.find(options.class_name, options.version)
        elapsed = int((time.monotonic() - started) * 1000)
        style = "code" if options.code_only else options.format
        render.write(render.lines(atlas, found, style, elapsed), options.output)
        atlas.record_lookup(found)
        atlas.backfill(found).write.format("noop").mode("overwrite").save()
    elif options.verb == "clear":
        atlas.clear()
    else:
        if options.verb == "load":
            summary, name, items = atlas.load(options.jar_path), None, None
        elif options.verb == "warmup":
            summary, loads = atlas.warmup(
                jar_path=options.jar_path, hot=options.hot, group=options.group,
                top=options.top, limit=options.limit,
            )
            name, items = "loaded_jars", loads
        elif options.verb == "index":
            summary, name, items = atlas.index(options.path), None, None
        else:
            summary, items = atlas.stats()
            name = "hotspots"
        if options.verb != "stats":
            elapsed = int((time.monotonic() - started) * 1000)
            summary = summary.withColumn("duration_ms", F.lit(elapsed).cast("long"))
        render.write(render.document(summary, name, items), None)


def main(arguments: list[str] | None = None) -> None:
    options = parse(arguments if arguments is not None else sys.argv[1:])
    spark = SparkSession.builder.appName("classatlas").getOrCreate()
    run(spark, options)


if __name__ == "__main__":
    main()
