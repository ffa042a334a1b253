"""The verbs end to end on generated repositories."""

from __future__ import annotations

import json
import os

import pytest

from classatlas.operators import hotspot
from classatlas.plans import engine as engine_module
from classatlas.plans import render
from classatlas.plans.engine import Atlas, ClassNotFound, DecompileError
from classatlas.sources.archives import read_entry_names
from classatlas.sources.decompile import Decompiler

BANNER = "/*\n * Decompiled with CFR 0.152.\n */\n"
TOOL_OUTPUT = (
    BANNER + "package net.harbor;\n\npublic class Quay {\n}\n" + BANNER + "package net.harbor;\n\npublic class Tide {\n}\n"
)


@pytest.fixture()
def repository(tmp_path, jar):
    """Two versions of one artifact, the second with sources."""
    root = tmp_path / "repository"
    base = root / "net/harbor/dock"
    for version in ("2.4", "2.5"):
        jar(base / version / f"dock-{version}.jar", ("net/harbor/Quay.class", b""), ("net/harbor/Tide.class", b""))
    jar(
        base / "2.5/dock-2.5-sources.jar",
        ("net/harbor/Quay.java", "package net.harbor;\n\n/** Doc. */\npublic class Quay { int x; }\n"),
        ("net/harbor/Tide.java", "package net.harbor;\npublic class Tide {}\n"),
    )
    return root


@pytest.fixture()
def atlas(spark, tmp_path, repository, fake_java):
    java, calls = fake_java(TOOL_OUTPUT)
    engine = Atlas(spark, str(tmp_path / "store"), str(repository), Decompiler("tool.jar", java))
    engine.calls = calls
    return engine


def rows(frame):
    return [row.asDict(recursive=True) for row in frame.collect()]


def test_find_reads_sources_and_decompiles_the_rest(atlas):
    found = atlas.find("import net.harbor. Quay ;")
    versions = rows(found.versions)
    assert found.class_name == "net.harbor.Quay"
    assert [(v["version"], v["source"], v["cache_hit"], v["lookup_source"]) for v in versions] == [
        ("2.4", "decompiled", False, "scan"), ("2.5", "sources-jar", False, "scan"),
    ]
    assert versions[0]["content"].endswith("public class Quay {\n}")
    call = open(atlas.calls).read().split()
    assert call[:3] == ["-jar", "tool.jar", "--extraclasspath"]
    assert call[4:] == ["net.harbor.Quay", "--silent", "true", "--comments", "false"]


def test_find_after_backfill_hits_registry_and_cache(atlas):
    atlas.backfill(atlas.find("net.harbor.Quay")).collect()
    again = rows(atlas.find("net.harbor.Quay").versions)
    assert all(v["cache_hit"] and v["lookup_source"] == "registry" for v in again)
    sibling = rows(atlas.find("net.harbor.Tide").versions)
    assert [v["source"] for v in sibling] == ["decompiled", "sources-jar"]
    assert all(v["cache_hit"] for v in sibling)
    counts, top = atlas.stats()
    assert rows(counts) == [{
        "db_path": atlas.store.path, "source_entries": 4, "indexed_classes": 2, "cataloged_jars": 2,
        "loaded_jars": 2, "hotspot_jars": 2, "warmed_jars": 2, "write_buffer_pending": 0,
        "warmup_threshold": 2, "warmup_pending_tasks": 0,
    }]
    assert [r["access_count"] for r in rows(top)] == [0, 0]
    assert rows(atlas.backfill(atlas.find("net.harbor.Quay"))) == []


def test_version_filter_and_missing_class(atlas):
    assert [v["version"] for v in rows(atlas.find("net.harbor.Quay", "2.5").versions)] == ["2.5"]
    with pytest.raises(ClassNotFound):
        atlas.find("net.harbor.Quay", "9")
    with pytest.raises(ClassNotFound):
        atlas.find("net.harbor.Missing")
    with pytest.raises(ClassNotFound):
        atlas.find("Missing")


def test_narrow_tier_hides_wider_matches(atlas, repository, jar):
    jar(repository / "mirror/9.0/copy-9.0.jar", ("net/harbor/Quay.class", b""), ("org/only/far/C.class", b""))
    jar(repository / "org/only/near.txt/x-1.jar", ("org/other/X.class", b""))
    assert [v["version"] for v in rows(atlas.find("net.harbor.Quay").versions)] == ["2.4", "2.5"]
    with pytest.raises(ClassNotFound):
        atlas.find("net.harbor.Quay", "9.0")
    assert atlas.scopes("org.only.far.C") == [str(repository / "org/only")]
    far = atlas.find("org.only.far.C")
    assert far.scanned_root == str(repository)
    assert [v["version"] for v in rows(far.versions)] == ["9.0"]


def test_simple_name_takes_most_archives_then_largest_name(atlas, repository, jar):
    jar(repository / "x/1/x-1.jar", ("com/a/Widget.class", b""), ("com/b/Widget.class", b""))
    jar(repository / "y/1/y-1.jar", ("com/c/Widget.class", b""))
    assert atlas.find("Widget").class_name == "com.c.Widget"
    jar(repository / "z/1/z-1.jar", ("com/a/Widget.class", b""))
    assert atlas.find("Widget").class_name == "com.a.Widget"
    assert atlas.find("Quay").class_name == "net.harbor.Quay"


def test_only_changed_archives_are_opened_for_simple_names(atlas, repository, jar, monkeypatch):
    opened = []

    def reading(artifacts, **choice):
        opened.append(sorted(os.path.basename(r["jar_path"]) for r in artifacts.select("jar_path").collect()))
        return read_entry_names(artifacts, **choice)

    monkeypatch.setattr(engine_module, "read_entry_names", reading)
    assert atlas.find("Quay").class_name == "net.harbor.Quay"
    assert opened == [["dock-2.4.jar", "dock-2.5-sources.jar", "dock-2.5.jar"]]
    assert atlas.find("Tide").class_name == "net.harbor.Tide" and len(opened) == 1
    path = repository / "net/harbor/dock/2.4/dock-2.4.jar"
    jar(path, ("net/harbor/New.class", b""))
    os.utime(path, ns=(10**18, 10**18))
    assert [v["version"] for v in rows(atlas.find("Quay").versions)] == ["2.5"]
    assert opened[1:] == [["dock-2.4.jar"]]
    os.remove(repository / "net/harbor/dock/2.5/dock-2.5.jar")
    with pytest.raises(ClassNotFound):
        atlas.find("Quay")
    assert len(opened) == 2
    atlas.store.compact("simple_names")
    assert {r["fqn"] for r in rows(atlas.store.simple_names())} == {"net.harbor.New", "net.harbor.Quay", "net.harbor.Tide"}
    # a store that stays locked answers as well, it only forgets what was read
    atlas.store.wait = 0.1
    jar(repository / "new/1/new-1.jar", ("org/x/y/Fresh.class", b""))
    atlas.store._lock()
    assert rows(atlas._hits(atlas.spark.createDataFrame([("Fresh", None)], "name string, wanted string")))[0]["fqn"] == "org.x.y.Fresh"
    atlas.store.release()
    assert len(opened) == 3


def test_index_answers_simple_names(atlas, monkeypatch):
    atlas.index().collect()
    monkeypatch.setattr(engine_module, "read_entry_names", lambda *a, **k: pytest.fail("opened an archive"))
    assert atlas.find("Tide").class_name == "net.harbor.Tide"


def test_find_all_answers_many_requests(atlas, repository, jar, spark):
    jar(repository / "net/harbor/quay/9/quay-9.jar", ("net/harbor/Quay.class", b""), ("net/harbor/Quay$Inner.class", b""))
    jar(repository / "mirror/9.0/copy-9.0.jar", ("org/only/far/C.class", b""))
    atlas.load(str(repository / "net/harbor/dock/2.5/dock-2.5.jar")).collect()
    asked = [("import net.harbor.Quay;", None), ("net.harbor.Quay", None), ("net.harbor.Quay", "2.4"), ("net.harbor.Quay", "7"), ("Tide", "2.5"),
             ("Tide", None), ("org.only.far.C", None), ("no.such.Name", None), ("Nothing", None), (" ; ", None), (None, None), ("net.harbor.Quay$Inner", None)]
    answers, outcome = atlas.find_all(spark.createDataFrame(asked, "raw string, wanted string"))
    assert {(r["name"], r["wanted"]): r["versions"] for r in rows(outcome)} == {
        ("net.harbor.Quay", None): 1, ("net.harbor.Quay", "2.4"): 1, ("net.harbor.Quay", "7"): 0, ("Tide", "2.5"): 1, ("Tide", None): 2,
        ("org.only.far.C", None): 1, ("no.such.Name", None): 0, ("Nothing", None): 0, ("net.harbor.Quay$Inner", None): 1}
    found = sorted(((r["name"], r["version"], r["lookup_source"], r["source"], r["cache_hit"]) for r in rows(answers)), key=str)
    assert found == [
        ("Tide", "2.4", "scan", "decompiled", False), ("Tide", "2.5", "scan", "sources-jar", True), ("Tide", "2.5", "scan", "sources-jar", True),
        ("net.harbor.Quay$Inner", "9", "scan", "decompiled", False), ("net.harbor.Quay", "2.4", "scan", "decompiled", False),
        ("net.harbor.Quay", "2.5", "registry", "sources-jar", True), ("org.only.far.C", "9.0", "scan", "decompiled", False)]
    assert atlas.find_all(spark.createDataFrame([], "raw string, wanted string"))[1].count() == 0


def test_unreadable_sources_fall_through_and_failing_tool_aborts(spark, tmp_path, repository, fake_java):
    (repository / "net/harbor/dock/2.5/dock-2.5-sources.jar").write_bytes(b"broken")
    java, _ = fake_java("", code=3, error="boom")
    failing = Atlas(spark, str(tmp_path / "s"), str(repository), Decompiler("tool.jar", java))
    with pytest.raises(DecompileError, match="boom"):
        failing.find("net.harbor.Quay")
    loads = rows(failing.load(str(repository / "net/harbor/dock/2.5/dock-2.5.jar")))
    assert [(r["failed"], r["classes_loaded"]) for r in loads] == [(True, 0)]
    assert failing.store.sources().count() == 0 and failing.store.loaded().count() == 0


def test_without_tool_only_sources_are_served(spark, tmp_path, repository):
    plain = Atlas(spark, str(tmp_path / "s"), str(repository))
    versions = rows(plain.find("net.harbor.Quay").versions)
    assert [(v["version"], v["content"] is None) for v in versions] == [("2.4", True), ("2.5", False)]


def test_index_is_incremental(atlas, repository, jar):
    (repository / "broken.jar").write_bytes(b"x")
    jar(repository / "empty.jar")
    first = rows(atlas.index())[0]
    assert first == {
        "scanned_jars": 5, "cataloged_jars_new": 4, "failed_jars": 1, "indexed_classes": 4,
        "root": str(repository),
    }
    second = rows(atlas.index())[0]
    assert (second["cataloged_jars_new"], second["failed_jars"], second["indexed_classes"]) == (0, 1, 0)
    found = rows(atlas.find("net.harbor.Quay").versions)
    assert {v["lookup_source"] for v in found} == {"registry"}
    # the registry only grows; an artifact that is gone is dropped on reading
    os.remove(repository / "net/harbor/dock/2.4/dock-2.4.jar")
    assert [v["version"] for v in rows(atlas.find("net.harbor.Quay").versions)] == ["2.5"]


def test_load_once_then_skip(atlas, repository):
    path = str(repository / "net/harbor/dock/2.5/dock-2.5.jar")
    assert rows(atlas.load(path)) == [
        {"jar_path": path, "classes_loaded": 2, "skipped": False, "failed": False, "gaps": 0}
    ]
    assert rows(atlas.load(path)) == [
        {"jar_path": path, "classes_loaded": 0, "skipped": True, "failed": False, "gaps": 0}
    ]
    assert not os.path.exists(atlas.calls)


def test_partial_sources_are_completed_by_the_tool(atlas, repository, jar):
    jar(
        repository / "net/harbor/dock/2.4/dock-2.4-sources.jar",
        ("net/harbor/Quay.java", "package net.harbor;\nclass Quay { /* original */ }\n"),
    )
    path = str(repository / "net/harbor/dock/2.4/dock-2.4.jar")
    assert rows(atlas.load(path))[0]["classes_loaded"] == 2
    # the tool ran once, for the whole archive
    assert open(atlas.calls).read().split() == ["-jar", "tool.jar", path, "--silent", "true", "--comments", "false"]
    kinds = {r["fqn"]: (r["source"], r["content"]) for r in rows(atlas.store.sources())}
    assert kinds["net.harbor.Quay"][0] == "sources-jar" and "original" in kinds["net.harbor.Quay"][1]
    assert kinds["net.harbor.Tide"][0] == "decompiled"


def test_warmup_choices(atlas, repository, spark):
    with pytest.raises(ValueError):
        atlas.warmup()
    summary, loads = atlas.warmup(group="net.harbor", limit=2)
    assert rows(summary)[0]["targets"] == 2
    assert [os.path.basename(r["jar_path"]) for r in rows(loads.orderBy("jar_path"))] == [
        "dock-2.4.jar", "dock-2.5-sources.jar",
    ]
    assert rows(atlas.warmup(group="no.such")[0])[0]["targets"] == 0
    path = str(repository / "net/harbor/dock/2.5/dock-2.5.jar")
    log = spark.createDataFrame(
        [(path, 10, 1, False, 0), (path, 11, 2, False, 0)],
        "jar_path string, epoch long, order long, warmed boolean, class_count long",
    )
    wanted = rows(atlas.record_access(log).orderBy("order"))
    assert [(r["priority"], r["mode"]) for r in wanted] == [
        (hotspot.NORMAL, hotspot.TOP_LEVEL_ONLY), (hotspot.HIGH, hotspot.ALL_CLASSES),
    ]
    summary, loads = atlas.warmup(hot=True)
    assert [r["jar_path"] for r in rows(loads)] == [path]
    assert rows(atlas.warmup(hot=True)[0])[0]["targets"] == 0
    assert rows(atlas.record_access(log)) == []


def test_warm_queue_honours_mode_and_exclusions(atlas, repository, spark):
    path = str(repository / "net/harbor/dock/2.5/dock-2.5.jar")
    tasks = spark.createDataFrame(
        [(path, 1, 0, hotspot.TOP_LEVEL_ONLY), (path, 2, 1, hotspot.ALL_CLASSES)],
        "jar_path string, priority long, seq long, mode string",
    )
    excluded = spark.createDataFrame([("net.harbor.Tide",)], "fqn string")
    done = rows(atlas.warm(tasks, excluded))
    assert [(r["classes_loaded"], r["failed"]) for r in done] == [(1, False)]
    assert [r["fqn"] for r in rows(atlas.store.sources())] == ["net.harbor.Quay"]
    assert atlas.store.loaded().count() == 0
    assert rows(atlas.store.hotspots())[0]["warmed"]


def test_update_follows_modification_times(atlas, repository, jar):
    first = rows(atlas.update())[0]
    assert (first["scanned_jars"], first["changed_jars"], first["indexed_classes"]) == (3, 3, 4)
    assert rows(atlas.update())[0]["changed_jars"] == 0
    path = repository / "net/harbor/dock/2.4/dock-2.4.jar"
    later = os.stat(path).st_mtime_ns + 5_000_000
    jar(path, ("net/harbor/New.class", b""))
    os.utime(path, ns=(later, later))
    assert rows(atlas.update())[0]["changed_jars"] == 1
    assert {r["fqn"] for r in rows(atlas.store.registry())} == {"net.harbor.Quay", "net.harbor.Tide", "net.harbor.New"}
    os.utime(path, ns=(later - 10**9, later - 10**9))
    assert rows(atlas.update())[0]["changed_jars"] == 0
    broken = repository / "broken.jar"
    broken.write_bytes(b"x")
    assert rows(atlas.update())[0]["failed_jars"] == 1
    assert rows(atlas.update())[0]["changed_jars"] == 0


def test_structures_prefer_the_sources_archive(atlas):
    atlas.backfill(atlas.find("net.harbor.Quay")).collect()
    found = atlas.find("net.harbor.Quay")
    shown = {r["version"]: r for r in rows(atlas.structures(found))}
    assert shown["2.5"]["structure_source"] == "sources-jar"
    assert shown["2.5"]["structure"]["class_comment"] == "/** Doc. */"
    assert shown["2.5"]["structure"]["fields"] == [{"declaration": "int x;", "comment": None}]
    assert shown["2.4"]["structure_source"] == "decompiled"


def test_formats(atlas, tmp_path, capsys):
    found = atlas.find("net.harbor.Quay")
    report = json.loads("\n".join(render.lines(atlas, found, "json", 5)))
    assert report["matched_jars"] == 2 and report["class_name"] == "net.harbor.Quay"
    assert [v["version"] for v in report["versions"]] == ["2.4", "2.5"]
    plain = list(render.lines(atlas, found, "text", 5))
    assert plain[:3] == ["class_name: net.harbor.Quay", "matched_jars: 2", "duration_ms: 5"]
    assert plain[3].startswith('- version: Some("2.4"), source: decompiled, lookup_source: scan, cache_hit: false, jar: ')
    assert "int x;" in "".join(render.lines(atlas, found, "code", 5))
    structure = json.loads("\n".join(render.lines(atlas, found, "structure", 5)))
    assert structure["versions"][1]["structure"]["fields"] == [{"declaration": "int x;"}]
    assert "class_comment" not in structure["versions"][0]["structure"]
    target = tmp_path / "new/folder/out.txt"
    render.write(iter(["a", "b"]), str(target))
    assert target.read_text() == "a\nb"
    render.write(iter(["a", "b\n"]), None)
    assert capsys.readouterr().out == "a\nb\n"


def test_clear(atlas):
    atlas.clear()
    atlas.index().collect()
    assert atlas.store.registry().count() > 0
    atlas.clear()
    assert atlas.store.registry().count() == 0


def test_artifact_with_gaps_is_not_marked_as_loaded(spark, tmp_path, repository, jar, fake_java):
    """Without a tool some classes have no text; a later load with one brings them."""
    jar(
        repository / "net/harbor/dock/2.4/dock-2.4-sources.jar",
        ("net/harbor/Quay.java", "package net.harbor;\nclass Quay { /* original */ }\n"),
    )
    path = str(repository / "net/harbor/dock/2.4/dock-2.4.jar")
    plain = Atlas(spark, str(tmp_path / "s"), str(repository))
    loaded = rows(plain.load(path))
    assert [(r["classes_loaded"], r["skipped"], r["failed"], r["gaps"]) for r in loaded] == [(1, False, False, 1)]
    assert plain.store.loaded().count() == 0 and not rows(plain.store.hotspots())
    java, _ = fake_java(TOOL_OUTPUT)
    again = rows(Atlas(spark, str(tmp_path / "s"), str(repository), Decompiler("tool.jar", java)).load(path))
    assert [(r["classes_loaded"], r["skipped"], r["gaps"]) for r in again] == [(2, False, 0)]
    assert {r["fqn"] for r in rows(plain.store.sources())} == {"net.harbor.Quay", "net.harbor.Tide"}
    assert rows(plain.load(path))[0]["skipped"]


def test_slow_tool_is_ended(tmp_path):
    script = tmp_path / "java"
    script.write_text("#!/bin/sh\nexec sleep 60\n")
    script.chmod(0o755)
    output, error = Decompiler("tool.jar", str(script), timeout=0.2).run("a.jar", None)
    assert output is None and "no end" in error
