"""Listing and reading real archives."""

from __future__ import annotations

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from classatlas.operators import catalog, content
from classatlas.plans import standin
from classatlas.sources import zip_ranges
from classatlas.sources.archives import read_entry_names, read_source_entries, read_sources
from classatlas.sources.artifacts import list_artifacts


def paths(frame, column="jar_path"):
    return sorted(row[column] for row in frame.select(column).collect())


def test_listing_finds_every_archive_path(spark, tmp_path, jar):
    jar(tmp_path / "a/1.0/a-1.0.jar")
    jar(tmp_path / "a/1.0/a-1.0-sources.jar")
    jar(tmp_path / ".hidden/_x/b.jar")
    (tmp_path / "dir.jar").mkdir()
    jar(tmp_path / "dir.jar/in.jar")
    (tmp_path / "c.JAR").write_text("")
    (tmp_path / ".jar").write_text("")
    (tmp_path / "d.jar.txt").write_text("")
    os.symlink(tmp_path / "a", tmp_path / "link")
    found = list_artifacts(spark, str(tmp_path))
    assert paths(found) == sorted(str(tmp_path / p) for p in (
        "a/1.0/a-1.0.jar", "a/1.0/a-1.0-sources.jar", ".hidden/_x/b.jar", "dir.jar", "dir.jar/in.jar",
    ))
    row = found.where(F.endswith("jar_path", F.lit("b.jar"))).first()
    assert row["mtime_ns"] == os.stat(tmp_path / ".hidden/_x/b.jar").st_mtime_ns


def test_listing_of_nothing(spark, tmp_path):
    assert paths(list_artifacts(spark, str(tmp_path / "missing"))) == []
    (tmp_path / "empty").mkdir()
    assert paths(list_artifacts(spark, str(tmp_path / "empty"))) == []


def test_catalog_of_archives(spark, tmp_path, jar):
    good = jar(
        tmp_path / "good.jar",
        ("net/harbor/A.class", b""), ("net/harbor/A$Inner.class", b""), ("META-INF/MANIFEST.MF", b""),
        ("B.class", b""), ("org/C.class.class", b""), ("META-INF/versions/9/org/D.class", b""),
        ("module-info.class", b""),
    )
    empty = jar(tmp_path / "empty.jar")
    bad = str(tmp_path / "bad.jar")
    (tmp_path / "bad.jar").write_bytes(b"not a jar")
    gone = str(tmp_path / "gone.jar")
    entries = read_entry_names(spark.createDataFrame([(p,) for p in (good, empty, bad, gone)], "jar_path string"))
    assert paths(catalog.classes(entries), "fqn") == [
        "B", "META-INF.versions.9.org.D", "module-info", "net.harbor.A", "org.C",
    ]
    status = {row["jar_path"]: row["readable"] for row in catalog.archive_status(entries).collect()}
    assert status == {good: True, empty: True, bad: False, gone: False}


def test_probes(spark, tmp_path, jar):
    path = jar(
        tmp_path / "p.jar",
        ("org/spring/Component.class", b""), ("org/spring/Component$Inner.class", b""),
        ("org/other/Component.class", b""), ("Component.class", b""), ("org/spring/MyComponent.class", b""),
    )
    artifacts = spark.createDataFrame([(path,)], "jar_path string")
    wanted = spark.createDataFrame([("Component",)], "simple_name string")
    for entries in (read_entry_names(artifacts), read_entry_names(artifacts, suffix="/Component.class")):
        assert paths(catalog.by_simple_name(entries, wanted), "fqn") == ["org.other.Component", "org.spring.Component"]
    fqns = spark.createDataFrame([("org.spring.Component$Inner",), ("org.spring.Nope",), ("Component",)], "fqn string")
    assert paths(catalog.containing(read_entry_names(artifacts), fqns), "fqn") == [
        "Component", "org.spring.Component$Inner",
    ]
    exact = read_entry_names(artifacts, exact="Component.class").where("entry_idx >= 0")
    assert paths(exact, "entry_name") == ["Component.class"]


def test_sources_are_named_and_deduplicated(spark, tmp_path, jar):
    binary = str(tmp_path / "demo-1.0.jar")
    sources = jar(
        tmp_path / "demo-1.0-sources.jar",
        ("net/harbor/A.java", "package net.harbor;\r\npublic class A {}\r\n"),
        ("net/harbor/Z.java", "// first A again\npackage net.harbor;\npublic class A { int z; }\n"),
        ("net/harbor/package-info.java", "package net.harbor;"),
        ("net/harbor/Empty.java", "// none"),
        ("notes.txt", "class X"),
        ("net/harbor/Bad.java", b"package net.harbor;\nclass Bad { String s = \"\xff\"; }"),
    )
    pairs = spark.createDataFrame([(binary, sources)], "jar_path string, sources_path string")
    named = content.keep_first(content.readable(content.name_sources(read_sources(pairs))))
    texts = {row["fqn"]: row["content"] for row in named.collect()}
    assert set(texts) == {"net.harbor.A", "net.harbor.Empty", "net.harbor.Bad"}
    assert texts["net.harbor.A"] == "package net.harbor;\npublic class A {}\n"
    assert "�" in texts["net.harbor.Bad"]


def test_damaged_sources_count_as_absent(spark, tmp_path, jar):
    sources = jar(
        tmp_path / "x-sources.jar",
        ("a/A.java", "class A {}" * 200), ("a/B.java", "class B {}" * 200),
    )
    data = bytearray((tmp_path / "x-sources.jar").read_bytes())
    position = data.index(b"a/B.java") + 12
    data[position] ^= 0xFF
    (tmp_path / "x-sources.jar").write_bytes(bytes(data))
    pairs = spark.createDataFrame([("x.jar", sources)], "jar_path string, sources_path string")
    read = read_sources(pairs)
    assert sorted((r["entry_name"], r["error"] is None) for r in read.collect()) == [("a/A.java", True), ("a/B.java", False)]
    assert content.readable(content.name_sources(read)).count() == 0


def test_archives_by_ranges_equal_the_library(tmp_path, monkeypatch):
    """Directories and contents of archives of many forms, read through windows of any size."""
    import random
    import zipfile

    from classatlas.sources import zip_ranges

    draw, plain = random.Random(4), str(tmp_path / "plain.zip")
    with zipfile.ZipFile(plain, "w", zipfile.ZIP_DEFLATED) as archive:
        for k in range(60):
            archive.writestr(f"é{k}/n{k}.java", draw.randbytes(draw.choice([0, 1, 300, 9_000])), draw.choice([zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED]))
        archive.comment = b"a comment " * 9
    data = open(plain, "rb").read()
    (tmp_path / "prefixed.zip").write_bytes(b"#!/bin/sh\n" * 50 + data)
    with zipfile.ZipFile(tmp_path / "streamed.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        with archive.open("a.java", "w", force_zip64=True) as entry:
            entry.write(b"text" * 1000)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 5)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 2_000)
    with zipfile.ZipFile(tmp_path / "wide.zip", "w", zipfile.ZIP_STORED) as archive:
        for k in range(9):
            archive.writestr(f"{k}.java", draw.randbytes(900 * k))
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    monkeypatch.undo()
    for name in ("plain", "prefixed", "streamed", "wide", "empty"):
        path = str(tmp_path / f"{name}.zip")
        for window in (1, 100, 1 << 20):
            file = zip_ranges.RangeFile(path, window)
            entries = zip_ranges.directory(file)
            with zipfile.ZipFile(path) as archive:
                assert [(e.name, e.packed, e.size, e.checksum) for e in entries] == [
                    (i.filename, i.compress_size, i.file_size, i.CRC) for i in archive.infolist()]
                assert all(zip_ranges.content_of(file, e) == archive.read(archive.infolist()[e.index]) for e in entries)
    for broken in (b"", b"x" * 100, data[:-70], data[200:], data[:len(data) // 2], END_ONLY):
        (tmp_path / "broken.zip").write_bytes(broken)
        file = zip_ranges.RangeFile(str(tmp_path / "broken.zip"))
        with pytest.raises(zip_ranges.Damaged):
            for entry in zip_ranges.directory(file):
                zip_ranges.content_of(file, entry)
    first = zip_ranges.directory(zip_ranges.RangeFile(plain))[1]
    for wrong in (first._replace(flags=1), first._replace(method=99), first._replace(size=first.size + 1), first._replace(checksum=1), first._replace(place=3)):
        with pytest.raises(zip_ranges.Damaged):
            zip_ranges.content_of(zip_ranges.RangeFile(plain), wrong)


def test_large_archives_are_read_by_several_tasks(spark, tmp_path, jar, monkeypatch):
    from classatlas.sources import zip_ranges

    monkeypatch.setattr(zip_ranges, "STRETCH", 1000)
    jar(tmp_path / "b-sources.jar", *((f"a/C{k}.java", f"package a;\nclass C{k} {{ }} // {k * 7919} " * 20) for k in range(80)))
    (tmp_path / "bad-sources.jar").write_bytes(b"no archive")
    rows = [("b.jar", str(tmp_path / "b-sources.jar")), ("c.jar", f"file://{tmp_path}/b-sources.jar"), ("bad.jar", str(tmp_path / "bad-sources.jar")),
            ("none.jar", str(tmp_path / "none-sources.jar"))]
    read = read_sources(spark.createDataFrame(rows, "jar_path string, sources_path string"))
    found = read.withColumn("task", F.spark_partition_id()).collect()
    assert [(r["jar_path"], r["entry_idx"]) for r in found if r["error"]] == [("bad.jar", -1)]
    for jar_path in ("b.jar", "c.jar"):
        own = [r for r in found if r["jar_path"] == jar_path]
        assert sorted(r["entry_idx"] for r in own) == list(range(80)) and len({r["task"] for r in own}) > 1
    assert content.readable(content.name_sources(read)).count() == 160


END_ONLY = b"PK\x05\x06" + bytes(16) + b"\xff\xff"


def test_single_source_read(spark, tmp_path, jar):
    sources = jar(tmp_path / "y-sources.jar", ("a/A.java", "class A {\r\n}"))
    rows = [
        ("y.jar", sources, "a/A.java"), ("y2.jar", sources, "a/None.java"),
        ("z.jar", str(tmp_path / "none-sources.jar"), "a/A.java"),
    ]
    frame = spark.createDataFrame(rows, "jar_path string, sources_path string, entry_name string")
    found = read_source_entries(frame).collect()
    assert [(row["jar_path"], row["content"]) for row in found] == [("y.jar", "class A {\n}")]


def test_catalog_of_the_archives_shipped_with_spark(spark):
    """A realistic corpus, against a plain loop over the same files."""
    import glob
    import zipfile

    import pyspark

    folder = os.path.join(os.path.dirname(pyspark.__file__), "jars")
    expected, jars = 0, 0
    for path in glob.glob(f"{folder}/**/*.jar", recursive=True):
        jars += 1
        with zipfile.ZipFile(path) as archive:
            expected += sum(n.endswith(".class") and "$" not in n for n in archive.namelist())
    artifacts = list_artifacts(spark, folder)
    assert artifacts.count() == jars
    assert catalog.classes(read_entry_names(artifacts)).count() == expected


def test_only_missing_files_count_as_absent(tmp_path, monkeypatch):
    """A directory or archive that cannot be read for now must fail the task, not look empty."""
    import errno
    import os

    from classatlas.sources import archives, artifacts

    assert list(artifacts.children(str(tmp_path / "gone"))) == []

    def too_many(path):
        raise OSError(errno.EMFILE, "Too many open files", path)

    monkeypatch.setattr(os, "scandir", too_many)
    with pytest.raises(OSError):
        list(artifacts.children(str(tmp_path)))
    monkeypatch.setattr(archives.zipfile, "ZipFile", too_many)
    with pytest.raises(OSError):
        list(archives._entry_rows(str(tmp_path / "a.jar")))


def test_nested_directories_are_listed_once(spark, tmp_path, jar):
    from classatlas.sources.artifacts import disjoint

    for place in ("a/b/c/1.jar", "a/b/2.jar", "a/bc/3.jar", "d/4.jar"):
        jar(tmp_path / place)
    asked = [f"{tmp_path}/{p}" for p in ("a/b", "a/b/c", "a/b", "a/bc", "none")]
    roots = spark.createDataFrame([(p,) for p in asked], "path string")
    assert sorted(r["path"] for r in disjoint(roots).collect()) == sorted({asked[0], asked[3], asked[4]})
    assert [os.path.basename(p) for p in paths(list_artifacts(spark, roots))] == ["2.jar", "1.jar", "3.jar"]
    assert list_artifacts(spark, roots.limit(0)).count() == 0


def test_tool_output_is_cut_at_banners_as_it_comes():
    from classatlas.functions.text import DECOMPILED_BANNER as banner
    from classatlas.sources.decompile import split_at_banners

    head = banner + " 0.1.\n */\n"
    for text, pieces in [
        ("", [""]), ("no banner\r\nat all", ["no banner\nat all"]), ("noise" + head + "class A {}\r\n" + head + "é漢", [head + "class A {}\n", head + "é漢"]),
        (head + head, [head, head]), ("/*\n" + head[:8] + head + "x\r", [head + "x\r"]),
    ]:
        data = text.encode()
        for size in (1, 2, 7, 10_000):
            chunks = [data[k: k + size] for k in range(0, len(data), size)]
            assert list(split_at_banners(chunks)) == pieces
    assert list(split_at_banners([b"a\xff"])) == ["a\ufffd"]


def test_tool_failures_after_some_pieces(spark, tmp_path):
    from classatlas.functions.text import DECOMPILED_BANNER as banner
    from classatlas.sources.decompile import Decompiler, ToolFailed, decompile_archives

    def tool(script, **more):
        path = tmp_path / f"java{len(list(tmp_path.iterdir()))}"
        (tmp_path / "out").write_text(f"{banner} 1 */\nclass A {{}}\n{banner} 1 */\nclass B {{}}\n")
        path.write_text(f"#!/bin/sh\n{script}\n")
        path.chmod(0o755)
        return Decompiler("tool.jar", str(path), **more)

    out = f"cat {tmp_path}/out"
    assert len(list(tool(out).pieces("a.jar"))) == 2
    noisy = tool(f"{out}; head -c 3000000 /dev/zero | tr '\\0' x >&2; echo boom >&2; exit 3")
    for failing, message in ((noisy, "boom"), (tool(f"{out}; exec sleep 60", timeout=0.5), "no end"), (Decompiler("t", str(tmp_path / "none")), "Failed to execute")):
        with pytest.raises(ToolFailed, match=message):
            list(failing.pieces("a.jar"))
    rows = decompile_archives(spark.createDataFrame([("a.jar",), ("b.jar",)], "jar_path string"), noisy).collect()
    assert sorted((r["jar_path"], r["entry_idx"], r["error"] is None) for r in rows) == [
        (p, k, k < 2) for p in ("a.jar", "b.jar") for k in range(3)]
    assert content.parse_pieces(decompile_archives(spark.createDataFrame([("a.jar",)], "jar_path string"), tool(out))).count() == 2


def test_made_archives_of_a_folder_need_one_call_for_it(tmp_path, monkeypatch):
    rows = [{"doc_id": k, "jar_path": f"{tmp_path}/7/{k}.jar", "sources_path": f"{tmp_path}/7/{k}-sources.jar", "fqn": "a.B",
             "entry_name": "a/B.class", "source_entry": "a/B.java", "content": "x" * k} for k in range(0, 300, 50)]
    made = []
    monkeypatch.setattr(standin.os, "makedirs", lambda path, exist_ok, make=os.makedirs: (made.append(path), make(path, exist_ok=exist_ok)))
    list(standin._write_archives(iter([pa.RecordBatch.from_pylist(rows)])))
    assert made == [f"{tmp_path}/7"]
    for row in rows:
        file = zip_ranges.RangeFile(row["sources_path"])
        assert [zip_ranges.content_of(file, e) for e in zip_ranges.directory(file)] == [
            b"package org;", row["content"].encode() + b"// \xff\r\n"]
        file.close()


def test_made_archives_move_texts_once(spark, monkeypatch, capsys):
    """The documents are dealt out once, by folder, and joined with nothing."""
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda frame: frame)
    standin.archives(spark, "/root/testdata/sf0.001", "/nowhere").explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_listed_entries_of_small_archives_leave_together(tmp_path, jar):
    pairs = [{"jar_path": f"{k}", "sources_path": jar(tmp_path / f"{k}.jar", ("A.java", "a"), ("B.class", "b"))} for k in range(5)]
    (tmp_path / "broken.jar").write_text("no archive")
    pairs[2:2] = [{"jar_path": "broken", "sources_path": str(tmp_path / "broken.jar")}, {"jar_path": "gone", "sources_path": str(tmp_path / "gone.jar")}]
    batches = list(zip_ranges._listed(lambda name: name.endswith(".java"))(iter([pa.RecordBatch.from_pylist(pairs)])))
    assert len(batches) == 1
    assert [(r["jar_path"], r["entry_name"], r["error"] is None) for r in batches[0].to_pylist()] == [
        ("0", "A.java", True), ("1", "A.java", True), ("broken", None, False), ("2", "A.java", True), ("3", "A.java", True), ("4", "A.java", True)]
