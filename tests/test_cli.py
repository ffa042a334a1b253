"""Command line."""

from __future__ import annotations

import json

import pytest

from classatlas.__main__ import parse, run


@pytest.mark.parametrize("given, verb, name", [
    (["--db", "/tmp/x", "net.harbor.Quay"], "find", "net.harbor.Quay"),
    (["--db=/tmp/x", "stats"], "stats", None),
    (["Foo", "--code-only", "--db", "/tmp/x"], "find", "Foo"),
    (["--m2", "r", "--cfr", "c", "--db", "/tmp/x", "index"], "index", None),
    (["--db", "/tmp/x", "--", "Foo"], "find", "Foo"),
])
def test_first_bare_word_is_looked_up(given, verb, name):
    options = parse(given)
    assert (options.verb, getattr(options, "class_name", None), options.db) == (verb, name, "/tmp/x")


def test_no_verb_is_an_error():
    with pytest.raises(SystemExit):
        parse([])


def test_verbs(spark, tmp_path, jar, capsys, fake_java):
    repo, db = str(tmp_path / "repo"), str(tmp_path / "db")
    path = jar(tmp_path / "repo/a/b/1.0/b-1.0.jar", ("a/b/C.class", b""))
    jar(tmp_path / "repo/a/b/1.0/b-1.0-sources.jar", ("a/b/C.java", "package a.b;\nclass C { }\n"))

    def call(*arguments):
        run(spark, parse(["--m2", repo, "--db", db, *arguments]))
        return capsys.readouterr().out

    assert json.loads(call("index"))["indexed_classes"] == 1
    assert call("a.b.C", "--code-only") == "package a.b;\nclass C { }\n"
    found = json.loads(call("find", "C"))
    assert found["class_name"] == "a.b.C" and found["versions"][0]["cache_hit"]
    target = tmp_path / "out/C.json"
    call("find", "a.b.C", "-f", "structure", "-o", str(target))
    assert json.loads(target.read_text())["versions"][0]["structure"]["class_declaration"] == "class C"
    counts = json.loads(call("stats"))
    assert counts["loaded_jars"] == 1 and [h["access_count"] for h in counts["hotspots"]] == [3]
    assert json.loads(call("load", path))["skipped"]
    warmed = json.loads(call("warmup", "--hot"))
    assert warmed["targets"] == 0 and warmed["loaded_jars"] == []
    assert [j["skipped"] for j in json.loads(call("warmup", path))["loaded_jars"]] == [True]
    call("clear")
    assert json.loads(call("stats"))["cataloged_jars"] == 0
