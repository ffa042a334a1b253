"""Column functions on names and texts."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from classatlas.functions import names, text


def apply(spark, function, values):
    frame = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [row["y"] for row in frame.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = {
    names.normalize_query: [
        ("import net.harbor.crane. Winch ;", "net.harbor.crane.Winch"),
        ("  a.b.C ;; ", "a.b.C"), ("important.Foo", "ant.Foo"), ("import static a.B;", "statica.B"),
        ("a ; ;", "a;"), ("import", ""), ("Foo", "Foo"),
    ],
    names.version_of_path: [
        ("/m2/org/demo/1.0/demo-1.0.jar", "1.0"), ("/a.jar", None), ("a.jar", None), ("x/a.jar", "x"),
    ],
    names.sources_jar_path: [
        ("/r/demo-1.0.jar", "/r/demo-1.0-sources.jar"), ("/r/demo-1.0-sources.jar", None), ("/r/demo.zip", None),
        ("/r/.jar", None), ("demo.jar", "demo-sources.jar"), ("/r.jar/demo", None), ("/r/a.jar.jar", "/r/a.jar-sources.jar"),
    ],
    names.class_of_entry: [
        ("org/example/A.class", "org.example.A"), ("org\\example\\A.class", "org.example.A"),
        ("a/B.class.class", "a.B"), ("module-info.class", "module-info"),
    ],
    names.entry_of_class: [("a.b.C", "a/b/C.class"), ("a.b.C$D", "a/b/C$D.class")],
    names.source_entry_of_class: [("a.b.C", "a/b/C.java"), ("a.b.C$D$1", "a/b/C.java")],
    names.search_prefixes: [
        ("StringUtils", []), ("a.B", []), ("a.b.C", ["a/b"]),
        ("org.apache.commons.lang3.StringUtils", ["org/apache/commons/lang3", "org/apache/commons", "org/apache"]),
    ],
    names.parent_directories: [("a/b/c.jar", ["a", "a/b"]), ("c.jar", [])],
    names.strip_space: [
        ("  a  b \t\n", "a  b"), ("\u00a0x\u2003", "x"), (" \n ", ""), ("", ""),
        ("a" + " " * 200000 + "b ", "a" + " " * 200000 + "b"),
    ],
    text.collapse_space: [("  a\t\n b c ", "a b c"), ("", "")],
    text.type_name_of_line: [
        ("public final class Foo<T> extends Bar {", "Foo"), ("interface   X{", "X"), ("record P(int x) {}", "P(int"),
        ("* the class of things", "of"), ("class {", None), ("@interface Tag {", "Tag"), ("int x;", None),
        ("enum class X", "X"), ("subclass of", "of"), ("class {{ enum E", "E"),
    ],
    text.extract_class_name: [
        ("\npackage a.b;\npublic final class Foo<T> extends Bar {\n}\n", "a.b.Foo"),
        ("class A {}\npackage late;\n", "late.A"), ("package a;\n", None), ("", None),
        ("package package x ;;\r\nclass A\r\n", "x.A"), ("package ;\npackage b;\nenum E{", "b.E"),
        ("packages a;\nclass A", "A"),
    ],
}


@pytest.mark.parametrize("function", CASES, ids=lambda f: f.__name__)
def test_cases(spark, function):
    values, expected = zip(*CASES[function])
    assert apply(spark, function, values) == list(expected)


# -- an independent line-by-line model of naming and splitting ---------------

def model_name(content):
    package = kind = None
    for line in (raw.strip() for raw in content.split("\n")):
        if package is None and line.startswith("package "):
            rest = line
            while rest.startswith("package "):
                rest = rest[8:]
            package = rest.rstrip(";").strip() or None
        for keyword in ("class ", "interface ", "enum ", "record "):
            if kind is None and keyword in line:
                token = line.split(keyword, 1)[1].split()[0].rstrip("{").split("<")[0]
                kind = token or None
    return None if kind is None else f"{package}.{kind}" if package else kind


def model_split(output):
    output = output.replace("\r\n", "\n")
    head, *rest = output.split(text.DECOMPILED_BANNER)
    pieces = [(text.DECOMPILED_BANNER + piece).strip() for piece in rest] if rest else [output]
    return [
        (model_name(p), p, hashlib.sha256(p.encode()).hexdigest()) for p in pieces if model_name(p) is not None
    ]


def random_texts(count):
    chance = random.Random(7)
    words = [
        "class ", "interface ", "enum ", "record ", "@interface ", "package ", "a.b", "Foo<T>", "X{", "{", ";", "\n",
        "\n", "\r\n", " ", "\t", text.DECOMPILED_BANNER, "// é", "$", "Bar",
    ]
    return ["".join(chance.choice(words) for _ in range(chance.randint(0, 25))) for _ in range(count)]


def test_naming_and_splitting_agree_with_the_model(spark):
    texts = random_texts(2000)
    assert apply(spark, text.extract_class_name, texts) == [model_name(t) for t in texts]
    got = apply(spark, text.split_decompiled, texts)
    assert [[tuple(piece) for piece in pieces] for pieces in got] == [model_split(t) for t in texts]


def test_content_for_class_falls_back_to_everything(spark):
    output = text.DECOMPILED_BANNER + "\n */\nclass A {}\n"
    frame = spark.createDataFrame([(output, "A"), (output, "B")], "o string, f string")
    got = [r[0] for r in frame.select(text.content_for_class(F.col("o"), F.col("f"))).collect()]
    assert got == [output.strip(), output]
