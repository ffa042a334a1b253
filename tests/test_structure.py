"""Structure extraction on Java sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from classatlas.functions.structure import class_structure, has_member

ORDER = r'''
// licence
package org.demo.shop;

import java.util.*;
import static java.lang.Math.max;
import java.util.List;

/**
 * Order { doc }.
 */
// second
@Entity(name = "a;b{", tags = {"x", "y"})
public abstract class Order<T extends Comparable<? super T>>  extends Base<T>
    implements Runnable,
        Cloneable {
    /** Name doc. */
    @Column(value = "}")
    private String name = "x{;}", other;
    int[] a = {1, 2}, b = new int[]{3}; // trailing
    // Count doc.
    protected final Map<String, List<int[]>> m = new HashMap<>() {{ put("a", null); }};
    private Runnable r = () -> { int x = 1; };
    static { System.out.println("{"); }

    public Order(String name)   throws java.io.IOException,
        RuntimeException { this.name = name; /* inner */ if (a < b) { } }
    /* one */ /* two */
    public <K, V extends List<K>> Map<K, V> build (K k, V... v) { return null; }
    protected abstract Class<T> type();
    /** Doc a. */

    /** Doc b. */
    @Override @SuppressWarnings({"a", "b"})
    public
      synchronized int[] calc(@Nullable(x = ")") int q)[] { return '}' == q ? null : a; }
    class Inner { int hidden; void no() {} }
    record Point(int x, int y) {}
    void last() {}
}
'''


def parse(spark, *sources):
    frame = spark.createDataFrame(list(enumerate(sources)), "i int, s string")
    rows = frame.select("i", class_structure(F.col("s")).alias("c")).orderBy("i").collect()
    return [row["c"].asDict(recursive=True) if row["c"] else None for row in rows]


def shown(members):
    return [(m["declaration"], m["comment"]) for m in members]


def test_class_with_everything(spark):
    (c,) = parse(spark, ORDER)
    assert c["package"] == "org.demo.shop"
    # a wildcard import shows its last part only
    assert c["imports"] == ["*", "java.lang.Math.max", "java.util.List"]
    assert c["class_declaration"] == (
        '@Entity(name = "a;b{", tags = {"x", "y"})\npublic abstract class Order<T extends Comparable<? super T>>'
        " extends Base<T> implements Runnable,\n        Cloneable"
    )
    assert c["class_comment"] == "/**\n * Order { doc }.\n */\n// second"
    assert c["comments"] == [
        "// licence", "/**\n * Order { doc }.\n */", "// second", "/** Name doc. */", "// trailing", "// Count doc.",
        "/* inner */", "/* one */", "/* two */", "/** Doc a. */", "/** Doc b. */",
    ]
    assert shown(c["fields"]) == [
        ('@Column(value = "}") private String name = "x{;}", other;', "/** Name doc. */"),
        ("int[] a = {1, 2}, b = new int[]{3};", None),
        ('protected final Map<String, List<int[]>> m = new HashMap<>() {{ put("a", null); }};', "// Count doc."),
        ("private Runnable r = () -> { int x = 1; };", None),
    ]
    assert shown(c["methods"]) == [
        ("public Order(String name) throws java.io.IOException,\n        RuntimeException", None),
        ("public<K, V extends List<K>> Map<K, V> build(K k, V... v)", None),
        ("protected abstract Class<T> type()", None),
        (
            '@Override @SuppressWarnings({"a", "b"})\n    public\n      synchronized int[] calc(@Nullable(x = ")") int q) []',
            "/** Doc a. */\n/** Doc b. */",
        ),
        ("void last()", None),
    ]


def test_enum(spark):
    listed, bare = parse(spark, '''package a;
public enum Color implements X {
  /** red */ RED(1) { void f() {} },
  // green
  GREEN, BLUE("a,b"),
  ;
  /** v */
  private int value;
  Color(int v) { value = v; }
  public int getValue() { return value; }
}
''', "enum E { A, B }")
    assert listed["class_declaration"] == "public enum Color implements X"
    assert shown(listed["fields"]) == [
        ("RED(1) { void f() {} }", "/** red */"), ("GREEN", "// green"), ('BLUE("a,b")', None),
        ("private int value;", "/** v */"),
    ]
    assert shown(listed["methods"]) == [("Color(int v)", None), ("public int getValue()", None)]
    assert shown(bare["fields"]) == [("A", None), ("B", None)]


def test_annotation_type(spark):
    (c,) = parse(spark, '''package x.y;
@Target({ElementType.TYPE})
@Documented
public   @interface Component {
    /** val */
    String value() default "";
    String[] names()   default {"a", "b"};
    int MAX = 3;
}
''')
    assert c["class_declaration"] == "@Target({ElementType.TYPE})\n@Documented\npublic @interface Component"
    assert shown(c["methods"]) == [
        ('String value() default "";', "/** val */"), ('String[] names() default {"a", "b"};', None),
    ]
    assert shown(c["fields"]) == [("int MAX = 3;", None)]


def test_several_types_last_declaration_wins_members_accumulate(spark):
    (c,) = parse(spark, '''public interface Service<T> extends A<T>, B permits C {
    T find(String id);
    default void save(T entity) { }
    int K = 1;
}
/** rec */
record P<T>(int x, T y) implements Q { static int z; P { } int sum() { return x; } }
''')
    assert c["package"] == "" and c["imports"] == []
    assert c["class_declaration"] == "record P<T>(int x, T y) implements Q"
    assert c["class_comment"] == "/** rec */"
    assert [m["declaration"] for m in c["fields"]] == ["int K = 1;", "static int z;"]
    assert [m["declaration"] for m in c["methods"]] == ["T find(String id)", "default void save(T entity)", "int sum()"]


def test_blank_and_foreign_input(spark):
    blank, spaces, prose, broken = parse(spark, "", " \n\t", "hello world", "class A { void f( { ")
    assert blank is None and spaces is None
    assert prose == {
        "package": "", "imports": [], "class_declaration": "", "class_comment": None, "comments": [],
        "fields": [], "methods": [],
    }
    assert broken["methods"] == []


def test_literals_hide_code(spark):
    (c,) = parse(spark, "class A { String t = \"\"\"\n  } \" { // no\n \"\"\"; char c = '\\''; /* { */ void f() {} }")
    assert [m["declaration"] for m in c["fields"]] == ['String t = """ } " { // no """;', "char c = '\\'';"]
    assert [m["declaration"] for m in c["methods"]] == ["void f()"]
    assert c["comments"] == ["/* { */"]


def test_comments_between_header_parts(spark):
    (c,) = parse(spark, "public class A /* c */ extends B { public /* x */ int f /* y */ (int a) { } }")
    assert c["class_declaration"] == "public class A /* c */ extends B"
    assert c["methods"][0]["declaration"] == "public /* x */ int f /* y */(int a)"


def test_deep_and_long_input(spark):
    nested = "class A { void f() " + "{" * 500 + "}" * 500 + " int x; }"
    generic = "class G { " + "List<" * 60 + "X" + ">" * 60 + " g() { } }"
    escapes = 'class S { String s = "' + "\\u0001" * 20000 + '"; int y; }'
    many = "class M {" + "".join(f" int f{i}; void m{i}() {{ }}" for i in range(3000)) + "}"
    remarks = "// one\n" * 50000 + "class R { " + "/* x */ " * 50000 + "int z; }"
    a, g, s, m, r = parse(spark, nested, generic, escapes, many, remarks)
    assert len(r["comments"]) == 100000 and r["fields"] == [{"declaration": "int z;", "comment": None}]
    assert r["class_comment"].count("\n") == 49999
    assert [f["declaration"] for f in a["fields"]] == ["int x;"]
    assert len(g["methods"]) == 1 and g["methods"][0]["declaration"].endswith(" g()")
    assert [f["declaration"] for f in s["fields"]][1] == "int y;"
    assert (len(m["fields"]), len(m["methods"])) == (3000, 3000)


def test_member_search(spark):
    frame = spark.createDataFrame([("class A { int count; void run() { } }",)], "s string")
    c = frame.select(class_structure(F.col("s")).alias("c")).select(
        has_member(F.col("c.fields"), "count"), has_member(F.col("c.methods"), "count"),
        has_member(F.col("c.methods"), "run()"),
    ).first()
    assert tuple(c) == (True, False, True)
