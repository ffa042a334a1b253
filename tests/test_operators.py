"""Operators on small tables, against plain Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from classatlas.operators import content, hotspot, registry, resolve, warmup
from classatlas.sources.store import Store

LOG = "jar_path string, epoch long, order long, warmed boolean, class_count long"


def as_set(frame):
    return {tuple(row) for row in frame.collect()}


def model_requests(log, threshold, counts=None):
    state, out = dict(counts or {}), set()
    for jar, _, order, warmed, _ in sorted(log, key=lambda r: r[2]):
        n, warm = state.get(jar, (0, False))
        if warmed:
            state[jar] = (n, True)
            continue
        state[jar] = (n + 1, warm)
        if not warm and n + 1 >= max(threshold, 1):
            out.add((jar, order, hotspot.HIGH, hotspot.ALL_CLASSES))
        elif not warm and n + 1 == 1:
            out.add((jar, order, hotspot.NORMAL, hotspot.TOP_LEVEL_ONLY))
    return out, state


def random_log(seed, size, keys=6, start=0):
    chance = random.Random(seed)
    # one key takes a third of all rows
    return [
        ("hot" if chance.random() < 0.33 else f"k{chance.randrange(keys)}", start + i, start + i,
         chance.random() < 0.05, chance.randrange(9))
        for i in range(size)
    ]


def test_requests_against_the_state_machine(spark):
    for threshold in (0, 1, 2, 3, 50):
        log = random_log(threshold, 300)
        got = as_set(hotspot.requests(spark.createDataFrame(log, LOG), threshold))
        assert got == model_requests(log, threshold)[0]


def test_requests_continue_from_earlier_counters(spark):
    first, second = random_log(1, 40), random_log(2, 200, keys=9, start=40)
    _, state = model_requests(first, 5)
    expected, _ = model_requests(second, 5, state)
    before = hotspot.state(spark.createDataFrame(first, LOG))
    assert as_set(hotspot.requests(spark.createDataFrame(second, LOG), 5, before)) == expected


def test_threshold_sequence(spark):
    log = [("a.jar", 1, 1, False, 0), ("a.jar", 2, 2, False, 0), ("a.jar", 3, 3, True, 10), ("a.jar", 4, 4, False, 0)]
    got = sorted(as_set(hotspot.requests(spark.createDataFrame(log, LOG), 2)))
    assert [(r[1], r[2]) for r in got] == [(1, hotspot.NORMAL), (2, hotspot.HIGH)]
    state = hotspot.state(spark.createDataFrame(log, LOG)).first()
    assert tuple(state) == ("a.jar", 3, 4, True, 10)


def test_earliest_accesses_are_limited_before_the_exchange(spark):
    plan = hotspot.marks(spark.createDataFrame(random_log(3, 50), LOG), 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_top_lists(spark):
    rows = [("a", 5, 10, False, 0), ("b", 5, 11, False, 0), ("c", 9, 1, True, 3), ("d", 0, 0, False, 0), ("e", 5, 10, False, 0)]
    frame = spark.createDataFrame(rows, "jar_path string, access_count long, last_access long, warmed boolean, class_count long")
    assert [r["jar_path"] for r in hotspot.top_unwarmed(frame, 3).collect()] == ["b", "a", "e"]
    assert hotspot.top_unwarmed(frame, 0).count() == 0
    assert [r["jar_path"] for r in hotspot.top_accessed(frame).collect()] == ["c", "b", "a", "e", "d"]


def test_registry_appends_in_order_without_repetition(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), slots=4)

    def append(jar, *classes):
        with store.run() as run:
            pairs = spark.createDataFrame([(c, jar, run) for c in classes], "fqn string, jar_path string, seq long")
            fresh = registry.new_pairs(pairs, store.registry()).checkpoint()
            store.write("class_registry", fresh)
            store.write("artifact_manifest", registry.uncataloged(
                spark.createDataFrame([(jar,)], "jar_path string"), store.manifest()))
        return fresh.count()

    assert [append("jar1", "a.A", "a.B"), append("jar1", "a.A", "a.B"), append("jar2", "a.A")] == [2, 0, 1]
    asked = spark.createDataFrame([("a.A",)], "fqn string")
    listed = registry.artifacts_of(store.registry(), asked).orderBy("seq").collect()
    assert [r["jar_path"] for r in listed] == ["jar1", "jar2"]
    assert sorted(r["jar_path"] for r in store.manifest().collect()) == ["jar1", "jar2"]
    assert [r["fqn"] for r in store.of_class("class_registry", "a.B").collect()] == ["a.B"]


def test_failed_run_stays_unseen_and_leaves_nothing_behind(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), slots=2)
    jars = lambda *names: spark.createDataFrame([(n,) for n in names], "jar_path string")
    try:
        with store.run():
            store.write("jars", jars("lost"))
            raise OSError("executor gone")
    except OSError:
        pass
    assert store.loaded().count() == 0
    with store.run("tag"):
        store.write("artifact_manifest", jars("kept"))
    assert store.loaded().count() == 0
    assert [r[0] for r in store.manifest().collect()] == ["kept"]
    assert store.has_run("tag") and not store.has_run("other")


def test_cache_keeps_the_last_write(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), slots=2)
    schema = "fqn string, jar_path string, content string, source string, seq long"
    for batch in ([("A", "j", "1", "s", 1), ("A", "j", "2", "s", 2), ("B", "j", "x", "s", 1)], [("A", "j", "3", "d", 0)]):
        with store.run():
            store.write("class_sources", content.keep_last(spark.createDataFrame(batch, schema)))
    assert as_set(store.sources()) == {("A", "j", "3", "d"), ("B", "j", "x", "s")}
    assert as_set(store.sources("A")) == {("A", "j", "3", "d")}


def test_compaction_keeps_content_and_vacuum_removes_old_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), slots=2)
    schema = "fqn string, jar_path string, content string, source string, seq long"
    for text in ("1", "2", "3"):
        with store.run():
            store.write("class_sources", content.keep_last(
                spark.createDataFrame([("A", "j", text, "s", 1), (f"B{text}", "j", "x", "s", 1)], schema)))
    before = as_set(store.sources())
    store.compact("class_sources")
    assert as_set(store.sources()) == before and len(before) == 4
    assert store.rows("class_sources").select("run").distinct().count() == 1
    store.vacuum("class_sources")
    assert [p.name for p in (tmp_path / "store/class_sources").glob("run=*")] == ["run=4"]
    assert as_set(store.sources()) == before
    store.vacuum("jars")


def test_opening_a_store_writes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "none"))
    assert store.sources().count() == 0 and store.hotspots().count() == 0
    assert not (tmp_path / "none").exists()


def test_skewed_keys_give_whole_results(spark):
    """One class in a third of all artifacts, one artifact with a third of all entries."""
    pairs = [("hot.C", f"j{i}") for i in range(400)] + [(f"p.C{i}", "jhot") for i in range(400)]
    pairs += [(f"p.C{i % 50}", f"j{i}") for i in range(400)]
    frame = spark.createDataFrame(pairs * 2, "fqn string, jar_path string").withColumn("seq", F.lit(1).cast("long"))
    built = registry.build(frame)
    assert as_set(built.select("fqn", "jar_path")) == set(pairs)
    counts = {r["fqn"]: r["artifacts"] for r in registry.artifact_counts(built).collect()}
    assert counts["hot.C"] == 400
    gaps = {
        r["jar_path"]: r["missing"]
        for r in content.needs_decompiling(
            built.select("jar_path").distinct(), built, built.where("fqn = 'hot.C'").select("jar_path", "fqn")
        ).collect()
    }
    assert gaps["jhot"] == len({p for p in pairs if p[1] == "jhot"})


def test_tiers_and_default_version(spark):
    rows = [
        ("a.b.c.D", "a/b/c/x/1.0/x.jar"), ("a.b.c.D", "a/b/y/2.0/y.jar"), ("a.b.c.D", "z/3.0/z.jar"),
        ("a.b.e.F", "z/3.0/z.jar"), ("a.G", "q/1/q.jar"), ("a.G", "a/1/g.jar"), ("n.o.V", "v.jar"), ("n.o.V", "u.jar"),
    ]
    frame = spark.createDataFrame(rows, "fqn string, jar_path string")
    assert as_set(resolve.narrowest(frame)) == {
        ("a.b.c.D", "a/b/c/x/1.0/x.jar", 0), ("a.b.e.F", "z/3.0/z.jar", 2), ("a.G", "q/1/q.jar", 0),
        ("a.G", "a/1/g.jar", 0), ("n.o.V", "v.jar", 1), ("n.o.V", "u.jar", 1),
    }
    chosen = as_set(resolve.default_version(resolve.with_version(frame)))
    assert {("a.b.c.D", "3.0", "z/3.0/z.jar"), ("n.o.V", None, "u.jar")} <= chosen


def test_version_order_is_by_text(spark):
    frame = resolve.with_version(spark.createDataFrame(
        [("r/9.0/a.jar",), ("r/10.0/a.jar",), ("a.jar",), ("r/10.0/A.jar",)], "jar_path string"))
    ordered = [r["jar_path"] for r in frame.orderBy(*resolve.version_order()).collect()]
    assert ordered == ["a.jar", "r/10.0/A.jar", "r/10.0/a.jar", "r/9.0/a.jar"]


def test_queue_order(spark):
    tasks = spark.createDataFrame(
        [("x", 1, 0, "m"), ("y", 2, 2, "m"), ("z", 2, 1, "m"), ("y", 1, 3, "m"), ("x", 1, 4, "n")],
        "jar_path string, priority long, seq long, mode string",
    )
    assert [(r["priority"], r["seq"]) for r in warmup.queue_order(tasks).collect()] == [(2, 1), (2, 2), (1, 0)]


def test_one_row_per_key_on_equal_order(spark):
    """Repeated and contradicting writes of equal age leave one row, the same one in any order of the rows."""
    writes = [("A", "j", "x", "s", 1), ("A", "j", "y", "s", 1), ("A", "j", "x", "s", 0), ("B", "j", "z", "s", 2), ("B", "j", "z", "s", 2),
              ("C", "j", None, "s", 3), ("C", "j", None, "s", 3), (None, "j", "n", "s", 1), ("D", "j", "only", "s", 1)]
    schema = "fqn string, jar_path string, content string, source string, seq long"
    kept = [sorted(map(str, content.keep_last(spark.createDataFrame(rows, schema)).collect())) for rows in (writes, writes[::-1])]
    assert kept[0] == kept[1] and len(kept[0]) == 5


def test_positions_in_version_order(spark):
    hits = [("a", v, f"p{k}") for k, v in enumerate(["2", None, "10", "2", None])] + [("b", "1", f"q{k}") for k in range(300)]
    found = resolve.positions(spark.createDataFrame(hits, "name string, version string, jar_path string"), "name").collect()
    assert {r["jar_path"]: r["position"] for r in found if r["name"] == "a"} == {"p1": 1, "p4": 2, "p2": 3, "p0": 4, "p3": 5}
    assert sorted(r["position"] for r in found if r["name"] == "b") == list(range(1, 301))


def test_first_texts_do_not_move_when_few_keys_repeat(spark, capsys):
    schema = "fqn string, jar_path string, content string, source string, seq long"
    writes = [("A", "j", "1", "s", 1), ("A", "j", "2", "s", 2), ("B", None, "3", "s", 1), ("B", None, "4", "s", 0), ("C", "j", "5", "s", 0)]
    kept = content.keep_last(spark.createDataFrame(writes, schema))
    kept.explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert sorted(r["content"] for r in kept.collect()) == ["2", "3", "5"]


def test_first_texts_of_many_repeated_keys_are_the_same(spark, monkeypatch):
    schema = "fqn string, jar_path string, content string, source string, seq long"
    writes = [(f"A{k % 7}", None if k % 3 else "j", str(k % 5), "s", k // 40) for k in range(200)]
    frame = spark.createDataFrame(writes, schema)
    few = sorted(map(str, content.keep_last(frame).collect()))
    monkeypatch.setattr(content, "FEW_KEYS", 2)
    assert sorted(map(str, content.keep_last(frame).collect())) == few and len(few) == 14
