"""Writers exclude each other, and a store knows how it was written."""

from __future__ import annotations

import pytest

from classatlas.sources import store as store_module
from classatlas.sources.store import Store, StoreLocked

_PAIRS = "fqn string, jar_path string, seq long"


def pairs(spark, *names):
    return spark.createDataFrame([(name, f"{name}.jar", 1) for name in names], _PAIRS)


def registered(store):
    return sorted(r["fqn"] for r in store.registry().collect())


def test_second_writer_fails_and_changes_nothing(spark, tmp_path):
    first, second = (Store(spark, str(tmp_path / "store"), wait=0.3) for _ in range(2))
    with first.run() as number:
        first.write("class_registry", pairs(spark, "a"))
        with pytest.raises(StoreLocked):
            with second.run():
                second.write("class_registry", pairs(spark, "b"))
    assert number == 1 and registered(second) == ["a"]
    with second.run() as number:
        second.write("class_registry", pairs(spark, "b"))
    assert number == 2 and registered(first) == ["a", "b"] and first.last_run() == 2


def test_failed_run_frees_the_store_and_stays_unseen(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(ZeroDivisionError):
        with store.run():
            store.write("class_registry", pairs(spark, "lost"))
            1 / 0
    with store.run():
        store.write("class_registry", pairs(spark, "kept"))
    assert registered(store) == ["kept"]


def test_writer_waits_for_an_open_run(spark, tmp_path):
    import threading

    first, second = (Store(spark, str(tmp_path / "store"), wait=30) for _ in range(2))
    with first.run():
        first.write("class_registry", pairs(spark, "a"))
    first._lock()
    timer = threading.Timer(0.5, first.release)
    timer.start()
    with second.run():
        second.write("class_registry", pairs(spark, "b"))
    timer.join()
    assert registered(first) == ["a", "b"]
    first._lock()
    second.wait = 0.2
    with pytest.raises(StoreLocked):
        second.clear()
    first.release()
    second.clear()
    assert registered(first) == []


def test_commits_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "FOLD", 2)
    store = Store(spark, str(tmp_path / "store"))
    for number, name in enumerate("abcde", 1):
        with store.run(tag=f"t{number}") as run:
            store.write("class_registry", pairs(spark, name))
        assert run == number == store.last_run()
    assert registered(store) == list("abcde") and all(store.has_run(f"t{k}") for k in range(1, 6)) and not store.has_run("t6")
    assert store._folds() == [1, 2]
    store.compact("class_registry")
    assert registered(store) == list("abcde")


def test_lookup_of_many_names_prunes_partitions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), slots=16)
    with store.run():
        store.write("class_registry", pairs(spark, *(f"org.c{k}" for k in range(200))))
    wanted = spark.createDataFrame([("org.c7",), ("org.c7",), ("org.c9",), ("org.none",), ("",), (None,)], "fqn string")
    found = store.of_names("class_registry", wanted)
    assert sorted(r["fqn"] for r in found.collect()) == ["org.c7", "org.c9"]
    assert "dynamicpruning" in found._jdf.queryExecution().toString().lower()
    assert store.of_names("class_registry", wanted.limit(0)).count() == 0


def test_lock_of_a_dead_driver_is_released_by_hand(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), wait=0.3)
    store._lock()
    with pytest.raises(StoreLocked), store.run():
        pass
    store.release()
    with store.run():
        store.write("class_registry", pairs(spark, "a"))
    assert registered(store) == ["a"]


def test_slots_are_those_the_store_was_written_with(spark, tmp_path):
    names = [f"org.c{k}" for k in range(12)]
    written = Store(spark, str(tmp_path / "store"), slots=8)
    with written.run():
        written.write("class_registry", pairs(spark, *names))
    opened = Store(spark, str(tmp_path / "store"))
    assert opened.slots == 8
    assert all(opened.of_class("class_registry", name).count() == 1 for name in names)
    with opened.run():
        opened.write("class_registry", pairs(spark, "org.later"))
    assert written.of_class("class_registry", "org.later").count() == 1
    opened.clear()
    assert Store(spark, str(tmp_path / "store"), slots=4).slots == 4


def test_compaction_removes_what_the_one_before_replaced(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for name in "abcd":
        with store.run():
            store.write("class_registry", pairs(spark, name))
        store.compact("class_registry")
    runs = [p for p in (tmp_path / "store/class_registry").iterdir() if p.name.startswith("run=")]
    assert len(runs) <= 3 and registered(store) == list("abcd")
