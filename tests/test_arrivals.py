"""Archives as a stream: every change is reported, nothing else is."""

from __future__ import annotations

import os
import time

import pytest

from classatlas.plans.engine import Atlas
from classatlas.sources.arrivals import ChangeReader, artifact_changes, changed_between, deal_out
from classatlas.sources.artifacts import list_artifacts

SETTLE = 0.05


def rows_of(root, after, until):
    return sorted(
        row for part in deal_out(str(root)) for directory, deep in part
        for row in changed_between(directory, deep, after, until)
    )


@pytest.fixture()
def tree(tmp_path, jar):
    root = tmp_path / "repo"
    for k in range(6):
        for version in range(3):
            jar(root / f"g{k % 2}" / f"a{k}" / str(version) / f"a{k}-{version}.jar", (f"x/C{k}.class", ""))
    jar(root / "top.jar", ("x/Top.class", ""))
    os.makedirs(root / "dir.jar" / "deep")
    jar(root / "dir.jar" / "deep" / "in.jar", ("x/In.class", ""))
    (root / ".jar").write_text("")
    os.symlink(root / "nowhere", root / "broken.jar")
    os.symlink(root / "g0", root / "g9")
    return root


@pytest.mark.parametrize(("opened", "tasks"), [(1, 1), (3, 2), (5, 100), (1000, 4)])
def test_every_directory_is_dealt_out_once(tree, opened, tasks):
    parts = deal_out(str(tree), opened, tasks)
    assert len(parts) <= tasks and all(parts)
    seen = []
    for directory, deep in (item for part in parts for item in part):
        seen += [folder for folder, _, _ in os.walk(directory)] if deep else [directory]
    assert sorted(seen) == sorted(folder for folder, _, _ in os.walk(tree))


def test_a_batch_from_the_start_is_the_listing(spark, tree):
    listed = {tuple(r) for r in list_artifacts(spark, str(tree)).collect()}
    found = {row for row in rows_of(tree, -1, time.time_ns() + 10**9)}
    assert found == {row for row in listed if not row[0].endswith("broken.jar")}


def test_changes_lie_between_the_offsets(tree):
    past = time.time_ns() - 5 * 10**9
    assert rows_of(tree, -1, past) == []
    # a copy keeps the time of its original, yet it has come only now
    os.utime(tree / "top.jar", ns=(past - 10**12, past - 10**12))
    assert (str(tree / "top.jar"), past - 10**12) in {row[:2] for row in rows_of(tree, past, time.time_ns() + 10**9)}
    assert rows_of(tree, time.time_ns() + 10**9, time.time_ns() + 2 * 10**9) == []


def test_missing_directory_is_empty(tmp_path):
    assert rows_of(tmp_path / "none", -1, time.time_ns()) == []
    reader = ChangeReader(str(tmp_path / "none"), SETTLE)
    assert len(reader.partitions(reader.initialOffset(), reader.latestOffset())) == 1


def test_stream_goes_on_where_it_stopped(spark, tree, tmp_path, jar):
    def follow():
        query = artifact_changes(spark, str(tree), SETTLE).writeStream.format("parquet").option(
            "path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(os.path.basename(r["jar_path"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    time.sleep(2 * SETTLE)
    first = follow()
    assert len(first) == len(set(first)) == 21  # 18 versions, two more and a folder with such a name
    os.utime(tree / "top.jar")
    jar(tree / "g0" / "new" / "1" / "new-1.jar", ("x/New.class", ""))
    time.sleep(2 * SETTLE)
    assert follow() == sorted([*first, "top.jar", "new-1.jar"])
    assert follow() == sorted([*first, "top.jar", "new-1.jar"])


def test_follow_catalogs_like_update(spark, tree, tmp_path, jar):
    followed, updated = (Atlas(spark, str(tmp_path / s), str(tree)) for s in ("followed", "updated"))

    def go_on():
        time.sleep(2 * SETTLE)
        followed.follow(str(tmp_path / "c"), SETTLE).awaitTermination()
        updated.update().collect()

    def pairs(atlas):
        return {(r["fqn"], r["jar_path"]) for r in atlas.store.registry().collect()}

    go_on()
    assert pairs(followed) == pairs(updated) and len(pairs(followed)) == 20
    jar(tree / "g1" / "a1" / "0" / "a1-0.jar", ("x/C1.class", ""), ("x/Added.class", ""))
    go_on()
    assert pairs(followed) == pairs(updated) and len(pairs(followed)) == 21
    runs = followed.store.last_run()
    go_on()
    assert followed.store.last_run() == runs  # a batch without changes writes nothing
    # both keep the same snapshot, so one finds nothing left by the other
    assert followed.update().first()["changed_jars"] == 0


def test_a_repeated_batch_is_taken_in_once(spark, tree, tmp_path):
    atlas, checkpoint = Atlas(spark, str(tmp_path / "s"), str(tree)), tmp_path / "c"
    time.sleep(2 * SETTLE)
    atlas.follow(str(checkpoint), SETTLE).awaitTermination()
    runs = atlas.store.last_run()
    for file in (checkpoint / "commits").iterdir():
        file.unlink()
    atlas.follow(str(checkpoint), SETTLE).awaitTermination()
    assert atlas.store.last_run() == runs
