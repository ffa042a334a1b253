"""Streams give what one batch gives, however the input is cut."""

from __future__ import annotations

import os

import duckdb
import pytest

from classatlas.operators import hotspot
from classatlas.plans import catalogue, oracles
from classatlas.sources.store import Store
from classatlas.streaming.access import count_accesses, running_counts
from classatlas.streaming.indexing import write_sources
from tests.compare import mismatch
from tests.test_operators import LOG, model_requests, random_log


def write_batches(spark, folder, batches, schema):
    for number, batch in enumerate(batches):
        path = folder / f"{number:03d}"
        spark.createDataFrame(batch, schema).coalesce(1).write.json(str(path))
        for file in sorted(path.glob("*.json")):
            target = folder / f"input-{number:03d}.json"
            target.write_bytes(file.read_bytes())
            os.utime(target, (1_700_000_000 + number, 1_700_000_000 + number))


def stream(spark, folder, schema):
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "input-*.json")
        .json(str(folder))
    )


def test_access_stream_equals_one_batch(spark, tmp_path):
    log = random_log(5, 240)
    batches = [log[:80], log[80:81], log[81:240]]
    write_batches(spark, tmp_path / "in", batches, LOG)
    store, seen = Store(spark, str(tmp_path / "store")), set()

    def collect(requests, number):
        seen.update(tuple(row) for row in requests.collect())

    count_accesses(
        stream(spark, tmp_path / "in", LOG), store, "log", collect, str(tmp_path / "c"), 3, compact_every=2
    ).awaitTermination()
    expected, state = model_requests(log, 3)
    assert seen == expected
    counts = {r["jar_path"]: (r["access_count"], r["warmed"]) for r in store.hotspots().collect()}
    assert counts == state
    whole = {tuple(r) for r in hotspot.state(spark.createDataFrame(log, LOG)).collect()}
    assert {tuple(r) for r in store.hotspots().collect()} == whole
    # three batches and one compaction, whose run is the first one still read
    assert store.last_run() == 4
    assert store.rows("jar_hotspot").agg({"run": "min"}).first()[0] == 3


def accesses(store):
    return sum(r["access_count"] for r in store.hotspots().collect())


def test_repeated_batch_is_counted_once(spark, tmp_path):
    """A batch whose commit Spark did not note is run again under the same id and number."""
    write_batches(spark, tmp_path / "in", [random_log(6, 30)], LOG)
    store, checkpoint = Store(spark, str(tmp_path / "store")), tmp_path / "c"
    for _ in range(2):
        count_accesses(
            stream(spark, tmp_path / "in", LOG), store, "log", lambda r, n: None, str(checkpoint)
        ).awaitTermination()
        for file in (checkpoint / "commits").iterdir():
            file.unlink()
    assert accesses(store) == sum(not row[3] for row in random_log(6, 30))


def test_streams_of_the_same_name_do_not_hide_each_other(spark, tmp_path):
    """Batch numbers start again with a new checkpoint folder; nothing of the second stream may be lost."""
    store, expected = Store(spark, str(tmp_path / "store")), 0
    for attempt in range(2):
        log = random_log(6 + attempt, 30)
        write_batches(spark, tmp_path / f"in{attempt}", [log], LOG)
        count_accesses(
            stream(spark, tmp_path / f"in{attempt}", LOG), store, "log", lambda r, n: None, str(tmp_path / f"c{attempt}")
        ).awaitTermination()
        expected += sum(not row[3] for row in log)
    assert accesses(store) == expected


def test_running_counts(spark, tmp_path):
    log = random_log(8, 60)
    write_batches(spark, tmp_path / "in", [log[:30], log[30:]], LOG)
    query = (
        running_counts(stream(spark, tmp_path / "in", LOG)).writeStream.outputMode("complete").format("memory")
        .queryName("running_counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {tuple(row) for row in spark.table("running_counts").collect()}
    assert got == {tuple(row) for row in hotspot.state(spark.createDataFrame(log, LOG)).collect()}


def test_sources_stream_upserts(spark, tmp_path):
    schema = "fqn string, jar_path string, content string, source string, seq long"
    batches = [
        [("A", "j", "1", "decompiled", 1), ("A", "j", "2", "decompiled", 2)],
        [("A", "j", "3", "sources-jar", 0), ("B", "j", "4", "decompiled", 0)],
    ]
    write_batches(spark, tmp_path / "in", batches, schema)
    store = Store(spark, str(tmp_path / "store"))
    query = write_sources(stream(spark, tmp_path / "in", schema), store, "w", str(tmp_path / "c"))
    query.awaitTermination()
    assert {tuple(r) for r in store.sources().collect()} == {
        ("A", "j", "3", "sources-jar"), ("B", "j", "4", "decompiled"),
    }


def test_write_errors_stop_the_stream(spark, tmp_path):
    schema = "fqn string, jar_path string, content string, source string, seq long"
    write_batches(spark, tmp_path / "in", [[("A", "j", "1", "decompiled", 1)]], schema)
    (tmp_path / "store").write_text("a file where the store should be")
    query = write_sources(
        stream(spark, tmp_path / "in", schema), Store(spark, str(tmp_path / "store")), "w", str(tmp_path / "c")
    )
    with pytest.raises(Exception):
        query.awaitTermination()


@pytest.mark.parametrize("table, query", [("documents", "cache_upsert_stream"), ("events", "hotspot_requests_stream")])
def test_a_table_in_parts_is_streamed_whole(spark, tmp_path, table, query):
    """A given table may be a folder of files, the later rows in any of them."""
    rows = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")
    key = rows.columns[0]
    rows.repartition(3, key).write.parquet(str(tmp_path / f"{table}.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    assert duck.execute(f"SELECT count(*) FROM glob('{tmp_path}/{table}.parquet/*.parquet')").fetchone()[0] == 3
    assert mismatch(catalogue.queries()[query](spark, str(tmp_path)), duck, oracles.oracle_sql()[query]) is None
