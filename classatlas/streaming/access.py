"""Access counting on a stream.

A micro-batch is an ordinary batch for the hotspot operators: counters of earlier
batches come from the store, the increments of this one are appended to it. No
per-key Python state is kept, so one artifact that receives most accesses is
handled by partial aggregation like in a batch job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from classatlas.operators import hotspot
from classatlas.plans import standin
from classatlas.sources.store import Store
from classatlas.streaming.tags import BatchTags

_REQUESTS = "jar_path string, event_id long, priority long, mode string"


def count_accesses(
    log: DataFrame,
    store: Store,
    name: str,
    on_requests: Callable[[DataFrame, int], None],
    checkpoint: str,
    threshold: int = hotspot.WARMUP_THRESHOLD,
    compact_every: int = 100,
    **trigger,
) -> StreamingQuery:
    """Start counting a stream of ``(jar_path, epoch, order, warmed, class_count)`` rows.

    ``on_requests`` receives the warm-up requests and the number of each batch. A
    batch that Spark repeats after a failure is recognised by its tag and its
    increments are not added twice; its requests are delivered before the tag is
    written, so they arrive at least once. Counters are compacted now and then, so
    that a batch never reads more than one row per artifact and recent batch.
    """
    tags = BatchTags(name, checkpoint)

    def handle(batch: DataFrame, number: int) -> None:
        tag = tags.of(batch.sparkSession, number)
        if store.has_run(tag):
            return
        rows = batch.persist()
        try:
            on_requests(hotspot.requests(rows, threshold, store.hotspots()), number)
            with store.run(tag):
                store.write("jar_hotspot", hotspot.increments(rows))
            if number % compact_every == compact_every - 1:
                store.compact("jar_hotspot")
        finally:
            rows.unpersist()

    return (
        log.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def running_counts(log: DataFrame) -> DataFrame:
    """Counters per artifact as a streaming aggregate, for update or complete mode."""
    return hotspot.state(log)


def replay_requests(spark: SparkSession, directory: str) -> DataFrame:
    """Run all events through the stream and return every request it made."""
    base = standin.scratch(spark, "access")
    log = standin.access_log_of(standin.stream(spark, directory, "events"))

    def keep(requests: DataFrame, number: int) -> None:
        # one folder per batch, so a repeated batch replaces its own output
        requests.select("jar_path", F.col("order.event_id").alias("event_id"), "priority", "mode").write.mode(
            "overwrite"
        ).parquet(f"{base}/requests/batch={number}")

    count_accesses(log, Store(spark, f"{base}/store"), "access", keep, f"{base}/offsets").awaitTermination()
    return spark.read.schema(_REQUESTS).parquet(f"{base}/requests").drop("batch")
