"""Keeping the cache fresh from streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from classatlas.operators import content
from classatlas.sources.store import Store
from classatlas.streaming.tags import BatchTags


def write_sources(
    writes: DataFrame, store: Store, name: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Upsert a stream of ``(fqn, jar_path, content, source, seq)`` into the cache.

    A micro-batch is one run of the store; the source's rate limit sets its size
    and the trigger its pace. A repeated batch is recognised by its tag. Errors
    stop the query instead of being lost.
    """
    tags = BatchTags(name, checkpoint)

    def flush(batch: DataFrame, number: int) -> None:
        tag = tags.of(batch.sparkSession, number)
        if not store.has_run(tag):
            with store.run(tag):
                store.write("class_sources", content.keep_last(batch))

    return (
        writes.writeStream.foreachBatch(flush)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
