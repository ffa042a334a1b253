"""Names under which the batches of a stream are committed."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class BatchTags:
    """Tags of the micro-batches of one query, the same when Spark repeats a batch.

    Batch numbers start again with every new checkpoint folder, so the id that
    Spark keeps there is part of the tag: batches of different streams never
    pass for one another. The id is read with the first batch of the query.
    """

    def __init__(self, name: str, checkpoint: str):
        self.name, self.checkpoint, self._id = name, checkpoint.rstrip("/"), None

    def of(self, spark: SparkSession, number: int) -> str:
        if self._id is None:
            metadata = spark.read.text(f"{self.checkpoint}/metadata").first()["value"]
            self._id = json.loads(metadata)["id"]
        return f"{self.name}:{self._id}:{number}"
