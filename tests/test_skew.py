"""Joins whose keys hold very different numbers of rows."""

from __future__ import annotations

import pytest

from classatlas.operators import skew


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_equals_one_join(spark, how):
    keys = ["hot"] * 300 + ["warm"] * 200 + [f"k{i % 40}" for i in range(400)] + [None] * 5
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i long")
    lookup = spark.createDataFrame(
        [(k, f"v{k}") for k in ["hot", "k1", "k2", "k39", "absent", None]], "k string, v string"
    )
    def collected(frame):
        return sorted((tuple(row) for row in frame.collect()), key=str)

    assert collected(skew.join_lookup(rows, lookup, ["k"], how)) == collected(rows.join(lookup, ["k"], how))


def test_hot_key_is_split_by_the_engine(spark):
    """Rows of one key spread over tasks, although the lookup is an aggregate."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rows = spark.range(400_000, numPartitions=8).selectExpr("IF(id % 10 < 9, 0, id) AS k", "uuid() AS filler")
        lookup = spark.range(1000).selectExpr("id % 500 AS k").groupBy("k").count()
        joined = skew.join_lookup(rows, lookup, ["k"])
        joined.write.format("noop").mode("overwrite").save()
        counts = joined.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    assert sum(counts) > 360_000 and max(counts) < sum(counts) / 3
