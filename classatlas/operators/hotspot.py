"""Access counters per artifact and the warm-up requests they trigger.

An access asks for a warm-up when it is an artifact's first or when the count
has reached a threshold, unless the artifact is warm already. Whether an access
is the first or at the threshold follows from at most ``threshold`` earliest
accesses per artifact, so accesses are never numbered one by one: an artifact
that receives a third of all accesses costs each task ``threshold`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classatlas.operators.skew import join_lookup

# Thresholds, report size, priorities and modes
WARMUP_THRESHOLD = 2
TOP_REPORT = 10
LOW, NORMAL, HIGH = 0, 1, 2
TOP_LEVEL_ONLY = "top-level-only"
ALL_CLASSES = "all-classes"


def state(log: DataFrame) -> DataFrame:
    """Counters per artifact from ``(jar_path, epoch, order, warmed, class_count)`` rows.

    Rows with ``warmed`` set mark the artifact warm and do not count as access.
    All aggregates are combined before the exchange.
    """
    access = ~F.col("warmed")
    return log.groupBy("jar_path").agg(
        F.count_if(access).alias("access_count"),
        F.coalesce(F.max(F.when(access, F.col("epoch"))), F.lit(0).cast("long")).alias("last_access"),
        F.bool_or("warmed").alias("warmed"),
        F.coalesce(
            F.max(F.when(F.col("warmed"), F.struct("order", "class_count")))["class_count"],
            F.lit(0).cast("long"),
        ).alias("class_count"),
    )


def marks(log: DataFrame, threshold: int, before: DataFrame | None = None) -> DataFrame:
    """``(jar_path, first_at, hot_from, was_warm, warm_from)`` of artifacts that were not warm before.

    The first access, the one that reaches the threshold, and the first warming event.
    """
    accesses = log.where(~F.col("warmed"))
    # the partial group limit keeps `threshold` rows per artifact and task
    earliest = accesses.select(
        "jar_path",
        "order",
        F.row_number().over(Window.partitionBy("jar_path").orderBy("order")).alias("n"),
    ).where(F.col("n") <= threshold)
    if before is None:
        earliest = earliest.withColumn("earlier", F.lit(0).cast("long")).withColumn("was_warm", F.lit(False))
    else:
        known = before.select(
            "jar_path", F.col("access_count").alias("earlier"), F.col("warmed").alias("was_warm")
        )
        earliest = earliest.join(known, "jar_path", "left").withColumns({
            "earlier": F.coalesce("earlier", F.lit(0)),
            "was_warm": F.coalesce("was_warm", F.lit(False)),
        })
    number = F.col("n") + F.col("earlier")
    reached = earliest.groupBy("jar_path").agg(
        F.min(F.when(number == 1, F.col("order"))).alias("first_at"),
        F.min(F.when(number >= threshold, F.col("order"))).alias("hot_from"),
        F.bool_or("was_warm").alias("was_warm"),
    )
    warm = log.where("warmed").groupBy("jar_path").agg(F.min("order").alias("warm_from"))
    return reached.join(warm, "jar_path", "left").where(~F.col("was_warm"))


def requests(log: DataFrame, threshold: int = WARMUP_THRESHOLD, before: DataFrame | None = None) -> DataFrame:
    """Warm-up requests: ``(jar_path, order, priority, mode)``, one per triggering access.

    ``order`` is any comparable column giving the sequence of events. ``before``
    holds the counters accumulated by earlier batches.
    """
    bounds = marks(log, max(threshold, 1), before)
    accesses = log.where(~F.col("warmed"))
    hot = F.col("order") >= F.col("hot_from")
    cold = F.col("warm_from").isNull() | (F.col("order") < F.col("warm_from"))
    return (
        join_lookup(accesses.select("jar_path", "order"), bounds, ["jar_path"])
        .where(cold & (hot | (F.col("order") == F.col("first_at"))))
        .select(
            "jar_path",
            "order",
            F.when(hot, F.lit(HIGH)).otherwise(F.lit(NORMAL)).cast("long").alias("priority"),
            F.when(hot, F.lit(ALL_CLASSES)).otherwise(F.lit(TOP_LEVEL_ONLY)).alias("mode"),
        )
    )


def rank_order() -> list[Column]:
    return [F.col("access_count").desc(), F.col("last_access").desc(), F.col("jar_path").asc()]


def top_unwarmed(hotspots: DataFrame, top: int) -> DataFrame:
    """The most accessed artifacts that are not warm; runs as a distributed top-k."""
    return hotspots.where(~F.col("warmed") & (F.col("access_count") > 0)).orderBy(*rank_order()).limit(top)


def top_accessed(hotspots: DataFrame, top: int = TOP_REPORT) -> DataFrame:
    return hotspots.orderBy(*rank_order()).limit(top)


def increments(log: DataFrame) -> DataFrame:
    """Rows to append to the hotspot table for a batch of events."""
    return state(log)


def warmed_marks(counts: DataFrame) -> DataFrame:
    """Rows that mark ``(jar_path, class_count)`` as warm."""
    return counts.select(
        "jar_path",
        F.lit(0).cast("long").alias("access_count"),
        F.lit(0).cast("long").alias("last_access"),
        F.lit(True).alias("warmed"),
        F.col("class_count").cast("long").alias("class_count"),
    )
