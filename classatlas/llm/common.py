"""What several operators need: written intermediate tables, words, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed pattern of the contracts: a word is a run of characters other than blank and control spacing.
NOT_BLANK = "[^\\x20\\x09-\\x0D]"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"

_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Only a session on one machine that names no folder gets a temporary one.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    root = root or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _LOCAL_FOLDERS.setdefault(context.applicationId, tempfile.mkdtemp(prefix="classatlas-llm-"))
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """Write the rows once and read them back.

    Cuts the lineage, survives the loss of an executor, and lets Spark know the true
    size of the table, so that its own broadcast threshold decides later joins.
    """
    spark = frame.sparkSession
    path = shared_folder(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(text_or_empty(text), BLANK_RUN), lambda w: w != "")


def computed_once(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows, with ``columns`` behind a generator of one row.

    A filter on them above then uses their values; else the optimizer would move it below
    the projections and compute each of its columns anew from the text.
    """
    others = [c for c in rows.columns if c not in columns]
    return rows.select(*(F.col(f"`{c}`") for c in others), F.inline(F.array(F.struct(*columns))))


def shingles_of(words: Column, size: int) -> Column:
    """64-bit hashes of all runs of ``size`` words, repeats included; a shorter text is one shingle.

    ``words`` must be a column of the rows, not an expression: it is looked at once per run.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1)))
    runs = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(F.size(words) > 0, runs).otherwise(F.array().cast("array<bigint>"))


def unit_random(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns only, so that every run repeats it."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def in_order(rows: DataFrame, *order: Column, name: str) -> DataFrame:
    """Adds the place of every row in a total order, counted from 1.

    Rows are dealt out by range and written with their place in the range; the sizes of the
    ranges, one row per task of the exchange, give what stands before each. ``rows`` are read
    twice, so they should be a written table.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)  # the number of the task stands above the number of the row
    placed = written(ranged, "in-order").withColumn("_part", part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per task of the range exchange: small at every size of the table
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.col("_at") - F.shiftleft("_part", 33)
    return placed.join(F.broadcast(sizes), "_part").withColumn(
        name, F.col("_before") + within + 1).drop("_at", "_part", "_before")
