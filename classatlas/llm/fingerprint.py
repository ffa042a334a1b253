"""Document fingerprints: a sketch of all shingle hashes below a fixed fraction of their range.

The sketch of a text is the sorted set of those 64-bit hashes of its five-word shingles that
fall into the lowest ``FRACTION`` of the hash range. It grows with the text, so two texts of
very unequal length can be compared, and the sketch of a union is the union of the sketches.
A text with shingles but none in that part keeps its smallest hash, so that no text with
words has an empty sketch; a union drops such a hash again as soon as it has others.

``neighbours`` pairs every document with the next one by id without an order over the whole
table in one task: ids alone are dealt out by range, each range finds its own successors,
and the first ids of the ranges, one row per range, link one range to the next.

Everything is column expressions. Texts move once, by key; the next document's part moves
with its sketch to the document before it.

Defined cases: null text is empty, with an empty sketch; two empty sketches have likeness
1, an empty and another one 0. Texts of fewer than five words are one shingle. Null ids come
first. Equal ids are ordered by a hash of the text; of equal rows each but the last has its
equal as the next. The only row of a table is its own next. An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classatlas.llm.common import shingles_of, text_or_empty, words_of, written

FRACTION = 1 / 8
SHINGLE = 5
_LIMIT = -(1 << 63) + int((1 << 64) * FRACTION)


def with_sketch(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds the sketch of ``text`` as an array of longs."""
    hashed = rows.withColumn("_words", words_of(text)).withColumn("_hashes", shingles_of(F.col("_words"), SHINGLE)).withColumn(
        "_low", F.array_distinct(F.filter("_hashes", lambda h: h < _LIMIT)))
    smallest = F.when(F.size("_hashes") > 0, F.array(F.array_min("_hashes"))).otherwise(F.col("_low"))
    return hashed.withColumn(
        name, F.when(F.size("_low") > 0, F.sort_array("_low")).otherwise(smallest)).drop("_words", "_hashes", "_low")


def merged(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together."""
    both = F.array_union(a, b)
    low = F.filter(both, lambda h: h < _LIMIT)
    return F.when(F.size(low) > 0, F.sort_array(low)).when(
        F.size(both) > 0, F.array(F.array_min(both))).otherwise(both)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    common, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(all_ == 0, F.lit(1.0)).otherwise(common / all_)


def containment(a: Column, b: Column) -> Column:
    """Estimated part of the shingles of ``a`` that ``b`` has too."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(sketch: Column) -> Column:
    """16 hexadecimal digits per hash, in order."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


#: What tells documents apart, in their order.
KEY = ("has_id", "id", "tie")


def _keyed(documents: DataFrame) -> DataFrame:
    """(has_id, id, tie, text): null ids are kept apart by a flag, so that keys have no nulls."""
    text = text_or_empty("text")
    return documents.select(
        F.isnotnull("doc_id").alias("has_id"), F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.xxhash64(text).alias("tie"), text.alias("text"))


def neighbours(keys: DataFrame) -> DataFrame:
    """Adds ``next_has_id``, ``next_id`` and ``next_tie`` to rows with different keys."""
    ranged = written(
        keys.repartitionByRange(*KEY).withColumn("range", F.spark_partition_id()), "fingerprint-ids")
    within = Window.partitionBy("range").orderBy(*KEY)
    # one row per range
    firsts = ranged.groupBy("range").agg(F.min(F.struct(*KEY)).alias("first"))
    ranges = Window.orderBy("range")
    everything = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    linked = firsts.select("range", F.coalesce(
        F.lead("first").over(ranges), F.first("first").over(everything)).alias("after"))
    following = ranged.withColumn("next", F.lead(F.struct(*KEY)).over(within)).join(linked, "range")
    chosen = F.coalesce("next", "after")
    return following.select(*keys.columns, *(chosen[c].alias(f"next_{c}") for c in KEY))


def _quarter() -> Column:
    return F.floor(F.length("text") / 4).cast("int")


def with_next(documents: DataFrame) -> DataFrame:
    """(doc_id, text, sketch, next_start, next_sketch) per row of (doc_id, text).

    ``next_start`` is as much of the start of the next document as a quarter of this one has
    characters.
    """
    keyed = _keyed(documents)
    # both joins below need texts and sketches by key: one exchange serves both
    dealt = with_sketch(keyed, F.col("text"), "sketch").repartition(*KEY).withColumn(
        "nth", F.row_number().over(Window.partitionBy(*KEY).orderBy(*KEY)))
    pairs = neighbours(keyed.select(*KEY, _quarter().alias("quarter")).distinct())
    on_next = [F.col(f"p.next_{c}") == F.col(f"n.{c}") for c in KEY]
    starts = pairs.alias("p").join(dealt.where("nth = 1").alias("n"), on_next).select(
        *(F.col(f"p.{c}").alias(c) for c in KEY),
        F.substring("n.text", F.lit(1), F.col("p.quarter")).alias("next_start"), F.col("n.sketch").alias("next_sketch"))
    last = F.lead("nth").over(Window.partitionBy(*KEY).orderBy("nth")).isNull()
    own_start = F.substring("text", F.lit(1), _quarter())
    return dealt.join(starts, list(KEY), "left").withColumn("_last", last).select(
        F.when(F.col("has_id"), F.col("id")).alias("doc_id"), "text", "sketch",
        F.when(F.col("_last"), F.col("next_start")).otherwise(own_start).alias("next_start"),
        F.when(F.col("_last"), F.col("next_sketch")).otherwise(F.col("sketch")).alias("next_sketch"))


def with_edited(documents: DataFrame) -> DataFrame:
    """Adds ``edited``, the text whose last quarter is replaced by the start of the next one, and its sketch."""
    rows = with_next(documents)
    kept = F.length("text") - _quarter()
    edited = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), kept), "next_start"))
    return with_sketch(edited, F.col("edited"), "edited_sketch")
