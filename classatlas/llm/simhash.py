"""SimHash near-duplicates: components of 64-bit fingerprints that differ in few bits.

A fingerprint bit is set if more than half of the XXH64 hashes (seed 42) of the text's
four-word shingles have it set; words are lower-cased (A-Z only), shingles are counted with
repeats, a shorter text is one shingle, and one without words has fingerprint zero. Texts of
equal fingerprint are one node. Nodes link at ``RADIUS`` or fewer differing bits.

Links are found by covering locality-sensitive hashing. Every bit position has a vector of
``RADIUS`` + 1 bits; the mask of a vector v takes the positions whose vectors have an odd
product with v. For any ``RADIUS`` positions some v has even products with all of their
vectors, so two fingerprints that differ there only are equal under the mask of that v: no
pair within the radius is missed, by structure and not by odds. The 31 masks take about half
of the positions each, so that unlike fingerprints seldom meet.

Nodes that are equal under a mask share a bucket. No bucket is compared pair by pair beyond
``SMALL`` nodes:

1. all nodes are compared with the least one of their bucket, and components are formed;
2. buckets whose nodes are in one component are done. Of the others, those of ``SMALL`` nodes
   or fewer are compared in full, as part of a join that emits links only;
3. larger ones are dealt out anew: the positions that their mask leaves free are covered
   by 31 masks of half of them, and 1 starts again. At most 31 masks down, ever fewer
   positions are free; with 8 or fewer a bucket cannot have more than 256 nodes.

So links between different components are all found, and work grows with the nodes.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other.
Repeated rows are rows of one component; null ids are in the component of their text, whose
name is null if it has no other ids. An empty table gives no rows; other columns are ignored.
Texts may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from classatlas.llm.common import written
from classatlas.llm.components import extended

SHINGLE, SEED = 4, 42
RADIUS = 4
#: Nodes of a bucket that are compared in full.
SMALL = 256
#: Free positions from which on buckets are compared in full: they have 2 ** 8 nodes at most.
FEW = 8
#: Shingles hashed before their bits are counted.
TOGETHER = 1 << 15

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


# -- fingerprints ---------------------------------------------------------------

def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or "").encode().translate(_LOWER).split()  # parts bytes at 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    hash_of, join = xxhash.xxh64_intdigest, b" ".join
    shingles = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, shingles, TOGETHER):
        some = range(at, min(at + TOGETHER, shingles))
        hashes = np.array([hash_of(join(words[k: k + SHINGLE]), SEED) for k in some], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > shingles, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in texts], dtype=np.int64)


# -- masks ------------------------------------------------------------------------

def masks(fixed: int = 0) -> list[int]:
    """``fixed`` with about half of the other positions, at least one, for each of the covering vectors."""
    free = [p for p in range(64) if not fixed >> p & 1]
    basis = [1 << k for k in range(RADIUS + 1)]
    # the basis comes first: with all of it no product is even for all positions, so every mask takes one
    vectors = basis + [v for v in range(1, 1 << RADIUS + 1) if v not in basis]
    vector_of = {p: vectors[k % len(vectors)] for k, p in enumerate(free)}
    return [fixed | sum(1 << p for p in free if (vector_of[p] & v).bit_count() & 1) for v in sorted(vectors)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


# -- links ------------------------------------------------------------------------

def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def _shared(keyed: DataFrame) -> DataFrame:
    """(mask, key, node, lead) of the nodes that are not alone in their bucket; ``lead`` is its least node."""
    leads = keyed.groupBy("mask", "key").agg(F.min("node").alias("lead"), F.max("node").alias("last"))
    # written, so that a hot bucket's rows can be split when they meet their lead
    several = written(leads.where("lead < last").drop("last"), "simhash-leads")
    return written(keyed.join(several, ["mask", "key"]), "simhash-members")


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def roots_of(nodes: DataFrame) -> DataFrame:
    """(node, root) of the nodes that have links: root is the least node of the component."""
    spark, roots = nodes.sparkSession, None
    tables = [_signed(m) for m in masks()]
    keyed = nodes.select("node", F.explode(F.array(*map(F.lit, tables))).alias("mask")).withColumn(
        "key", F.col("node").bitwiseAND(F.col("mask")))
    few = F.bit_count(F.bitwise_not("mask")) <= FEW
    meets = (
        (F.col("x.mask") == F.col("y.mask")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node"))
        & (F.col("x.root") != F.col("y.root")) & _near("x.node", "y.node"))
    while True:
        members = _shared(keyed)
        to_lead = members.where((F.col("node") != F.col("lead")) & _near("node", "lead"))
        roots = extended(roots, written(to_lead.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "simhash-links"))
        rooted = _rooted(members.drop("lead"), roots)
        state = rooted.groupBy("mask", "key").agg(
            F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n")).where("least < most")
        several = written(rooted.join(written(state.drop("least", "most"), "simhash-open"), ["mask", "key"]), "simhash-mixed")
        small = several.where((F.col("n") <= SMALL) | few)
        pairs = small.alias("x").join(small.alias("y"), meets).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        roots = extended(roots, written(pairs.distinct(), "simhash-links"))
        large = several.where((F.col("n") > SMALL) & ~few)
        used = [r["mask"] for r in large.select("mask").distinct().collect()]  # masks, not rows: at most 31, then 31 times 31
        if not used:
            return roots
        finer = spark.createDataFrame(
            [(m, [_signed(x) for x in masks(m & (1 << 64) - 1)]) for m in used], "mask long, finer array<long>")
        keyed = large.select("mask", "node").join(F.broadcast(finer), "mask").select(
            "node", F.explode("finer").alias("mask")).withColumn("key", F.col("node").bitwiseAND(F.col("mask"))).distinct()


def linked(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of (doc_id, text)."""
    rows = written(documents.select("doc_id", _fingerprints("text").alias("node")), "simhash-fingerprints")
    nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    rooted = nodes.join(roots_of(nodes.select("node")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = written(rooted.join(written(names, "simhash-names"), "root").select("node", "component_id"), "simhash-named")
    return rows.join(named, "node").select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
