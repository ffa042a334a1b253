"""Connected components by alternating star contraction.

The least neighbours are written before the links meet them, so that adaptive execution can
split the links of a node that has very many. Links with a null end are ignored; links of a
node with itself and repeated links change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classatlas.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components-least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "components-least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the least node of its component.

    The number of rounds grows with the logarithm of the number of nodes; each is written
    out, and only a count and a sum per round come to the driver.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        edges = written(_small_star(_large_star(edges)), "components")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.withColumn("root", F.col("node")))


def extended(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``roots`` as ``components`` gives them with more ``links`` (a, b) taken in, written.

    Links are moved to the roots of their ends first, so that only components that meet are
    contracted. Without new links nothing is computed.
    """
    if roots is None:
        return written(components(links), "components-roots")
    end = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    moved = links.select("a", "b").join(end("a"), "a", "left").join(end("b"), "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a <> b")
    between = written(moved.distinct(), "components-between")
    if between.isEmpty():
        return roots
    merged = written(components(between).withColumnRenamed("root", "to"), "components-merged")
    old = roots.join(merged.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    new = merged.join(roots.select("node"), "node", "left_anti").select("node", F.col("to").alias("root"))
    return written(old.unionByName(new), "components-roots")
