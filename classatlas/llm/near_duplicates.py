"""Near-duplicates of whole texts by ProbMinHash, banding and exact verification.

A text is the bag of its five-word shingles (lower-cased words), each weighted by how often
it occurs. Every shingle has a Poisson process of arrivals, at a rate that is its weight;
an arrival hits one of ``COMPONENTS`` registers, and a register keeps the shingle of its
earliest hit. A shingle's arrivals end as soon as they come later than the latest of all
registers. Two texts agree in a register with the probability of their probability Jaccard
similarity, which for shingles of weight one is the Jaccard similarity. A text with repeated
shingles has a second signature, of its shingles with weight one; for others both are equal.

Texts with equal words are one node. Nodes that agree in all ``ROWS`` registers of one of
``BANDS`` bands of either signature share a bucket; at a similarity of 0.8 two miss each
other in all bands once in 16,000 pairs. A pair from a bucket counts if its weighted or its
unweighted signatures do not contradict it (four standard deviations) and its exact
similarity is at least ``THRESHOLD``: the larger of the Jaccard and the probability Jaccard
similarity of the shingles. Each of the two has the signature that estimates it.

Groups of any size cost no all-pairs join. In a bucket

1. all nodes are compared with the least one;
2. nodes not linked to it are compared with the bucket's most central node, the one most
   similar to the least one;
3. only nodes outside the bucket's largest class are compared with all other classes of it.
   The comparison is part of the join, and a pair is looked at in the first bucket it shares
   only, so what the join emits are links, not pairs.

Rows of a bucket or class meet one row per bucket or class only after that was written, so
that adaptive execution can split a hot bucket or class over tasks.

So no pair that shares a bucket is left out unless it already is in one class. Classes are
the connected components of the links; a class's name is its least document id.

Defined cases: null, empty and blank texts have no words, are like nothing, and each is its
own class. A text of fewer than five words is one shingle. Texts that differ in case or
white space only are equal. Repeated rows share a class; rows with a null id are in the
classes of their texts, and a class that has null ids only has a null name. An empty table
gives no rows. Other columns are ignored by ``classes`` and kept by ``one_per_class``.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from classatlas.llm.common import NOT_BLANK, computed_once, text_or_empty, written
from classatlas.llm.components import extended

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6
COMPONENTS = BANDS * ROWS
#: Registers that agree at least, four standard deviations below the threshold.
AGREE = int(COMPONENTS * THRESHOLD - 4 * (COMPONENTS * THRESHOLD * (1 - THRESHOLD)) ** 0.5)
#: Characters of texts, and bytes of words, that are hashed together.
TOGETHER = 1 << 19
#: Rates of the hash of words: an odd number, and where the values of bytes are drawn from; any will do.
BASE, SEED = 0x9FB21C651E98DF25, 2024

_STEP, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


# -- shingles -------------------------------------------------------------------

@functools.lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    row = np.full(n, base, np.uint64)
    row[0] = 1
    return np.cumprod(row)


@functools.cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, 256, np.uint64)


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, in order of their places: sums of byte values times powers of the place, mixed."""
    found = np.zeros(len(starts), np.uint64)
    inverse = pow(BASE, -1, 1 << 64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(ends, low + TOGETHER, "right")))
        high = int(ends[upto - 1])
        size = max(TOGETHER, 1 << (high - low).bit_length()) + 1
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_byte_values()[data[low:high]] * _powers(BASE, size)[: high - low], out=sums[1:])
        s, e = starts[at:upto] - low, ends[at:upto] - low
        found[at:upto] = (sums[e] - sums[s]) * _powers(inverse, size)[s] + (e - s).astype(np.uint64)
        at = upto
    return _mixed(found)


def shingled(texts: list[str | None]) -> tuple[list[bytes | None], list[np.ndarray]]:
    """Per text a digest of its words (none without words), and the hashes of its shingles."""
    raw = [(t or "").lower().encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    in_word = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    before = np.concatenate([[False], in_word[:-1]])
    kept = in_word | before
    word = in_word[kept]
    # each word, and one blank behind it
    compact = np.where(word, data[kept], np.uint8(0x20))
    ends = np.flatnonzero(~word)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    borders = np.cumsum([len(r) + 1 for r in raw])
    words = np.bincount(np.searchsorted(borders, np.flatnonzero(in_word & ~before), "right"), minlength=len(texts))
    last = np.cumsum(words)
    first = last - words
    runs = np.where(words > 0, np.maximum(words - SHINGLE + 1, 1), 0)
    # the first word of every shingle, and its last one
    done = np.cumsum(runs)
    opens = np.arange(done[-1] if len(done) else 0) + np.repeat(first - done + runs, runs)
    closes = np.minimum(opens + SHINGLE, np.repeat(last, runs)) - 1
    hashes = _span_hashes(compact, starts[opens], ends[closes])
    whole = compact.tobytes()
    nodes = [hashlib.md5(whole[starts[f]: ends[e - 1]]).digest() if e > f else None for f, e in zip(first, last)]
    return nodes, np.split(hashes, done[:-1])


def _in_parts(texts: pd.Series) -> Iterator[list[str | None]]:
    """The texts, about ``TOGETHER`` characters at a time."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size > TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


# -- signatures -------------------------------------------------------------------

def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each register of each bag (different shingles, weights) the (mixed) shingle that hits it first."""
    winner = np.zeros((len(bags), COMPONENTS), np.uint64)
    sizes = np.array([len(keys) for keys, _ in bags], np.int64)
    # few shingles need many arrivals each: they are drawn several at a time, with bags of about their size
    classes = np.where(sizes > 0, np.log2(np.clip(COMPONENTS // np.maximum(sizes, 1), 1, None)).astype(np.int64), -1)
    for scale in np.unique(classes[classes >= 0]):
        chosen = np.flatnonzero(classes == scale)
        winner[chosen] = _race([bags[k] for k in chosen], 2 << int(scale) if scale else 1)
    return winner


def _race(bags: list[tuple[np.ndarray, np.ndarray]], ahead: int) -> np.ndarray:
    """The arrivals of all shingles of all bags, ``ahead`` of each at a time, until no register can change."""
    keys = _mixed(np.concatenate([k for k, _ in bags]) + _STEP)
    weights = np.concatenate([w for _, w in bags]).astype(np.float64)
    bag = np.repeat(np.arange(len(bags)), [len(k) for k, _ in bags])
    earliest, winner = np.full(len(bags) * COMPONENTS, np.inf), np.zeros(len(bags) * COMPONENTS, np.uint64)
    clock, done = np.zeros(len(keys)), 0
    while len(keys):
        turns = np.arange(done + 1, done + ahead + 1, dtype=np.uint64)
        drawn = _mixed(keys[:, None] + turns * _STEP)
        waits = -np.log(((drawn >> np.uint64(12)) + np.uint64(1)) * 2.0**-52) / weights[:, None]
        times = clock[:, None] + np.cumsum(waits, axis=1)
        registers = (_mixed(drawn) % np.uint64(COMPONENTS)).astype(np.intp) + bag[:, None] * COMPONENTS
        early = times < earliest[registers]
        at, when = registers[early], times[early]
        who = np.broadcast_to(keys[:, None], times.shape)[early]
        np.minimum.at(earliest, at, when)
        best = when == earliest[at]
        winner[at[best]] = who[best]
        clock, done = times[:, -1], done + ahead
        going = clock < earliest.reshape(-1, COMPONENTS).max(1)[bag]
        keys, weights, clock, bag = keys[going], weights[going], clock[going], bag[going]
    return winner.reshape(-1, COMPONENTS)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The registers of one text's shingles, with repeats."""
    return signatures([np.unique(shingles.view(np.uint64), return_counts=True)])[0]


def _bands(winners: np.ndarray) -> np.ndarray:
    """One hash per band of each signature, different for equal contents of different bands."""
    rows = winners.reshape(-1, BANDS, ROWS)
    hashed = np.broadcast_to(_mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP), rows.shape[:2])
    for k in range(ROWS):
        hashed = _mixed(hashed * _M1 + rows[:, :, k])
    return hashed.view(np.int64)


@F.pandas_udf(T.StructType([
    T.StructField("node", T.BinaryType()), T.StructField("buckets", T.ArrayType(T.LongType())),
    T.StructField("sig", T.ArrayType(T.ShortType())), T.StructField("set_sig", T.ArrayType(T.ShortType()))]))
def _signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The digest of the words; hashes of the bands of both signatures, in order; the signatures, the second one only if shingles repeat."""
    for rows in batches:
        nodes, buckets, sigs, set_sigs = [], [], [], []
        for texts in _in_parts(rows):
            digests, shingles = shingled(texts)
            bags = [np.unique(s, return_counts=True) for s in shingles]
            again = [k for k, (_, counts) in enumerate(bags) if len(counts) and counts.max() > 1]
            winners = signatures(bags + [(bags[k][0], np.ones(len(bags[k][0]))) for k in again])
            bands, short = _bands(winners), winners.astype(np.uint16).view(np.int16)
            of_bag, of_set = list(np.sort(bands[: len(bags)], axis=1)), [None] * len(bags)
            for n, k in enumerate(again, len(bags)):
                of_bag[k], of_set[k] = np.unique(bands[[k, n]]), short[n]
            nodes += digests
            buckets += of_bag
            sigs += list(short[: len(bags)])
            set_sigs += of_set
        yield pd.DataFrame({"node": pd.Series(nodes, dtype=object), "buckets": pd.Series(buckets, dtype=object),
                            "sig": pd.Series(sigs, dtype=object), "set_sig": pd.Series(set_sigs, dtype=object)})


@F.pandas_udf(T.StructType([
    T.StructField("node", T.BinaryType()), T.StructField("set", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))]))
def _collected(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The digest of the words, the different shingles, and if some repeat, how often each occurs."""
    for rows in batches:
        nodes, sets, weights = [], [], []
        for texts in _in_parts(rows):
            digests, shingles = shingled(texts)
            for keys, counts in (np.unique(s, return_counts=True) for s in shingles):
                sets.append(keys.view(np.int64))
                weights.append(counts if len(counts) and counts.max() > 1 else None)
            nodes += digests
        yield pd.DataFrame({"node": pd.Series(nodes, dtype=object), "set": pd.Series(sets, dtype=object), "counts": pd.Series(weights, dtype=object)})


@F.pandas_udf(T.BinaryType())
def _node(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The digest of the words."""
    for rows in batches:
        nodes = [hashlib.md5(b" ".join((t or "").lower().encode().split())).digest() for t in rows]
        yield pd.Series(nodes, dtype=object)


def _levels(keys: Column, counts: Column) -> Column:
    """The shingles of every count that occurs; null without repeats."""
    return F.transform(F.array_distinct(counts), lambda n: F.struct(
        n.alias("n"), F.filter(keys, lambda _, i: F.get(counts, i) == n).alias("keys")))


def _jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _sum(rows: Column, value) -> Column:
    return F.aggregate(rows, F.lit(0).cast("long"), lambda done, row: done + value(row))


def _probability_jaccard(a: Column, b: Column) -> Column:
    """Per common shingle i of counts x and y: 1 / sum over all j of max(x_j / x_i, y_j / y_i).

    Common shingles of equal counts are one term. The larger ratio is x_j / x_i where x_j / y_j is not below x_i / y_i.
    """
    met = F.filter(F.flatten(F.transform(a, lambda p: F.transform(b, lambda q: F.struct(
        p["n"].alias("x"), q["n"].alias("y"), F.size(F.array_intersect(p["keys"], q["keys"])).cast("long").alias("n"))))),
        lambda g: g["n"] > 0)
    total = lambda levels: _sum(levels, lambda p: p["n"] * F.size(p["keys"]))

    def summed(g: Column) -> Column:
        groups, only_a, only_b = g["met"], g["only_a"], g["only_b"]
        return F.aggregate(groups, F.lit(0.0), lambda done, i: done + i["n"] / (
            (only_a + _sum(groups, lambda j: F.when(j["x"] * i["y"] >= i["x"] * j["y"], j["n"] * j["x"]).otherwise(0))) / i["x"]
            + (only_b + _sum(groups, lambda j: F.when(j["x"] * i["y"] < i["x"] * j["y"], j["n"] * j["y"]).otherwise(0))) / i["y"]))

    # arrays of one element hold what is used several times
    only = lambda m: F.struct(
        m.alias("met"), (total(a) - _sum(m, lambda g: g["n"] * g["x"])).alias("only_a"),
        (total(b) - _sum(m, lambda g: g["n"] * g["y"])).alias("only_b"))
    return F.get(F.transform(F.transform(F.array(met), only), summed), F.lit(0))


def similarity(set_a: Column, levels_a: Column, set_b: Column, levels_b: Column) -> Column:
    """The larger of the Jaccard and the probability Jaccard similarity; they are equal without repeats."""
    once = lambda keys: F.array(F.struct(F.lit(1).cast("long").alias("n"), keys.alias("keys")))
    weighted = levels_a.isNotNull() | levels_b.isNotNull()
    with_repeats = F.when(weighted, _probability_jaccard(F.coalesce(levels_a, once(set_a)), F.coalesce(levels_b, once(set_b))))
    return F.greatest(_jaccard(set_a, set_b), with_repeats)


def _agree(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) >= AGREE


def _plausible(sig_a: Column, set_sig_a: Column, sig_b: Column, set_sig_b: Column) -> Column:
    """The weighted or the unweighted signatures agree often enough."""
    repeats = set_sig_a.isNotNull() | set_sig_b.isNotNull()
    return _agree(sig_a, sig_b) | (repeats & _agree(F.coalesce(set_sig_a, sig_a), F.coalesce(set_sig_b, sig_b)))


class _Links:
    """Verifies pairs of nodes (a, b) and keeps the components of the links found."""

    def __init__(self, nodes: DataFrame):
        self.nodes, self.roots = nodes, None

    def verify(self, pairs: DataFrame) -> DataFrame:
        """(a, b, similarity) of the pairs that are links."""
        for side in "ab":
            pairs = pairs.join(self.nodes.select(
                F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("sig", "set_sig", "set", "levels"))), side)
        plausible = _plausible(*(F.col(c) for c in ("sig_a", "set_sig_a", "sig_b", "set_sig_b")))
        exact = similarity(*(F.col(c) for c in ("set_a", "levels_a", "set_b", "levels_b")))
        compared = pairs.where(plausible).select("a", "b", exact.alias("similarity"))
        return self.add(computed_once(compared, ["similarity"]).where(F.col("similarity") >= THRESHOLD))

    def add(self, links: DataFrame) -> DataFrame:
        found = written(links, "near-links")
        self.roots = extended(self.roots, found)
        return found


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _central_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members that are not linked to the least one of their bucket, with the member most similar to it."""
    to_lead = links.select(F.col("a").alias("lead"), F.col("b").alias("node"), "similarity")
    judged = members.where("node <> lead").join(to_lead, ["lead", "node"], "left")
    best = F.max(F.struct("similarity", "node")).alias("best")
    central = judged.where("similarity IS NOT NULL").groupBy("bucket").agg(best).select(
        "bucket", F.col("best.node").alias("center"))
    apart = judged.where("similarity IS NULL").join(written(central, "near-centers"), "bucket")
    return apart.select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct()


def _remaining_links(members: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between different classes in a bucket, at least one end outside the bucket's largest class.

    Shingles are compared by the join itself, so that only links leave it.
    """
    rooted = _rooted(members, roots).select("bucket", "place", "node", "root")
    sizes = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("classes"))
    split = largest.where("classes > 1").select("bucket", F.col("top.root").alias("top"))
    mixed = written(rooted.join(written(split, "near-split"), "bucket").join(nodes, "node"), "near-remaining")
    outside = mixed.where("root <> top").alias("x")
    # buckets are in order, so what both share before this one stands before it in both
    before = lambda side: F.slice(f"{side}.buckets", F.lit(1), F.col(f"{side}.place"))
    seen_before = F.arrays_overlap(before("x"), before("y"))
    plausible = _plausible(*(F.col(c) for c in ("x.sig", "x.set_sig", "y.sig", "y.set_sig")))
    exact = similarity(*(F.col(c) for c in ("x.set", "x.levels", "y.set", "y.levels"))) >= THRESHOLD
    both_outside = F.col("y.root") != F.col("y.top")
    meets = (
        (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") != F.col("y.root"))
        & (~both_outside | (F.col("x.node") < F.col("y.node"))) & ~seen_before & plausible & exact)
    return outside.join(mixed.alias("y"), meets).select(
        F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _classified(documents: DataFrame) -> DataFrame:
    """(doc_id, node, root) of every row that has words; equal words are one node."""
    texts = documents.where(~_wordless()).select("doc_id", "text")
    signed = texts.select("doc_id", F.xxhash64("text").alias("tie"), _signed("text").alias("s"))
    rows = written(signed.select("doc_id", "tie", "s.*"), "near-signatures")
    nodes = written(rows.groupBy("node").agg(
        F.min(F.struct("doc_id", "tie")).alias("rep"), F.first("buckets").alias("buckets"), F.first("sig").alias("sig"),
        F.first("set_sig").alias("set_sig")), "near-nodes")
    buckets = nodes.select("node", F.posexplode("buckets").alias("place", "bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last")
    members = written(buckets.join(written(shared.drop("last"), "near-leads"), "bucket"), "near-members")
    # the shingles of one row per node that shares a bucket; texts are joined before anything is computed of them
    wanted = members.select("node").distinct().join(nodes, "node")
    key = (F.isnull("doc_id").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tie")
    chosen = texts.withColumn("tie", F.xxhash64("text")).select(*key, "text").join(
        wanted.select("rep.*").select(*key), ["no_id", "id", "tie"], "left_semi").dropDuplicates(["no_id", "id", "tie"])
    collected = chosen.select(_collected("text").alias("c")).select(
        "c.node", "c.set", _levels(F.col("c.set"), F.col("c.counts")).alias("levels"))
    full = written(wanted.drop("rep").join(collected, "node"), "near-shingles")

    links = _Links(full)
    first = links.verify(members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())
    links.verify(_central_pairs(members, first))
    links.add(_remaining_links(members, full, links.roots))
    return _rooted(rows.select("doc_id", "node"), links.roots)


def _wordless() -> Column:
    return ~text_or_empty("text").rlike(NOT_BLANK)


def classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size), one row per row of (doc_id, text)."""
    rooted = _classified(documents)
    names = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    alone = documents.where(_wordless()).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return rooted.join(written(names, "near-names"), "root").select("doc_id", "class_id", "class_size").unionByName(alone)


def one_per_class(documents: DataFrame) -> DataFrame:
    """The rows of (doc_id, text, ...) that have the least id of their class, one of equal ones; rows without words stay."""
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "node")).alias("first")
    chosen = _classified(documents).groupBy("root").agg(first).select(
        F.col("first.node").alias("_node"), F.col("first.doc_id").alias("_id"))
    kept = documents.where(~_wordless()).withColumn("_node", _node("text")).join(chosen, "_node").where(
        F.col("doc_id").eqNullSafe(F.col("_id")))
    # of equal rows one, met before the exchange; rows of one id and equal words may differ otherwise
    names = [f"c{k}" for k in range(len(documents.columns))]
    row = F.struct(*(F.col(f"`{c}`").alias(n) for c, n in zip(documents.columns, names)))
    one = kept.groupBy("_node").agg(F.first(row).alias("row"))
    return one.select(*(F.col(f"row.{n}").alias(c) for c, n in zip(documents.columns, names))).unionByName(
        documents.where(_wordless()))
