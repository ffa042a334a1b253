"""Mixing sources to target weights by pivotal dependent rounding.

Targets: sources in code point order (null last) get weights that repeat, and share the
words of all sources by weight. A target stops at ``limit`` times its source's words; the
excess goes to the others by weight until none is above its limit.

Copies: a document of a source should be taken ``target / source words`` times. The whole
part is sure. The fractional part of each document is settled by pivotal rounding: two
documents of a source trade words, in a random direction whose odds keep every expected
value, until one of them is taken wholly or not at all; the other goes on. Trades are in
words, so the words taken from a source change only when its very last open document is
drawn: the result is off its target by less than that one document.

Documents that hold at least 1/``LARGE`` of their source's words come first, largest first.
Each trades with all later documents of its source as if these were one, which then share
the gain or loss evenly; so the last open document of a source is a small one. There are at
most ``LARGE`` of them per source, whatever its size.

All others trade in a reduction tree. Documents of a source fall by hash into groups of ``GROUP``
on average, each reduced to at most one open document by one pass over the group, largest
first; the open ones form the next level. Each level is one exchange of small rows (no
texts), written out. A source of any size is split over many groups.

Randomness is a hash of the documents and the seed, so reruns agree.

Defined cases: null text has no words; such documents get the whole part only. Null
sources are one source. Null or repeated ids are allowed: a row is known by its id, size
and a hash of id, source and text; equal rows are drawn as one with the sum of their copies,
which they share evenly. An empty table gives no rows; other columns are ignored by ``mix``
and kept by ``apply_copies``.
One row per source is kept in a table; its order needs one task over these rows, which are
sources, not documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classatlas.llm.common import text_or_empty, unit_random, written

GROUP = 64
LARGE = 256
WEIGHTS = (5, 2, 1)
LIMIT = 3
WORD = "[^\\x20\\x09-\\x0D]+"


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size, row_hash, equal): different documents and how many rows each has."""
    return documents.select(
        "doc_id", "source",
        F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("long").alias("size"),
        row_hash().alias("row_hash")).groupBy("doc_id", "source", "size", "row_hash").agg(F.count("*").alias("equal"))


def row_hash() -> Column:
    return F.xxhash64(F.isnull("doc_id"), "doc_id", F.isnull("source"), "source", F.isnull("text"), "text")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, n_docs, target), one row per source.

    Sources reach their limit in order of words per weight. With the first k of that order
    at their limit, the others share what is left by weight; k is the first count for which
    the next source stays within its limit.
    """
    per_source = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("equal")).alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*(F.lit(float(w)) for w in weights))
    ranked = per_source.withColumn("weight", F.get(listed, (F.row_number().over(by_name) - 1) % len(weights)))
    ranked = ranked.withColumn("most", limit * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = ranked.withColumn("total", F.sum("source_size").over(everything)).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    # the share per weight of the first source that stays within its limit holds for all after it
    settled = shared.withColumn(
        "level", F.first(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level")), True).over(everything))
    target = F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return settled.select("source", "source_size", "n_docs", target.alias("target"))


def _traded(member_type: str, seed: int) -> Column:
    """One pass over ``members``: ``done`` has settled documents, ``open`` the one still open, if any.

    ``mass`` is the number of words of a document that are to be taken, between 0 and its size.
    """
    def step(state: Column, doc: Column) -> Column:
        held = state["open"]
        up = F.least(held["size"] - held["mass"], doc["mass"])  # words that may go to the held one
        down = F.least(held["mass"], doc["size"] - doc["mass"])  # and away from it
        gains = unit_random(held["row_hash"], doc["row_hash"], F.lit(seed)) * (up + down) < down
        held_mass = F.when(gains, held["mass"] + up).otherwise(held["mass"] - down)
        doc_mass = F.when(gains, doc["mass"] - up).otherwise(doc["mass"] + down)
        # which side is settled is read off the limit that was met, free of rounding errors
        held_full = gains & (held["size"] - held["mass"] <= doc["mass"])
        held_empty = ~gains & (held["mass"] <= doc["size"] - doc["mass"])
        doc_empty = gains & (doc["mass"] <= held["size"] - held["mass"])
        doc_full = ~gains & (doc["size"] - doc["mass"] <= held["mass"])
        held_now = held.withField("mass", F.when(held_full, held["size"]).when(held_empty, 0.0).otherwise(held_mass))
        doc_now = doc.withField("mass", F.when(doc_empty, 0.0).when(doc_full, doc["size"]).otherwise(doc_mass))
        held_settled, doc_settled = held_full | held_empty, doc_empty | doc_full
        traded = F.struct(
            F.concat(state["done"], F.filter(
                F.array(F.when(held_settled, held_now), F.when(doc_settled, doc_now)), lambda x: x.isNotNull())
            ).alias("done"),
            F.when(~held_settled, held_now).when(~doc_settled, doc_now).alias("open"))
        first = F.struct(state["done"].alias("done"), doc.alias("open"))
        return F.when(held.isNull(), first).otherwise(traded)

    start = F.struct(F.expr(f"CAST(array() AS array<{member_type}>)").alias("done"),
                     F.expr(f"CAST(NULL AS {member_type})").alias("open"))
    return F.aggregate(F.sort_array("members"), start, step)


def _large_first(member_type: str, seed: int) -> Column:
    """One pass over the large ``members`` of a source, each against all documents after it.

    The later ones have ``words`` words, ``mass`` of them to be taken. A trade changes what
    each of them holds to ``keep`` times its mass plus ``add`` times its size. ``open`` is a
    document left open because the later ones could give or take no more; they are settled then.
    """
    def step(state: Column, doc: Column) -> Column:
        mass = F.least(F.greatest(state["keep"] * doc["mass"] + state["add"] * doc["size"], F.lit(0.0)), doc["size"])
        words = state["words"] - doc["size"]
        rest = F.least(F.greatest(state["mass"] - mass, F.lit(0.0)), words)
        up, down = F.least(doc["size"] - mass, rest), F.least(mass, words - rest)
        gains = unit_random(doc["row_hash"], F.lit(seed), F.lit("large")) * (up + down) < down
        settled = state["open"].isNotNull() | F.when(gains, doc["size"] - mass <= rest).otherwise(mass <= words - rest)
        value = F.when(state["open"].isNotNull(), mass).otherwise(F.when(gains, doc["size"]).otherwise(0.0))
        lost = F.when(gains & (rest > 0), up / rest).otherwise(0.0)  # parts of what the later ones hold or lack
        won = F.when(~gains & (words > rest), down / (words - rest)).otherwise(0.0)
        still = state["open"].isNotNull()
        settled_doc, open_doc = doc.withField("mass", value), doc.withField("mass", F.when(gains, mass + up).otherwise(mass - down))
        return F.struct(
            F.concat(state["done"], F.filter(F.array(F.when(settled, settled_doc)), lambda x: x.isNotNull())).alias("done"),
            F.coalesce(state["open"], F.when(~settled, open_doc)).alias("open"),
            words.alias("words"),
            F.when(still, rest).when(gains, rest - up).otherwise(rest + down).alias("mass"),
            F.when(still, state["keep"]).otherwise(state["keep"] * (1 - lost) * (1 - won)).alias("keep"),
            F.when(still, state["add"]).otherwise(state["add"] * (1 - lost) * (1 - won) + won).alias("add"))

    start = F.struct(F.expr(f"CAST(array() AS array<{member_type}>)").alias("done"),
                     F.expr(f"CAST(NULL AS {member_type})").alias("open"),
                     F.col("words"), F.col("mass"), F.lit(1.0).alias("keep"), F.lit(0.0).alias("add"))
    return F.aggregate(F.sort_array("members"), start, step)


FIELDS = ("negative_size", "row_hash", "doc_id", "size", "mass", "equal")


def settle_large(shares: DataFrame, seed: int) -> DataFrame:
    """(source, done, open, keep, add): the large documents of each source settled, and the change for the rest."""
    member_type = shares.select(*FIELDS).schema.simpleString()
    large = F.col("size") * LARGE >= F.col("source_size")
    return written(
        shares.groupBy("source").agg(
            F.collect_list(F.when(large, F.struct(*FIELDS))).alias("members"),
            F.sum("size").alias("words"), F.sum("mass").alias("mass"))
        .select("source", _large_first(member_type, seed).alias("passed")).select("source", "passed.*"),
        "mixing-large")


def _drawn(rows: DataFrame, seed: int) -> DataFrame:
    """The last open documents, one per source at most, taken or not by chance."""
    taken = unit_random(F.col("row_hash"), F.lit(seed), F.lit("last")) * F.col("size") < F.col("mass")
    return rows.select("source", *FIELDS).withColumn("mass", F.when(taken, F.col("size")).otherwise(0.0))


def _same_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    return rows.alias("r").join(per_source.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")), "left")


def rounded(shares: DataFrame, n_largest: int, seed: int = 0) -> DataFrame:
    """(source, doc_id, row_hash, size, equal, extra) for rows with ``mass``, ``source_size`` and ``n``, the rows of their source.

    ``n_largest`` is the largest ``n``; it gives the height of the tree.
    """
    shares = shares.withColumn("negative_size", -F.col("size"))
    member_type = shares.select(*FIELDS).schema.simpleString()
    large = settle_large(shares, seed)
    changed = F.col("p.keep") * F.col("r.mass") + F.col("p.add") * F.col("r.size")
    small = _same_source(shares.where(F.col("size") * LARGE < F.col("source_size")), large).select(
        "r.*", F.least(F.greatest(changed, F.lit(0.0)), F.col("r.size")).alias("_mass")).drop("mass").withColumnRenamed("_mass", "mass")
    is_open = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    settled = [
        large.select("source", F.inline("done")).select("source", *FIELDS),
        _drawn(large.where("open IS NOT NULL").select("source", "open.*"), seed),
        small.where(~is_open).select("source", *FIELDS)]
    rows, level = small.where(is_open), 0
    while True:
        groups = F.greatest(F.ceil(F.col("n") / GROUP), F.lit(1))
        slot = F.pmod(F.xxhash64("row_hash", F.lit(seed), F.lit(level)), groups)
        reduced = written(
            rows.groupBy("source", slot.alias("slot"))
            .agg(F.collect_list(F.struct(*FIELDS)).alias("members"), F.first(groups).alias("n"))
            .select("source", "n", _traded(member_type, seed + level).alias("passed")),
            f"mixing-level{level}")
        settled.append(reduced.select("source", F.inline("passed.done")).select("source", *FIELDS))
        # a source has at most one open document per group, so its next n is its number of groups
        rows = reduced.where("passed.open IS NOT NULL").select("source", "n", "passed.open.*")
        n_largest, level = -(-n_largest // GROUP), level + 1
        if n_largest <= 1:
            break
    result = _drawn(rows, seed)
    for part in settled:
        result = result.unionByName(part)
    return result.select("source", "doc_id", "row_hash", F.col("size").cast("long").alias("size"), "equal",
                         (F.col("mass") > 0).cast("long").alias("extra"))


def mix(documents: DataFrame, weights: Sequence[float] = WEIGHTS, limit: float = LIMIT, seed: int = 0) -> DataFrame:
    """(doc_id, source, row_hash, size, equal, source_size, target, copies), one row per different document.

    ``copies`` is for its ``equal`` rows together.
    """
    sizes = written(sized(documents), "mixing-sizes")
    plan = written(targets(sizes, weights, limit), "mixing-targets")
    largest = plan.agg(F.coalesce(F.max("n_docs"), F.lit(0)).alias("n")).first()["n"]
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)

    def with_source(rows: DataFrame) -> DataFrame:
        return _same_source(rows, plan).select(
            "r.*", "p.source_size", "p.n_docs", "p.target", (rate * F.col("r.equal")).alias("rate"))

    rated = with_source(sizes).withColumn("part", F.col("rate") - F.floor("rate"))
    is_open = (F.col("size") > 0) & (F.col("part") > 0)
    shares = rated.where(is_open).select(
        "source", "doc_id", "row_hash", F.col("size").cast("double").alias("size"), "equal", "source_size",
        (F.col("part") * F.col("size")).alias("mass"), F.col("n_docs").alias("n"))
    sure = rated.where(~is_open).select(
        "source", "doc_id", "row_hash", "size", "equal", F.lit(0).cast("long").alias("extra"))
    settled = with_source(rounded(shares, largest, seed).unionByName(sure))
    return settled.select("doc_id", "source", "row_hash", "size", "equal", "source_size", "target",
                          (F.floor("rate") + F.col("extra")).cast("long").alias("copies"))


def _share(copies: Column, equal: Column, nth: Column) -> Column:
    """Copies of the nth of equal rows."""
    return F.floor(copies / equal) + (nth <= copies % equal).cast("long")


def per_row(mixed: DataFrame) -> DataFrame:
    """One row per document row, with its own ``copies``."""
    rows = mixed.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("equal"))))
    return rows.withColumn("copies", _share(F.col("copies"), F.col("equal"), F.col("_nth"))).drop("_nth", "equal")


def apply_copies(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents themselves, each as often as its ``copies`` say."""
    chosen = mixed.where("copies > 0").select(
        F.col("row_hash").alias("_mix_row"), F.col("copies").alias("_mix_copies"), F.col("equal").alias("_mix_equal"))
    joined = documents.withColumn("_mix_row", row_hash()).join(chosen, "_mix_row")
    nth = F.row_number().over(Window.partitionBy("_mix_row").orderBy("_mix_row"))
    share = _share(F.col("_mix_copies"), F.col("_mix_equal"), nth)
    times = joined.withColumn("_mix_times", share).where("_mix_times > 0")
    return times.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_times")))).select(
        *(F.col(f"`{c}`") for c in documents.columns))
