"""Importance resampling of documents toward a target, by hashed word runs.

Words are lower-cased runs (A-Z only) of letters, digits and all characters beyond ASCII; the
features of a text are its runs of one to three consecutive words, joined by one blank and
counted with repeats. A feature falls into the bucket CRC-32 of its UTF-8 bytes modulo
``BUCKETS``. A bucket's gain is its smoothed log odds between the target's features and all
documents' features, in thousandths. A document's weight is the sum of its features' gains;
its score adds Gumbel noise drawn from its id, so that the highest scores are a draw without
replacement with probabilities in proportion to exp(weight / 1000).

CRC-32 is linear over XOR: the checksum of a span is the XOR of one contribution per byte,
which depends on the byte and its distance from the span's end only, and of a constant for
the span's length. A batch of texts is one row of bytes. A byte of a word is gathered from a
position table of ``BLOCK`` distances once per end it can have, that of its own word and of
the one or two words behind; ``bitwise_xor.reduceat`` folds each over the spans of the words,
and a run of words is the XOR of its words' parts. Longer spans are cut into blocks counted
from their end, and the blocks are folded pairwise, the farther one shifted by the bytes
behind it.

Two passes read the texts, one for the bucket counts and one for the weights: buckets of all
features would take more room than the texts, and computing them again costs less than
writing them. Only ``BUCKETS`` counts come to the driver. Ranks are places in a total order
dealt out by range; no task sees all scores.

Defined cases: null, empty and wordless texts have no features and weight 0. Null ids are
hashed as empty and come after all others of equal score. Repeated rows count and are ranked
each. An empty target or table leaves all gains at their smoothed value; an empty table gives
no rows. Input columns other than ``doc_id`` and ``text`` are ignored. Texts and words may
have any length.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classatlas.llm.common import in_order, written

BUCKETS = 10_000
LONGEST = 3
#: A document needs that many words to be drawn.
LEAST_WORDS = 20
#: Distances from the end that the position table has; a power of two.
BLOCK = 128
_SHIFT_OF_BLOCK = BLOCK.bit_length() - 1
#: The reflected polynomial of CRC-32; a fixed value.
POLYNOMIAL = 0xEDB88320
#: Bytes gathered at a time, so that the arrays stay in the processor's cache.
GATHERED = 1 << 17
#: Characters of texts that are looked at together.
TOGETHER = 1 << 17

_ONES = np.uint32(0xFFFFFFFF)


# -- checksums of spans -------------------------------------------------------

@functools.cache
def _byte_table() -> np.ndarray:
    register = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        register = np.where(register & 1, (register >> 1) ^ np.uint32(POLYNOMIAL), register >> 1).astype(np.uint32)
    return register


def _past_one_byte(registers: np.ndarray) -> np.ndarray:
    return (registers >> np.uint32(8)) ^ _byte_table()[registers & np.uint32(255)]


@functools.cache
def position_table() -> np.ndarray:
    """What byte b contributes at distance d from the end, at d * 256 + b."""
    rows = [_byte_table()]
    while len(rows) < BLOCK:
        rows.append(_past_one_byte(rows[-1]))
    return np.concatenate(rows)


@functools.cache
def _table_behind_ends() -> np.ndarray:
    """The same counted from the place behind the end, where nothing is contributed."""
    return np.concatenate([np.zeros(256, np.uint32), position_table()])


@functools.cache
def length_constants() -> np.ndarray:
    """Checksums of 0 to ``BLOCK`` zero bytes."""
    registers = [np.array([_ONES], np.uint32)]
    for _ in range(BLOCK):
        registers.append(_past_one_byte(registers[-1]))
    return np.concatenate(registers) ^ _ONES


@functools.cache
def _shift_table(power: int) -> np.ndarray:
    """How each byte of a register moves past 2 ** power zero bytes."""
    if power:
        before = _shift_table(power - 1)
        return np.stack([_shifted(row, before) for row in before])
    places = np.arange(256, dtype=np.uint32)
    return np.stack([_past_one_byte(places << np.uint32(8 * k)) for k in range(4)])


def _shifted(registers: np.ndarray, table: np.ndarray) -> np.ndarray:
    parts = [table[k][(registers >> np.uint32(8 * k)) & np.uint32(255)] for k in range(4)]
    return parts[0] ^ parts[1] ^ parts[2] ^ parts[3]


def _contributions(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XOR of the contributions of spans of 1 to ``BLOCK`` bytes."""
    ends = np.cumsum(lengths)
    place = np.arange(ends[-1])
    byte = data[place + np.repeat(starts - ends + lengths, lengths)]
    distance = np.repeat(ends - 1, lengths) - place
    return np.bitwise_xor.reduceat(position_table()[(distance << 8) | byte], ends - lengths)


def _long_contributions(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The same for spans of any length: blocks are counted from the end and folded pairwise."""
    blocks = -(-lengths // BLOCK)
    span = np.repeat(np.arange(len(starts)), blocks)
    nth = np.arange(len(span)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    ends = (starts + lengths)[span] - nth * BLOCK
    begins = np.maximum(ends - BLOCK, starts[span])
    value = _short_or_chunked(data, begins, ends - begins)
    power = _SHIFT_OF_BLOCK
    while len(span) > len(starts):
        odd = nth & 1 == 1
        value[odd] = _shifted(value[odd], _shift_table(power))
        nth, power = nth >> 1, power + 1
        heads = np.flatnonzero(np.concatenate([[True], (span[1:] != span[:-1]) | (nth[1:] != nth[:-1])]))
        value, span, nth = np.bitwise_xor.reduceat(value, heads), span[heads], nth[heads]
    return value


def _short_or_chunked(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``_contributions``, some spans at a time."""
    done, out = np.cumsum(lengths), []
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + GATHERED, "right")))
        out.append(_contributions(data, starts[at:upto], lengths[at:upto]))
        at = upto
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _constants(lengths: np.ndarray) -> np.ndarray:
    """The constant of any length: the start value moved past that many zero bytes."""
    if not len(lengths) or lengths.max() <= BLOCK:
        return length_constants()[lengths]
    registers, power = np.full(len(lengths), _ONES), 0
    while int(lengths.max()) >> power:
        odd = (lengths >> power) & 1 == 1
        registers[odd] = _shifted(registers[odd], _shift_table(power))
        power += 1
    return registers ^ _ONES


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of every span of ``data`` (bytes as numbers); spans may overlap and be empty."""
    lengths = ends - starts
    found = np.zeros(len(starts), np.uint32)
    short, long = np.flatnonzero((lengths > 0) & (lengths <= BLOCK)), np.flatnonzero(lengths > BLOCK)
    found[short] = _short_or_chunked(data, starts[short], lengths[short]) ^ length_constants()[lengths[short]]
    if len(long):
        found[long] = _long_contributions(data, starts[long], lengths[long]) ^ _constants(lengths[long])
    return found


# -- features -----------------------------------------------------------------

@functools.cache
def _letters() -> bytes:
    """What a byte of a text becomes: lower case, or a blank outside of words."""
    kept = lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80
    lower = lambda b: b + 32 if 0x41 <= b <= 0x5A else b
    return bytes(lower(b) if kept(lower(b)) else 0x20 for b in range(256))


def features_of(texts: list[str | None]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text; and for runs of 1, 2, ... words the buckets of all texts' runs and how many each text has."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b" ".join(raw).translate(_letters()) + b" ", np.uint8)
    in_word = data != 0x20
    before = np.concatenate([[False], in_word[:-1]])
    # each word, and one blank behind it
    kept = in_word | before
    compact, word = data[kept], in_word[kept]
    ends = np.flatnonzero(~word)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    places = np.flatnonzero(in_word & ~before)  # of first letters in the batch
    borders = np.cumsum([len(r) + 1 for r in raw])
    text_of = np.searchsorted(borders, places, "right")
    words = np.bincount(text_of, minlength=len(texts))
    runs = []
    for n, found in enumerate(_run_checksums(compact, starts, ends), 1):
        inside = text_of[: len(found)] == text_of[n - 1: n - 1 + len(found)]
        runs.append(((found[inside] % np.uint32(BUCKETS)).astype(np.int64), np.maximum(words - n + 1, 0)))
    return words, runs


def _run_checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Checksums of all runs of 1, 2, ... ``LONGEST`` neighbouring words; one byte follows each word."""
    n = len(starts)
    if not n:
        return [np.zeros(0, np.uint32)] * LONGEST
    widths = ends - starts + 1
    # distance 0 is the byte behind a word, which is no part of a run that ends there
    code = ((np.repeat(ends, widths) - np.arange(len(data))) << 8) | data
    table, limit = _table_behind_ends(), (BLOCK + 1 << 8) - 1
    parts, found = [], []
    for more in range(min(LONGEST, n)):
        gap = (ends[more:] - ends[: n - more]) << 8  # to the end of the word that many behind
        reach = int(starts[n - more]) if more else len(data)
        moved = code[:reach] + np.repeat(gap, widths[: n - more]) if more else code
        lengths = ends[more:] - starts[: n - more]
        if lengths.max() > BLOCK:
            moved = np.minimum(moved, limit)  # their runs are looked at below
        parts.append(np.bitwise_xor.reduceat(table[moved], starts[: n - more]))
        value = length_constants()[np.minimum(lengths, BLOCK)]
        for k in range(more + 1):
            value ^= parts[more - k][k: k + n - more]
        long = np.flatnonzero(lengths > BLOCK)
        if len(long):
            value[long] = checksums(data, starts[long], ends[long + more])
        found.append(value)
    return found + [np.zeros(0, np.uint32)] * (LONGEST - len(found))


def _in_parts(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows whose texts have about ``TOGETHER`` characters; a longer text is alone."""
    size = batch["text"].str.len().fillna(0).to_numpy(np.int64)
    part = np.cumsum(size) // TOGETHER
    for k in np.unique(part):
        yield batch[part == k]


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """How many features of all texts each bucket holds."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in _in_parts(batch):
                for buckets, _ in features_of(part["text"].tolist())[1]:
                    held += np.bincount(buckets, minlength=BUCKETS)
        used = np.flatnonzero(held)
        yield pd.DataFrame({"bucket": used, "n": held[used]})

    held = np.zeros(BUCKETS, np.int64)
    counted = rows.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # at most BUCKETS rows
        held[r["bucket"]] = r["n"]
    return held


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log odds of every bucket, rounded down."""
    all_target, all_source = int(target.sum()) + BUCKETS, int(source.sum()) + BUCKETS
    odds = (((int(t) + 1) * all_source) / ((int(s) + 1) * all_target) for t, s in zip(target, source))
    return np.array([math.floor(1000 * math.log(o)) for o in odds], np.int64)


def weighed(documents: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _in_parts(batch):
                words, runs = features_of(part["text"].tolist())
                weight, features = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                for buckets, counts in runs:
                    sums = np.concatenate([[0], np.cumsum(gain[buckets])])
                    ends = np.cumsum(counts)
                    weight += sums[ends] - sums[ends - counts]
                    features += counts
                yield pd.DataFrame({
                    "doc_id": np.where(part["no_id"], None, part["doc_id"]) if part["no_id"].any() else part["doc_id"],
                    "n_words": words, "n_features": features, "weight": weight})

    # a flag instead of null ids: whole numbers next to nulls would arrive as rounded ones
    rows = documents.select(F.isnull("doc_id").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text")
    return rows.mapInPandas(weigh, "doc_id long, n_words long, n_features long, weight long")


def _noise(seed: int) -> Column:
    """Thousandths of a Gumbel draw that depends on the id only."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(documents: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) per row of (doc_id, text); undrawn rows have no rank.

    The draw takes ``percent`` of the documents that have ``LEAST_WORDS`` words.
    """
    gain = gains(bucket_counts(target), bucket_counts(documents))
    scored = weighed(documents, gain).withColumn("score", F.col("weight") + _noise(seed))
    # read several times below; the number of the row sets equal rows apart
    rows = written(scored.withColumn("_row", F.monotonically_increasing_id()), "importance-scores")
    long_enough = F.col("n_words") >= LEAST_WORDS
    drawn = rows.where(long_enough).count() * percent // 100
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row"))
    ranked = in_order(rows.where(long_enough), *order, name="rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    short = rows.where(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", rank).unionByName(short).drop("_row")
