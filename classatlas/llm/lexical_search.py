"""Ranked lexical search of all documents for a set of queries, the other way round.

Not the documents are indexed but the queries (items): an inverted index from every term of
the items to the items that hold it is broadcast, and documents stream through it. Each
document's counts of these terms are turned into whole-number scores of all items it touches,
which update one bounded heap per item in every task; the heaps are merged by a grouped limit.

Terms are lower-cased runs (A-Z only) of letters, digits and all characters beyond ASCII.
With N documents that have terms, L terms in all of them, n in one, and a term that df
documents hold and this one tf times, the term weighs w = floor(1000 ln((2N + 2) / (2df + 1)))
and scores w * (10^9 tf div (1000 tf + 12 m)), where m = 75 + (25 n N div L). A document's
score for an item is the sum over the item's terms, repeats included.

Two passes: the first reads the texts and writes each document's length and its counts of
item terms, from which N, L and df follow; the second scores these counts. Items go in
blocks of at most ``BLOCK_CHARS`` characters and ``BLOCK_ITEMS`` items (a longer item is a
block by itself), which bounds what is broadcast and the heaps of a task; every block is held
against all documents. Scoring runs in a few tasks per slot, each over many documents, so
that the number of heaps to merge depends on the cluster and not on the documents.

Defined cases: null, empty and termless documents are not found and count nowhere; items
without terms, or whose terms occur nowhere, have no rows. Equal scores are ordered by
document id, null ids last. Repeated documents are found each, repeated items have rows each.
Empty tables give no rows; other columns are ignored. Texts may have any length.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from classatlas.llm.common import shared_folder, written

TOP = 20
#: What one broadcast index may hold.
BLOCK_CHARS, BLOCK_ITEMS = 8_000_000, 10_000
#: Scores and postings that are looked at together.
TOGETHER = 1 << 20
_LAST = np.iinfo(np.int64).max


def _letters() -> bytes:
    """What a byte of a text becomes: lower case, or a blank outside of terms."""
    kept = lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80
    return bytes((b + 32 if 0x41 <= b <= 0x5A else b) if kept(b) else 0x20 for b in range(256))


LETTERS = _letters()


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LETTERS).split()


# -- the index of a block of items ---------------------------------------------

@dataclass
class ItemIndex:
    """For the term of number t: items ``item[start[t]:start[t + 1]]``, which hold it ``times`` often."""

    terms: dict[bytes, int]
    start: np.ndarray
    item: np.ndarray
    times: np.ndarray
    items: int

    @staticmethod
    def build(texts: list[str | None]) -> ItemIndex:
        terms: dict[bytes, int] = {}
        postings: list[list[tuple[int, int]]] = []
        for k, text in enumerate(texts):
            for term, times in Counter(terms_of(text)).items():
                number = terms.setdefault(term, len(terms))
                if number == len(postings):
                    postings.append([])
                postings[number].append((k, times))
        flat = np.array([p for of in postings for p in of], np.int64).reshape(-1, 2)
        start = np.concatenate([[0], np.cumsum([len(of) for of in postings])]).astype(np.int64)
        return ItemIndex(terms, start, flat[:, 0], flat[:, 1], len(texts))


def blocks_of(items: DataFrame) -> Iterator[list[Row]]:
    """The rows (item_id, text) in bounded lists; one partition of them is at the driver at a time."""
    block, chars = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        size = len(row["text"] or "")
        if block and (chars + size > BLOCK_CHARS or len(block) == BLOCK_ITEMS):
            yield block
            block, chars = [], 0
        block.append(row)
        chars += size
    if block:
        yield block


# -- documents through the index -----------------------------------------------

def counted(documents: DataFrame, index) -> DataFrame:
    """(no_id, doc_id, n, terms, times) of documents with terms: numbers of item terms and their counts, as 32-bit integers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = index.value.terms
        for batch in batches:
            rows = []
            for no_id, doc_id, text in zip(batch["no_id"], batch["doc_id"], batch["text"]):
                words = terms_of(text)
                if words:
                    held = [(number[w], n) for w, n in Counter(words).items() if w in number]
                    pairs = np.array(held, "<u4").reshape(-1, 2)
                    rows.append((no_id, doc_id, len(words), pairs[:, 0].tobytes(), pairs[:, 1].tobytes()))
            yield pd.DataFrame(rows, columns=["no_id", "doc_id", "n", "terms", "times"])

    rows = documents.select(F.isnull("doc_id").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text")
    return rows.mapInPandas(count, "no_id boolean, doc_id long, n long, terms binary, times binary")


def _numbers(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u4").astype(np.int64)


def document_frequencies(counts: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(terms, np.int64)
        for batch in batches:
            held += np.bincount(_numbers(batch["terms"]), minlength=terms)
        used = np.flatnonzero(held)
        yield pd.DataFrame({"term": used, "df": held[used]})

    held = np.zeros(terms, np.int64)
    for r in counts.select("terms").mapInPandas(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        held[r["term"]] = r["df"]  # at most one row per term of the block
    return held


class Heaps:
    """The best documents of every item so far; what cannot get in any more is turned away at once."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.floor, self.floor_id = np.zeros(items, np.int64), np.full(items, -1, np.int64)
        self.kept = [np.zeros(0, np.int64)] * 4  # item, score, id, whether the id is null
        self.waiting: list[list[np.ndarray]] = []
        self.room = 4 * items * top

    def offer(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        """A row of scores per document, one column per item."""
        ids = np.where(no_id, _LAST, ids)
        better = (scores > self.floor) | ((scores == self.floor) & (ids[:, None] < self.floor_id))
        at, item = np.nonzero(better)
        self.waiting.append([item, scores[at, item], ids[at], no_id[at].astype(np.int64)])
        if sum(len(w[0]) for w in self.waiting) > self.room:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        rows = [np.concatenate(c) for c in zip(self.kept, *self.waiting)]
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        rows = [c[order] for c in rows]
        heads = np.flatnonzero(np.diff(rows[0], prepend=-1))
        place = np.arange(len(order)) - np.repeat(heads, np.diff(heads, append=len(order)))
        last = place == self.top - 1
        self.floor[rows[0][last]], self.floor_id[rows[0][last]] = rows[1][last], rows[2][last]
        self.kept, self.waiting = [c[place < self.top] for c in rows], []
        return self.kept


def _offer_all(heaps: Heaps, batch: pd.DataFrame, index: ItemIndex, weight: np.ndarray, documents: int, length: int) -> None:
    """Scores the documents of a batch for all items, some documents at a time."""
    terms, times = _numbers(batch["terms"]), _numbers(batch["times"])
    held = batch["terms"].map(len).to_numpy() // 4
    of = np.repeat(np.arange(len(batch)), held)
    norm = np.array([75 + 25 * n * documents // length for n in batch["n"].tolist()], np.int64)
    value = weight[terms] * (1_000_000_000 * times // (1000 * times + 12 * norm[of]))
    reach = index.start[terms + 1] - index.start[terms]
    ids, no_id = batch["doc_id"].to_numpy(np.int64), batch["no_id"].to_numpy(bool)
    # so many documents that neither their postings nor their scores are too many
    borders = np.concatenate([[0], np.cumsum(held)])
    cost = np.diff(np.concatenate([[0], np.cumsum(reach)])[borders]) + index.items
    part = np.cumsum(cost) // TOGETHER
    for k in np.unique(part):
        some = np.flatnonzero(part == k)
        low, high = borders[some[0]], borders[some[-1] + 1]
        r = reach[low:high]
        ends = np.cumsum(r)
        posting = np.arange(ends[-1] if len(r) else 0) + np.repeat(index.start[terms[low:high]] - ends + r, r)
        place = np.repeat((of[low:high] - some[0]) * index.items, r) + index.item[posting]
        scores = np.zeros(len(some) * index.items, np.int64)
        np.add.at(scores, place, np.repeat(value[low:high], r) * index.times[posting])
        heaps.offer(scores.reshape(len(some), index.items), ids[some], no_id[some])


def _best_of_block(documents: DataFrame, block: list[Row], index, items: DataFrame, top: int) -> DataFrame:
    spark = documents.sparkSession
    counts = written(counted(documents, index), "search-counts")
    n, length = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(counts, len(index.value.terms))
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps = Heaps(index.value.items, top)
        for batch in batches:
            if len(batch):
                _offer_all(heaps, batch, index.value, weight, n, length)
        item, found, ids, no_id = heaps.settle()
        yield pd.DataFrame({"item": item, "score": found, "id": np.where(no_id, 0, ids), "no_id": no_id.astype(bool)})

    slots = spark.sparkContext.defaultParallelism
    partial = counts.coalesce(2 * slots).mapInPandas(score, "item long, score long, id long, no_id boolean")
    ordered = Window.partitionBy("item").orderBy(F.desc("score"), "no_id", "id")
    best = partial.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top)
    # one row per item of the block
    names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(block)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
    return best.join(F.broadcast(names), "item").select(
        "item_id", "rank", F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "score")


def search(items: DataFrame, documents: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents (doc_id, text) of every item (item_id, text) that score above 0."""
    spark, folder, schema = documents.sparkSession, None, None
    for block in blocks_of(items):
        index = spark.sparkContext.broadcast(ItemIndex.build([r["text"] for r in block]))
        best = _best_of_block(documents, block, index, items, top)
        folder, schema = folder or shared_folder(spark, "search-best"), best.schema
        best.write.mode("append").parquet(folder)
        index.destroy()  # one index at a time is held
    if folder is None:
        kind = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return spark.read.schema(schema).parquet(folder)
