"""Language identification by multinomial naive Bayes over hashed character n-grams.

Text is lower-cased and everything but letters becomes a blank; runs of 1 to ``ORDER``
characters are hashed into ``BUCKETS``. Training counts buckets per language over a bounded
sample of labelled rows, ``per_language`` rows each on average. The counts become a matrix of smoothed log probabilities, buckets by languages, which
goes to the tasks as a broadcast. A batch is scored sparsely: the rows of the matrix that
belong to the n-grams of a text are added up; the whole text counts, in slices of bounded
size.

The score is the posterior probability of the language found, with equal prior odds and
the evidence of ``EVIDENCE`` n-grams at the text's own mean: overlapping n-grams are far
from independent, and the plain posterior of any longer text would be 1.

Defined cases: a text that is null or has no letter is ``und`` with score 0. Ties go to the
language first in code point order. Without any labelled row every text is ``und``. Null
labels and null texts are not learned from. Repeated rows get equal results; an empty table
gives no rows. Other columns are kept; input columns named like a result are replaced. More
than ``MAX_LANGUAGES`` labels are refused, which bounds the broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classatlas.llm.common import unit_random

ORDER = 3
BUCKETS = 1 << 16
SMOOTHING = 0.5
PER_LANGUAGE = 2000
MAX_LANGUAGES = 500
SLICE = 1 << 18
EVIDENCE = 20
UNKNOWN = "und"
RESULT = ("lang_pred", "score")

_OTHERS = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


class Model(NamedTuple):
    languages: list[str]
    log_probability: np.ndarray  # buckets x languages


def buckets_of(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of a text, in slices."""
    letters = f" {_OTHERS.sub(' ', text.lower()).strip()} "
    codes = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(codes), SLICE):
        hashed = np.zeros(min(SLICE, len(codes) - at), np.uint32)
        for n in range(ORDER):
            part = codes[at + n: at + n + len(hashed)]
            hashed = (hashed[: len(part)] ^ part) * _MULTIPLIERS[n]
            hashed ^= hashed >> np.uint32(15)
            yield hashed & np.uint32(BUCKETS - 1)


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(text, lang): ``per_language`` rows of each language on average, the same ones in every run.

    The share of a language's rows follows from its count; a row is in by a hash of its id
    and text, so no task has to see all rows of a language.
    """
    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = usable.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], per_language / r["count"])))
    chosen = unit_random(F.col("doc_id"), F.col("text")) < (share[F.col("lang")] if counts else F.lit(0.0))
    return usable.where(chosen).select("text", "lang")


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fits on rows (doc_id, text, lang). Buckets are counted in the tasks; the driver gets languages x buckets numbers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                if lang not in counts:
                    counts[lang] = np.zeros(BUCKETS, np.int64)
                for buckets in buckets_of(text):
                    counts[lang] += np.bincount(buckets, minlength=BUCKETS)
        for lang, row in counts.items():
            used = np.flatnonzero(row)
            yield pd.DataFrame({"lang": lang, "bucket": used, "n": row[used]})

    counted = sample(labelled, per_language).mapInPandas(count, "lang string, bucket long, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    np.add.at(counts, (rows["bucket"].to_numpy(np.int64), np.searchsorted(languages, rows["lang"].to_numpy(str))), rows["n"].to_numpy())
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def score_text(text: str | None, model: Model) -> tuple[str, float]:
    if not text or not model.languages or not _LETTER.search(text):
        return UNKNOWN, 0.0
    total, n = np.zeros(len(model.languages)), 0
    for buckets in buckets_of(text):
        total += model.log_probability[buckets].sum(axis=0, dtype=np.float64)
        n += len(buckets)
    best = int(total.argmax())
    odds = (total - total[best]) * min(1.0, EVIDENCE / n)
    return model.languages[best], float(1 / np.exp(odds).sum())


def predict(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to every row; only the text is looked at."""
    shared = documents.sparkSession.sparkContext.broadcast(tuple(model))

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = Model(*shared.value)
        for texts in batches:
            yield pd.DataFrame([score_text(t, fitted) for t in texts], columns=list(RESULT))

    kept = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in RESULT]
    return documents.select(*kept, judge(F.col(f"`{text}`")).alias("_found")).select(*kept, "_found.*")
