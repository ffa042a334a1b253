"""From raw documents to token ids: five stages, each over all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next one's input. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from classatlas.llm import bpe, language, mixing, near_duplicates, quality
from classatlas.llm.common import text_or_empty, written
from classatlas.session import configure

#: A language is accepted from this score on; four even candidates would have 0.25.
LEAST_SCORE = 0.5

#: No SQL expresses learned languages, random mixing or merges; the tests hold small runs against brute force.
ORACLE_SQL = None


def _set_aside(docs: DataFrame, added: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """The rows with own columns renamed whose names an operator adds, and what brings the names back."""
    clashes = {c for c in docs.columns if c.lower() in set(added)}
    name = lambda c: f"_own_{c}" if c in clashes else c
    return (docs.select(*(F.col(f"`{c}`").alias(name(c)) for c in docs.columns)),
            [F.col(f"`{name(c)}`").alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is uncertain."""
    aside, back = _set_aside(docs, language.RESULT)
    judged = language.predict(aside, language.train(docs))
    accepted = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return judged.where(accepted).select(back)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that break a quality rule."""
    aside, back = _set_aside(docs, quality.added_columns())
    return quality.apply_rules(aside).where("kept").select(back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return near_duplicates.one_per_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources have their target shares of words."""
    return mixing.apply_copies(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digest of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    trip = bpe.round_trip(text_or_empty("text"), path, public_tokenizers.PATTERN)
    return docs.select("doc_id", "lang", "source", trip.alias("trip")).select(
        "doc_id", "lang", "source", (F.octet_length("trip.ids") / 4).cast("long").alias("n_tokens"),
        F.col("trip.ids").alias("ids"), F.sha2("trip.decoded", 256).alias("decoded_sha256"))


def _configured(stage):
    """A stage that sets what its plan relies on, such as small batches for Python, however it is called."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(configure(spark), docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", _configured(identify_language)),
    ("quality_rules", _configured(keep_good_quality)),
    ("near_duplicates", _configured(drop_near_duplicates)),
    ("mixing", _configured(mix_sources)),
    ("byte_bpe", _configured(encode)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
