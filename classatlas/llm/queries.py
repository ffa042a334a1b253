"""The named queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from classatlas.llm import (
    bpe, fingerprint, html_text, importance, language, lexical_search, mixing, near_duplicates, oracles, quality,
    simhash, token_shards, url_filter, warc,
)
from classatlas.llm.common import text_or_empty

#: The rules of the URL query; fixed values.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def read(spark: SparkSession, directory: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{table}.parquet")


def held_out() -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op1_language_id(spark: SparkSession, directory: str) -> DataFrame:
    documents = read(spark, directory, "documents").select("doc_id", "text", "lang")
    model = language.train(documents.where(~held_out()))
    return language.predict(documents.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_html_text(spark: SparkSession, directory: str) -> DataFrame:
    extracted = html_text.with_main_text(read(spark, directory, "pages"))
    return extracted.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_byte_bpe(spark: SparkSession, directory: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    trip = bpe.round_trip(text_or_empty("text"), path, public_tokenizers.PATTERN)
    return read(spark, directory, "documents").select("doc_id", trip.alias("trip")).select(
        "doc_id", (F.octet_length("trip.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("trip.ids", 256).alias("ids_sha256"), F.sha2("trip.decoded", 256).alias("decoded_sha256"))


def op4_url_filter(spark: SparkSession, directory: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.judge(read(spark, directory, "pages").select("page_id", "url"), rules).drop("url")


def op5_mix_sources(spark: SparkSession, directory: str) -> DataFrame:
    mixed = mixing.per_row(mixing.mix(read(spark, directory, "documents").select("doc_id", "text", "source")))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


def op6_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    judged = quality.apply_rules(read(spark, directory, "documents").select("doc_id", "lang", "text"))
    return judged.select("doc_id", *quality.RESULT)


def op7_warc(spark: SparkSession, directory: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(read(spark, directory, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_fingerprints(spark: SparkSession, directory: str) -> DataFrame:
    rows = fingerprint.with_edited(read(spark, directory, "documents").select("doc_id", "text"))
    sketch, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.as_text(sketch).alias("fingerprint"), fingerprint.as_text(edited).alias("edited_fingerprint"),
        fingerprint.likeness(sketch, edited).alias("near_edited"),
        fingerprint.likeness(sketch, following).alias("near_next"),
        fingerprint.containment(sketch, edited).alias("contained_in_edited"))


def op9_token_shards(spark: SparkSession, directory: str) -> DataFrame:
    manifest = token_shards.write_shards(
        read(spark, directory, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN)
    return token_shards.read_shards(manifest).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op10_near_duplicates(spark: SparkSession, directory: str) -> DataFrame:
    return near_duplicates.classes(read(spark, directory, "documents"))


def op11_importance(spark: SparkSession, directory: str) -> DataFrame:
    drawn = importance.resample(read(spark, directory, "documents"), read(spark, directory, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_lexical_search(spark: SparkSession, directory: str) -> DataFrame:
    return lexical_search.search(read(spark, directory, "benchmark"), read(spark, directory, "documents"))


def op13_simhash(spark: SparkSession, directory: str) -> DataFrame:
    return simhash.linked(read(spark, directory, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_html_text": op2_html_text,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_url_filter": op4_url_filter,
    "op5_mix_sources": op5_mix_sources,
    "op6_quality_rules": op6_quality_rules,
    "op7_warc": op7_warc,
    "op8_fingerprints": op8_fingerprints,
    "op9_token_shards": op9_token_shards,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_importance": op11_importance,
    "op12_lexical_search": op12_lexical_search,
    "op13_simhash": op13_simhash,
}

ORACLE_SQL: dict[str, str] = oracles.oracle_sql()
