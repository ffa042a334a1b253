"""URL filters: rules on a host and its subdomains with a path prefix, found by short hash prefixes.

A URL is expanded into the host suffixes and path prefixes under which a rule on it may be
filed. Each such expression is hashed; rules and expressions meet in an equi-join on the
first bytes of the digest, then the full digest and the rule's own path confirm the hit.

Rules are a table (host, path, verdict). A rule is filed under its host and its path up to
the last ``/``, so a rule whose path ends inside a segment is found too; the rest of its
path is compared after the join. Only host depths and path depths that some rule has are
expanded, which loses nothing and keeps long hosts and paths from growing the table.

Defined cases: null URLs and URLs without ``://`` have empty host and path and fit no rule;
rules with a null or empty host are ignored, a null path is an empty one; among fitting
rules the longest (host and path together, then host) wins, and of equal rules with
different verdicts ``block``. No fitting rule means ``allow``. Repeated URLs are judged once.
An empty table gives no rows; an empty rule table allows everything. Other columns of the
input are kept; input columns named like a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8
RESULT = ("host", "path", "rule", "verdict")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _depth(text: Column, separator: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(separator), F.lit("")))


def _filed_path(path: Column) -> Column:
    """The path up to and with its last ``/``."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _prepared(rules: DataFrame) -> DataFrame:
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    path = F.coalesce("path", F.lit(""))
    cleaned = rules.select(host.alias("r_host"), path.alias("r_path"), F.col("verdict").alias("r_verdict"))
    cleaned = cleaned.where("r_host <> '' AND r_verdict IS NOT NULL").groupBy("r_host", "r_path").agg(
        F.max("r_verdict").alias("r_verdict"))
    return cleaned.withColumn("r_digest", _digest(F.col("r_host"), _filed_path(F.col("r_path"))))


def expressions(urls: DataFrame, host_depth: int, path_depth: int) -> DataFrame:
    """One row per host suffix of at most ``host_depth`` dots and path prefix of at most ``path_depth`` slashes."""
    labels = F.split("host", r"\.")
    dots = F.size(labels) - 1
    suffixes = F.transform(
        F.sequence(F.lit(0), F.least(dots, F.lit(host_depth))),
        lambda k: F.array_join(F.slice(labels, -(k + 1), k + 1), "."))
    parts = F.split("path", "/")
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(path_depth))),
        lambda k: F.when(k == 0, F.lit("")).otherwise(
            F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(k, F.lit(1))), "/"), F.lit("/"))))
    expanded = urls.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    return expanded.withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))


def judge(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` to every row."""
    kept = [c for c in urls.columns if c.lower() not in RESULT]
    parsed = urls.select(*(F.col(f"`{c}`") for c in kept),
                         host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    filed = _prepared(rules)
    # one row: the depths that rules have
    depths = filed.agg(
        F.coalesce(F.max(_depth(F.col("r_host"), ".")), F.lit(-1)).alias("h"),
        F.coalesce(F.max(_depth(F.col("r_path"), "/")), F.lit(0)).alias("p")).first()
    if depths["h"] < 0:
        return parsed.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit("allow"))
    distinct = parsed.where("host <> ''").select("host", "path").distinct()
    spread = expressions(distinct, depths["h"], depths["p"])
    hits = (
        spread.join(filed, F.substring("digest", 1, PREFIX_HEX) == F.substring("r_digest", 1, PREFIX_HEX))
        .where(F.col("digest") == F.col("r_digest")).where(F.startswith("path", "r_path"))
    )
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"))
    found = F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = hits.groupBy("host", "path").agg(F.max_by(found, rank).alias("_best"))
    return (
        parsed.join(best, ["host", "path"], "left")
        .select(*(F.col(f"`{c}`") for c in kept), "host", "path", F.col("_best.rule").alias("rule"),
                F.coalesce("_best.verdict", F.lit("allow")).alias("verdict"))
    )
