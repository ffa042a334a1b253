"""Quality rules: a table of measures and thresholds compiled into one projection.

Each rule names a measure (a column expression over the text), and a lowest and a highest
value. ``apply_rules`` computes all measures and a verdict in one pass over the row, with
no user function and no exchange.

Defined cases: a null, empty or blank text has no words and zero measures and fails the
first rule. Repeated rows and other columns are left as they are; input columns named like
a result column are replaced. An empty table gives no rows.

The stop-word rule judges only texts whose language has words in ``STOP_WORDS``: ``lang`` is one
of ``STOP_LANGUAGES`` or unknown (null, or no such column), and the text has at most 1.5 bytes
a character, which texts in another script exceed. Others are judged by the remaining rules.

Repeated windows are found by 64-bit hashes of eight words; within one text of a million
words the chance of a false repeat is below one in a million.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classatlas.llm.common import NOT_BLANK, computed_once, shingles_of, text_or_empty, words_of

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Frequent words of the languages below; running text in one of them contains some.
STOP_LANGUAGES = ("en", "de", "fr", "es")
MOST_BYTES = 1.5
STOP_WORDS = (
    "the of and to in is that it for was on with as by at this from are be have not or an "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le les et des en un du une que est pour qui dans par au sur il ne pas plus "
    "el los las y del se por con una su para al lo como más o"
).split()


class Rule(NamedTuple):
    """A measure must lie between ``least`` and ``most``; None leaves that side open.

    With ``where``, a measure that is true or false, the rule holds for the rows where it is true.
    """

    measure: str
    least: float | None
    most: float | None
    where: str | None = None


#: Rules of the base verdict and of the method. Ratios are per word or per line.
BASE_RULES = (Rule("n_words", 20, None), Rule("repeat_percent", None, 30))
RULES = (
    *BASE_RULES,
    Rule("mean_word_length", 2, 15),
    Rule("symbol_ratio", None, 0.25),
    Rule("stop_word_ratio", 0.02, None, "stop_words_known"),
    Rule("dup_line_ratio", None, 0.5),
    Rule("stutter_ratio", None, 0.3),
)
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _places_of_repeats() -> Column:
    """Start of every window that occurs twice or more, in order; neighbours in ``_by_hash`` are compared."""
    last = F.size("_by_hash") - 1
    repeated = F.filter(
        "_by_hash",
        lambda x, k: ((k > 0) & (F.get("_by_hash", k - 1)["h"] == x["h"]))
        | ((k < last) & (F.get("_by_hash", k + 1)["h"] == x["h"])))
    return F.sort_array(F.transform(repeated, lambda x: x["i"]))


def _covered_words() -> Column:
    """Words in the union of the windows that start at ``_places``."""
    return F.aggregate(
        "_places", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
        lambda done, at: F.struct(
            (done["n"] + F.least(F.lit(WINDOW), at - done["at"])).alias("n"), at.alias("at")),
        lambda done: done["n"])


def _stop_words_known(text: Column, lang: Column) -> Column:
    listed = F.lower(lang).isin(*STOP_LANGUAGES)
    return F.coalesce(listed, F.lit(True)) & (F.octet_length(text) <= MOST_BYTES * F.length(text))


def measures(text: Column, lang: Column) -> dict[str, Column]:
    """Layers of measures; a layer may use the columns of those before it."""
    lines = F.filter(F.split(text_or_empty(text), "\n", -1), lambda x: x.rlike(NOT_BLANK))
    words = F.col("_words")
    per_word = lambda c: F.col(c) / F.greatest("n_words", F.lit(1))
    indexed = F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    return {
        "_words": words_of(text),
        "_lines": lines,
        "_hashes": shingles_of(words, WINDOW),
        # only the few texts that have repeats at all are sorted
        "_by_hash": F.when(repeats, F.sort_array(indexed)),
        "_places": _places_of_repeats(),
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text_or_empty(text), F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(_covered_words(), F.lit(0)).cast("long"),
        "stop_words_known": _stop_words_known(text_or_empty(text), lang),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
        "n_stutters": F.size(F.filter(
            words, lambda w, i: (i > 0) & (F.get(words, i - 1) == w))).cast("long"),
        "repeat_percent": 100 * per_word("n_repeat_words"),
        "mean_word_length": per_word("word_chars"),
        "symbol_ratio": per_word("n_symbols"),
        "stop_word_ratio": per_word("n_stop_words"),
        "stutter_ratio": per_word("n_stutters"),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    }


def added_columns() -> set[str]:
    """Names of the columns that ``apply_rules`` adds."""
    return {*measures(F.lit(""), F.lit("")), "base_failed", "kept"}


def _passes(rule: Rule) -> Column:
    value, verdict = F.col(rule.measure), F.lit(True)
    if rule.least is not None:
        verdict = verdict & (value >= rule.least)
    if rule.most is not None:
        verdict = verdict & (value <= rule.most)
    return verdict if rule.where is None else ~F.col(rule.where) | verdict


def _all(rules) -> Column:
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & _passes(rule)
    return verdict


def apply_rules(
    documents: DataFrame, text: str = "text", rules=RULES, base=BASE_RULES, lang: str = "lang"
) -> DataFrame:
    """Every row with all measures, ``base_failed`` and ``kept``."""
    known = F.col(f"`{lang}`") if lang in documents.columns else F.lit(None).cast("string")
    layers = measures(F.col(f"`{text}`"), known)
    taken, own = {*layers, "base_failed", "kept"}, (text, lang)
    rows = documents.select(*(F.col(f"`{c}`") for c in documents.columns if c.lower() not in taken or c in own))
    for name, column in layers.items():
        rows = rows.withColumn(name, column)
    judged = rows.withColumn("base_failed", ~_all(base)).withColumn("kept", ~F.col("base_failed") & _all(rules))
    public = [name for name in layers if not name.startswith("_")]
    return computed_once(judged.drop(*(set(layers) - set(public))), [*public, "base_failed", "kept"])
