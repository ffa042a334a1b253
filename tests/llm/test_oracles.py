"""Queries that SQL can express, against DuckDB, on given and on awkward tables."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from classatlas.llm import quality, queries
from tests.compare import connect, mismatch

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "one two three four five six seven eight nine ten"
AWKWARD_TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "word", LINE, f"{LINE}\n{LINE}", f"{LINE}\n \n{LINE} \n{LINE}\n",
    " ".join([LINE] * 40), "the of and " * 30, "#### $$ % & | <> * the " * 12, "no\u00a0break the of and " * 10,
    "a\u2003b \U0001F600\U0001F600 the of and " * 9, "x" * 200_000 + " the", "Reen Reen Reen the the the of of of " * 5,
    "\nthe\n\nthe\n", "der die das und " * 8, " ".join(f"w{k} the" for k in range(3000)),
]
POLISH = " ".join(f"zdanie{k} jest krótkie i jasne" for k in range(9))
RUSSIAN = " ".join(f"слово{k} стоит здесь" for k in range(9))
URLS = [
    None, "", "no host", "http://", "http:///en/", "https://EXAMPLE.com/en/x", "https://example.com/en", "http://www.example.com/en/",
    "http://a.www.example.com/en/q?x=/es/", "http://notexample.com/en/1", "http://example.com.net/es/", "http://x.net/es/#a",
    "ftp://NET/fr/", "http://net/fr", "http://com/", "http://com", "http://u@example.com:80/en/", "a://b://example.com/en/",
    "http://example.com\n/en/", "http://ÄA.net/fr/x", "http://" + ".".join("abc" * 40) + ".example.com/" + "d/" * 60,
]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_given_tables(session, name):
    directory = "/root/testdata/sf0.001"
    assert mismatch(queries.QUERIES[name](session, directory), connect(directory), queries.ORACLE_SQL[name]) is None


def _agrees(session, folder, table, name):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    assert mismatch(queries.QUERIES[name](session, folder), connection, queries.ORACLE_SQL[name]) is None


def test_awkward_texts_by_quality_rules(session, table):
    rows = [(k, t, None, None, None) for k, t in enumerate(AWKWARD_TEXTS + AWKWARD_TEXTS[:6])] + [(None, "the", "x", "y", 3)]
    rows += [(200 + k, t, lang, None, None) for k, (t, lang) in enumerate(
        (t, lang) for t in (POLISH, RUSSIAN, "the of and " * 30, LINE) for lang in (None, "", "pl", "en", "EN"))]
    _agrees(session, table("documents", rows, DOCUMENTS), "documents", "op6_quality_rules")


def test_texts_without_listed_stop_words_are_kept_where_the_list_does_not_apply(session):
    """Only a language of the list, or an unknown one in a script of the list, is held to its words."""
    rows = [(1, POLISH, "pl"), (2, RUSSIAN, None), (3, RUSSIAN, "ru"), (4, RUSSIAN, "en"), (5, POLISH, "en"), (6, POLISH, None)]
    frame = session.createDataFrame(rows, "doc_id int, text string, lang string")
    kept = lambda f: {r["doc_id"] for r in quality.apply_rules(f).where("kept").collect()}
    assert kept(frame) == {1, 2, 3, 4}
    assert kept(frame.drop("lang")) == {2, 3, 4}
    clashing = frame.withColumn("stop_words_known", F.lit(7)).withColumn("n_words", F.lit("x"))
    assert kept(clashing) == {1, 2, 3, 4}


def test_awkward_urls(session, table):
    rows = [(k, u, None) for k, u in enumerate(URLS + URLS[4:9])] + [(None, "http://a.net/es/", ""), (3, None, None)]
    _agrees(session, table("pages", rows, "page_id long, url string, html string"), "pages", "op4_url_filter")


def test_awkward_payloads(session, table):
    pages = ["<p>a</p>", None, "", "<p>a</p>", "é" * 70_000, "<p>a</p>", "\x00\r\n\r\nWARC/1.1\r\n"]
    urls = [None, "http://a b/\r\nX: y", "", "http://é/", "u", "u", "u"]
    rows = [(k, u, h) for k, (u, h) in enumerate(zip(urls, pages))] + [(None, "u", "<p>null id</p>"), ((1 << 60) + 1, "u", "<p>far</p>"), ((1 << 60) + 3, "u", "<p>far</p>")]
    _agrees(session, table("pages", rows, "page_id long, url string, html string"), "pages", "op7_warc")


@pytest.mark.parametrize(("name", "of", "schema"), [
    ("op4_url_filter", "pages", "page_id long, url string, html string"),
    ("op6_quality_rules", "documents", DOCUMENTS),
    ("op7_warc", "pages", "page_id long, url string, html string"),
])
def test_empty_table(session, table, name, of, schema):
    assert queries.QUERIES[name](session, table(of, [], schema)).count() == 0
