"""Operators without SQL against plain Python, and cases that every operator must bear."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import pytest
import xxhash

import corpus_pipeline
from classatlas.llm import fingerprint, language, mixing, near_duplicates, queries, warc

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


# -- language: naive Bayes by dictionaries -------------------------------------------

def _buckets(text):
    letters = f" {re.sub(r'[^a-zA-ZäöüßéèàñçÄÖÜ]+', ' ', text.lower()).strip()} "
    for k in range(len(letters)):
        hashed = 0
        for n, multiplier in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
            if k + n == len(letters):
                break
            hashed = (hashed ^ ord(letters[k + n])) * multiplier & 0xFFFFFFFF
            hashed ^= hashed >> 15
            yield hashed % 65536


def _naive_bayes(learned, text):
    counts = collections.defaultdict(collections.Counter)
    for known, lang in learned:
        counts[lang].update(_buckets(known))
    grams = list(_buckets(text))
    total = {}
    for lang in sorted(counts):
        everything = sum(counts[lang].values()) + 0.5 * 65536
        total[lang] = sum(math.log((counts[lang][b] + 0.5) / everything) for b in grams)
    best = max(total, key=total.get)  # of equals the first in order of names
    return best, 1 / sum(math.exp((t - total[best]) * min(1, 20 / len(grams))) for t in total.values())


def test_language_equals_dictionary_counts(session):
    draw = random.Random(41)
    words = {"de": "der und die katze größe über".split(), "en": "the cat and dog of house".split(), "fr": "le chat été à garçon et".split()}
    learned = [(" ".join(draw.choice(words[lang]) for _ in range(draw.randint(1, 30))), lang) for lang in words for _ in range(25)]
    asked = ["the", "und über", "le et la", "a", "xyz", "The CAT, und 12 le!", " ".join(words["fr"] * 40), *(" ".join(draw.choice(sum(words.values(), [])) for _ in range(9)) for _ in range(40))]
    model = language.train(session.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(learned)], "doc_id long, text string, lang string"))
    found = language.predict(session.createDataFrame([(k, t) for k, t in enumerate(asked)], "doc_id long, text string"), model).collect()
    for r in found:
        label, score = _naive_bayes(learned, r["text"])
        assert (r["lang_pred"], r["score"]) == (label, pytest.approx(score, abs=2e-3))


def test_languages_of_equal_score(session):
    """Languages learned from equal texts are equal: the first in order of names, with its share."""
    rows = [(k, "same words here", lang) for k, lang in enumerate(["b", "a", "c"])]
    model = language.train(session.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = language.predict(session.createDataFrame([(1, "words")], "doc_id long, text string"), model).collect()
    assert [(r["lang_pred"], round(r["score"], 6)) for r in found] == [("a", round(1 / 3, 6))]


# -- fingerprints: sets of hashes ------------------------------------------------------

def _hash_of(words):
    value = 42
    for word in words:
        value = xxhash.xxh64_intdigest(word.encode(), value)
    return value - (1 << 64) if value >> 63 else value


def _sketch(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    hashes = {_hash_of(words[k: k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    low = {h for h in hashes if h < -(1 << 63) + (1 << 61)}
    return sorted(low or ({min(hashes)} if hashes else ()))


def test_sketches_equal_sets_of_hashes(session, table):
    draw = random.Random(42)
    texts = [None, "", "one", "a b c d", "é ß 漢 x y z", *(" ".join(f"w{draw.randint(0, 300)}" for _ in range(n)) for n in (5, 6, 40, 700, 60_000))]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    found = {r["doc_id"]: r for r in queries.op8_fingerprints(session, table("documents", rows, DOCUMENTS)).collect()}
    for k, text in enumerate(texts):
        text, following = text or "", texts[(k + 1) % len(texts)] or ""
        quarter = len(text) // 4
        own, edited, other = _sketch(text), _sketch(text[: len(text) - quarter] + following[:quarter]), _sketch(following)
        assert found[k]["fingerprint"] == "".join(f"{h & (1 << 64) - 1:016x}" for h in own)
        assert found[k]["edited_fingerprint"] == "".join(f"{h & (1 << 64) - 1:016x}" for h in edited)
        like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
        assert (found[k]["near_edited"], found[k]["near_next"]) == (pytest.approx(like(own, edited)), pytest.approx(like(own, other)))


# -- very long texts, clashing names ------------------------------------------------------

def test_very_long_texts(session, table):
    draw = random.Random(43)
    long = " ".join(f"w{draw.randint(0, 9_999)}" for _ in range(150_000))
    rows = [(1, long, "en", "s", 0), (2, f"{long} more", "en", "s", 0), (3, "short text of six words only", "en", "t", 0), (4, "x" * 1_000_000, "en", "t", 0)]
    folder = table("documents", rows, DOCUMENTS)
    docs = session.read.parquet(f"{folder}/documents.parquet")
    assert {r["doc_id"]: r["class_id"] for r in queries.op10_near_duplicates(session, folder).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert sorted(r["doc_id"] for r in near_duplicates.one_per_class(docs).collect()) == [1, 3, 4]
    sizes = {r["doc_id"]: (r["size"], r["source_size"]) for r in queries.op5_mix_sources(session, folder).collect()}
    assert sizes == {1: (150_000, 300_001), 2: (150_001, 300_001), 3: (6, 7), 4: (1, 7)}
    kept = corpus_pipeline.mix_sources(session, docs, folder)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} <= {1, 2, 3, 4}


def test_clashing_names(session):
    docs = session.createDataFrame(
        [(k, f"word{k} and some more words of a text", "en", "s", "x", "x", "x", "x", "x") for k in range(6)],
        "doc_id long, text string, lang string, source string, ids string, sketch string, trip string, edited string, tie string")
    assert corpus_pipeline.encode(session, docs, "").where("n_tokens > 5").count() == 6
    assert fingerprint.with_edited(docs).count() == 6
    assert mixing.per_row(mixing.mix(docs)).count() == 6
    pages = session.createDataFrame([(1, "u", "<p>a</p>", "x", "x"), (2, "u", "<p>a</p>", "y", "y")],
                                    "page_id long, url string, html string, record_type string, payload string")
    found = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert found == {1: ("revisit", 2), 2: ("response", None)}
    assert hashlib.md5(b"a b").digest() == near_duplicates.shingled(["A\tb"])[0][0]
