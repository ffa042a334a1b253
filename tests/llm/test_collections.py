"""Mixing, fingerprints, near-duplicates and the pipeline, against brute force on small tables."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from classatlas.llm import components, fingerprint, mixing, near_duplicates, queries, url_filter

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def _words(draw, n):
    return " ".join(f"w{draw.randint(0, 5000)}" for _ in range(n))


def _water(sizes, weights=(5, 2, 1), limit=3):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-6 and free:
        share = left / sum(weight[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += share * weight[s]
            if target[s] >= limit * sizes[s]:
                left += target[s] - limit * sizes[s]
                target[s] = limit * sizes[s]
                free.discard(s)
    return target


def test_mixing(session, table):
    draw = random.Random(2)
    rows = [(k, _words(draw, draw.choice([1, 3, 40, 900])), None, draw.choice(["a", "B", "é", "z", "hot", "hot", "hot", None]), None)
            for k in range(600)]
    rows += [(600, None, None, "a", None), (601, " ", None, "empty", None), (None, "one two", None, "a", None)] + [(602, "x y z", None, "z", None)] * 5
    folder = table("documents", rows, DOCUMENTS)
    found = queries.op5_mix_sources(session, folder).collect()
    again = queries.op5_mix_sources(session, folder).collect()
    assert sorted(map(str, found)) == sorted(map(str, again)) and len(found) == len(rows)
    sizes = collections.Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len((text or "").split())
    target = _water(sizes)
    source_of = {i: s for i, _, _, s, _ in rows} | {None: "a"}
    taken = collections.Counter()
    for r in found:
        source = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(target[source])
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        taken[source] += r["taken"]
    for source, words in target.items():
        assert abs(taken[source] - words) <= max(900, sizes[source] / 50)
    for weight in ((5, 2, 1), (1,)):
        mixed = mixing.mix(session.read.parquet(f"{folder}/documents.parquet"), weight)
        repeated = mixing.apply_copies(session.read.parquet(f"{folder}/documents.parquet"), mixed)
        assert repeated.count() == mixed.selectExpr("sum(copies)").first()[0]
        assert repeated.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_columns_of_clashing_names_are_kept(session):
    rows = [(k, f"w{k} the of and " * 8, "en", "s", 1, "a", "b", "c", "d") for k in range(12)] * 2
    schema = "doc_id long, text string, lang string, source string, copies long, row_hash string, best string, kept string, score string"
    docs = session.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(session, docs, "")
        assert out.columns == docs.columns
        assert {(r["copies"], r["row_hash"], r["best"], r["kept"], r["score"]) for r in out.collect()} <= {(1, "a", "b", "c", "d")}
    rules = session.createDataFrame([("a.b", "/", "block")], "host string, path string, verdict string")
    urls = session.createDataFrame([("http://a.b/", "x", "y")], "url string, best string, host string")
    assert [tuple(r) for r in url_filter.judge(urls, rules).collect()] == [("http://a.b/", "x", "a.b", "/", "a.b/", "block")]


def test_every_document_is_taken_as_often_as_expected(session):
    """Over many seeds the mean number of copies is the source's rate, for large and small documents."""
    rows = [(k, "w " * (50 if k % 7 == 0 else 3), "a" if k % 2 else "b") for k in range(40)]
    frame = session.createDataFrame(rows, "doc_id long, text string, source string")
    copies, rates, runs = collections.Counter(), {}, 12
    for seed in range(runs):
        for r in mixing.mix(frame, (2, 1), seed=seed).collect():
            copies[r["doc_id"] % 7 == 0, r["source"]] += r["copies"]
            rates[r["source"]] = r["target"] / r["source_size"]
    for (large, source), n in copies.items():
        rows_of = [k for k, _, s in rows if s == source and (k % 7 == 0) == large]
        assert n / runs / len(rows_of) == pytest.approx(rates[source], abs=0.25)


def _shingles(text):
    words = text.split()
    return {tuple(words[k: k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints(session, table):
    draw = random.Random(3)
    texts = [None, "", "é\U0001F600x " * 9, "a b", *(_words(draw, draw.choice([2, 30, 800])) for _ in range(60))]
    rows = [(5 * k - 7, t, None, None, None) for k, t in enumerate(texts)]
    draw.shuffle(rows)
    found = {r["doc_id"]: r for r in queries.op8_fingerprints(session, table("documents", rows, DOCUMENTS)).collect()}
    rows.sort()
    for k, (i, text, *_) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        assert found[i]["n_chars"] == len(text) and found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = _shingles(text), _shingles(edited)
        if len(a) > 300:
            assert found[i]["near_edited"] == pytest.approx(len(a & b) / len(a | b), abs=0.2)
            assert found[i]["near_next"] < 0.05
        assert (found[i]["fingerprint"] == "") == (not a) and 0 <= found[i]["near_next"] <= 1


def test_fingerprints_of_ties(session, table):
    rows = [(1, "same text", None, None, None)] * 3 + [(1, "other", None, None, None), (None, "x " * 40, None, None, None), (None, None, None, None, None)]
    found = queries.op8_fingerprints(session, table("documents", rows, DOCUMENTS)).collect()
    assert len(found) == len(rows)
    prints = {r["fingerprint"] for r in found if r["doc_id"] == 1 and r["n_chars"] == 9}
    assert len(prints) == 1
    alone = queries.op8_fingerprints(session, table("documents", [(1, "a b c d e f g h", None, None, None)], DOCUMENTS)).collect()
    assert alone[0]["near_next"] == 1.0
    assert queries.op8_fingerprints(session, table("documents", [], DOCUMENTS)).count() == 0


def test_sketch_of_a_union(session):
    from pyspark.sql import functions as F

    draw = random.Random(4)
    frame = session.createDataFrame([(_words(draw, 300), _words(draw, n)) for n in (0, 1, 6, 40, 2000)], "a string, b string")
    frame = fingerprint.with_sketch(fingerprint.with_sketch(frame, F.col("a"), "sa"), F.col("b"), "sb")
    for r in frame.select("sa", "sb", fingerprint.merged(F.col("sa"), F.col("sb")).alias("m"),
                          fingerprint.containment(F.col("sa"), F.col("m")).alias("c")).collect():
        low = {h for h in (*r["sa"], *r["sb"]) if h < fingerprint._LIMIT}
        assert set(r["m"]) == low and r["c"] == 1.0


def _bag(text):
    words = (text or "").lower().split()
    return collections.Counter(tuple(words[k: k + 5]) for k in range(max(1, len(words) - 4))) if words else None


def _similar(a, b):
    jaccard = len(a.keys() & b.keys()) / len(a.keys() | b.keys())
    keys = a.keys() | b.keys()
    return max(jaccard, sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in keys) for i in a.keys() & b.keys()))


def _classes(rows):
    bags, root = [_bag(t) for _, t, *_ in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if bags[a] and bags[b] and (rows[a][1].lower().split() == rows[b][1].lower().split() or _similar(bags[a], bags[b]) >= 0.8):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    named = collections.defaultdict(list)
    for k, row in enumerate(rows):
        named[find(k)].append(row[0])
    return {k: min((i for i in named[find(k)] if i is not None), default=None) for k in range(len(rows))}


def _edited(draw, text, n):
    words = text.split()
    for _ in range(n):
        words[draw.randrange(len(words))] = f"new{draw.randint(0, 99999)}"
    return " ".join(words)


def test_near_duplicates(session, table):
    draw = random.Random(6)
    bases = [_words(draw, n) for n in (4, 12, 60, 150, 150, 400)] + [" ".join([_words(draw, 20)] * 6)]
    texts = [None, "", "  ", *bases, *bases]
    texts += [_edited(draw, b, draw.choice([1, 1, 2, 4])) for b in bases for _ in range(6)]
    texts += [_edited(draw, bases[3], draw.randint(1, 3)) for _ in range(40)]  # a large group with members that are unlike each other
    texts += [_words(draw, 80) for _ in range(20)] + [bases[2].upper(), "\n".join(bases[2].split())]
    rows = [(k * 2, t, None, None, None) for k, t in enumerate(texts)]
    draw.shuffle(rows)
    rows.append((None, bases[5], None, None, None))
    folder = table("documents", rows, DOCUMENTS)
    found = collections.Counter((r["doc_id"], r["class_id"]) for r in queries.op10_near_duplicates(session, folder).collect())
    expected = _classes(rows)
    assert found == collections.Counter((rows[k][0], c) for k, c in expected.items())
    kept = near_duplicates.one_per_class(session.read.parquet(f"{folder}/documents.parquet"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values()))


def test_near_duplicates_of_few_rows(session, table):
    assert queries.op10_near_duplicates(session, table("documents", [], DOCUMENTS)).count() == 0
    rows = [(7, "just one text", None, None, None)] * 3 + [(None, "null id", None, None, None), (None, None, None, None, None)]
    folder = table("documents", rows, DOCUMENTS)
    found = sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in queries.op10_near_duplicates(session, folder).collect())
    assert found == [(0, 0), (0, 0), (7, 7), (7, 7), (7, 7)]
    assert near_duplicates.one_per_class(session.read.parquet(f"{folder}/documents.parquet")).count() == 3


def test_signature_estimates_similarity():
    draw = np.random.default_rng(1)
    for n in (1, 8, 60, 700):
        gaps = []
        for _ in range(30):
            base = draw.integers(-(1 << 62), 1 << 62, n)
            a, b = np.concatenate([base, base[: n // 2]]), np.concatenate([base[: max(1, n * 3 // 4)], draw.integers(0, 1 << 62, n // 5)])
            ca, cb = collections.Counter(a.tolist()), collections.Counter(b.tolist())
            keys = ca.keys() | cb.keys()
            exact = sum(1 / sum(max(ca[j] / ca[i], cb[j] / cb[i]) for j in keys) for i in ca.keys() & cb.keys())
            assert (ca & cb).total() / (ca | cb).total() <= exact + 1e-9
            gaps.append((near_duplicates.signature(a) == near_duplicates.signature(b)).mean() - exact)
        assert abs(np.mean(gaps)) < 0.03


def _probability_similar(a, b):
    keys = a.keys() | b.keys()
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in keys) for i in a.keys() & b.keys())


def test_exact_similarity_is_the_probability_jaccard(session):
    from pyspark.sql import functions as F

    draw, pairs = random.Random(12), []
    for n in (1, 5, 30, 90):
        for most in (1, 2, 7):
            a = [k for k in range(n) for _ in range(draw.randint(1, most))]
            b = [k for k in range(n // 4, n + 3) for _ in range(draw.randint(1, most))]
            pairs.append((a, b))
    counted = lambda bag: (sorted(set(bag)), [bag.count(k) for k in sorted(set(bag))] if len(set(bag)) < len(bag) else None)
    frame = session.createDataFrame(
        [(a, b, *counted(a), *counted(b)) for a, b in pairs],
        "a array<bigint>, b array<bigint>, ka array<bigint>, na array<bigint>, kb array<bigint>, nb array<bigint>")
    sides = [x for c in "ab" for x in (F.col(f"k{c}"), near_duplicates._levels(F.col(f"k{c}"), F.col(f"n{c}")))]
    for r in frame.select("a", "b", near_duplicates.similarity(*sides).alias("s")).collect():
        a, b = collections.Counter(r["a"]), collections.Counter(r["b"])
        assert r["s"] == pytest.approx(max(len(a.keys() & b.keys()) / len(a.keys() | b.keys()), _probability_similar(a, b)))


def test_copied_text_is_near_its_edited_copies(session, table):
    """Several edited copies of a text in one: near by the probability Jaccard similarity only."""
    draw, rows = random.Random(13), []
    for k, copies in enumerate((3, 4)):
        base = _words(draw, 300)
        for text in (base, " ".join([base] + [_edited(draw, base, 8) for _ in range(copies - 1)])):
            rows.append((2 * k + len(rows) % 2, text, None, None, None))
        a, b = (_bag(r[1]) for r in rows[-2:])
        assert _probability_similar(a, b) > 0.8 > max(len(a.keys() & b.keys()) / len(a.keys() | b.keys()), (a & b).total() / (a | b).total())
    found = {r["doc_id"]: r["class_id"] for r in queries.op10_near_duplicates(session, table("documents", rows, DOCUMENTS)).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 2}


def test_repeated_passage_is_near_the_single_one(session, table):
    """A passage that comes several times: near by the Jaccard similarity of the different shingles only."""
    draw, rows = random.Random(14), []
    for k, more in enumerate((9, 30)):
        base = _words(draw, 300).split()
        for times in (1, 1 + more, 2):
            rows.append((3 * k + len(rows) % 3, " ".join(base[:60] * times + base[60:]), None, None, None))
        a, b = _bag(rows[-3][1]), _bag(rows[-2][1])
        assert len(a.keys() & b.keys()) / len(a.keys() | b.keys()) > 0.95 and _probability_similar(a, b) < 0.5
    found = {r["doc_id"]: r["class_id"] for r in queries.op10_near_duplicates(session, table("documents", rows, DOCUMENTS)).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}


def test_shingles_and_digests_of_texts():
    """Equal runs of five words have equal hashes, others have not; the words' digest knows neither case nor white space."""
    draw = random.Random(15)
    texts = [None, "", " \n", "a", "A  b", "a b", "a b c d e", "a b c d e f", "f\ta b c D e", "é É x y z w", "x" * 2_000_000 + " a b c d e f g",
             " ".join(draw.choice("abc") for _ in range(3_000)), *(_words(draw, n) for n in (3, 40, 200_000))]
    nodes, hashes = near_duplicates.shingled(texts)
    names = {}
    for text, node, found in zip(texts, nodes, hashes):
        words = (text or "").lower().split()
        assert node == (hashlib.md5(" ".join(words).encode()).digest() if words else None)
        runs = [tuple(words[k: k + 5]) for k in range(max(1, len(words) - 4))] if words else []
        assert len(found) == len(runs)
        for run, value in zip(runs, found.tolist()):
            assert names.setdefault(run, value) == value
    assert len(set(names.values())) == len(names)
    one_by_one = [near_duplicates.signature(h) for h in hashes if len(h)]
    together = near_duplicates.signatures([np.unique(h, return_counts=True) for h in hashes if len(h)])
    assert (np.array(one_by_one) == together).all()


def test_one_of_many_equal_rows_stays(session):
    rows = [(1, "some words of one text here", "x", k % 2) for k in range(400)] + [(2, "some words of one text here", "x", 1), (None, "other words of a text", "y", 0)] * 3
    docs = session.createDataFrame(rows, "doc_id long, text string, node string, row int")
    kept = near_duplicates.one_per_class(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0, r["node"]) for r in kept.collect()) == [(0, "y"), (1, "x")]
    assert near_duplicates.classes(docs).count() == len(rows)


def test_components(session):
    draw = random.Random(9)
    links = [(k, k + 1) for k in range(0, 60)] + [(draw.randint(100, 160), draw.randint(100, 160)) for _ in range(50)] + [(200, k) for k in range(201, 240)]
    root = {x: x for pair in links for x in pair}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    found = components.components(session.createDataFrame(links, "a long, b long")).collect()
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["root"] for r in found} == {x: root[x] for x in linked} and len(found) == len(linked)
    assert components.components(session.createDataFrame([], "a long, b long")).count() == 0
    frames = [session.createDataFrame(links[k::3], "a long, b long") for k in range(3)]
    step_by_step = None
    for frame in [*frames, frames[0]]:
        step_by_step = components.extended(step_by_step, frame)
    assert {r["node"]: r["root"] for r in step_by_step.collect()} == {x: root[x] for x in linked}


def test_pipeline(session, table):
    draw = random.Random(8)
    languages = {"en": "the of and to in is that it for was".split(), "de": "der die und den von zu das mit sich des".split()}
    rows = []
    for k in range(120):
        lang = ("en", "de")[k % 2]
        text = " ".join(x for _ in range(30) for x in (draw.choice(languages[lang]), f"{lang}{''.join(draw.choice('aeioubcdfg') for _ in range(5))}"))
        rows.append((k, text, lang, f"s{k % 4}", len(text)))
    clean = len(rows)
    rows += [(200 + k, _edited(draw, rows[k][1], 1), rows[k][2], "s9", 0) for k in range(10)]
    rows += [(300, None, "en", "s0", 0), (301, "123 456 " * 30, None, None, 0), (302, "too short", "en", None, 5), (303, "the ### " * 40, "en", "s1", 0)]
    folder = table("documents", [(*r, "extra") for r in rows], DOCUMENTS + ", score string")
    docs = session.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = session.createDataFrame(stage(session, docs, folder).collect(), docs.schema)
        left[name] = {r["doc_id"] for r in docs.collect()}
    assert {300, 301} & left["language_id"] == set() and left["language_id"] >= set(range(clean))
    assert {302, 303} & left["quality_rules"] == set() and left["quality_rules"] >= set(range(clean))
    assert left["near_duplicates"] == set(range(clean))
    ended = corpus_pipeline.run(session, folder).collect()
    taken = collections.Counter(r["doc_id"] for r in ended)
    assert set(taken) <= set(range(clean)) and max(taken.values()) <= 3
    texts = {r[0]: r[1] for r in rows}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in ended)


def test_pipeline_of_an_empty_table(session, table):
    assert corpus_pipeline.run(session, table("documents", [], DOCUMENTS)).count() == 0
