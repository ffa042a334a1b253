"""Importance resampling, lexical search and fingerprint components, against brute force on small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from classatlas.llm import components, importance, lexical_search, queries, simhash
from tests.compare import mismatch

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
BENCHMARK = "item_id long, text string"
TEXTS = [
    None, "", " \t\n", "...", "one", "One TWO", "a-b_c.d", "é É ß漢字 \U0001F600 x", "x" * 5_000 + " y z", "y z " * 3_000,
    "the of and " * 12, "THE OF AND " * 12, "a b c", "0 1 2 3 4 5 6 7 8 9 " * 3,
]


def _rows(texts, draw, n=60):
    words = [f"w{k}" for k in range(40)]
    texts = texts + [" ".join(draw.choice(words) for _ in range(draw.choice([3, 25, 80]))) for _ in range(n)]
    return [(3 * k - 9, t, None, None, None) for k, t in enumerate(texts)] + [(None, "w1 w2 w3 " * 9, None, None, None)]


def _agrees(session, folder, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    assert mismatch(queries.QUERIES[name](session, folder), connection, queries.ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", ["op11_importance", "op12_lexical_search"])
def test_awkward_texts(session, table, name):
    draw = random.Random(31)
    rows = _rows(TEXTS, draw)
    table("documents", rows + rows[12:15], DOCUMENTS)
    items = [(k, t) for k, t in enumerate([None, "", "!!", "w1 w1 W2", "nowhere", "é the OF", "x" * 5_000, "y z", " ".join(f"w{k}" for k in range(40))])]
    _agrees(session, table("benchmark", items, BENCHMARK), name)


def test_empty_tables(session, table):
    document, item = [(1, "a b c " * 9, None, None, None)], [(1, "a c")]
    for documents, items in (([], item), (document, []), ([], [])):
        table("documents", documents, DOCUMENTS)
        folder = table("benchmark", items, BENCHMARK)
        assert queries.op11_importance(session, folder).count() == len(documents)
        assert queries.op12_lexical_search(session, folder).count() == 0
        assert queries.op13_simhash(session, folder).count() == len(documents)


def test_clashing_columns_are_ignored(session):
    columns = "doc_id long, text string, score string, rank string, node string, item string, n string"
    docs = session.createDataFrame([(k, f"a{k} b c d " * 8, "x", "x", "x", "x", "x") for k in range(30)], columns)
    items = session.createDataFrame([("p", "a3 b", "x"), ("q", "c", "x")], "item_id string, text string, score string")
    assert importance.resample(docs, items, percent=10).where("rank IS NOT NULL").count() == 3
    found = lexical_search.search(items, docs, top=2).collect()
    assert sorted((r["item_id"], r["rank"]) for r in found) == [("p", 1), ("p", 2), ("q", 1), ("q", 2)]
    assert [r["doc_id"] for r in sorted(found) if r["item_id"] == "p"][0] == 3
    assert simhash.linked(docs).count() == 30


# -- importance ------------------------------------------------------------------

def test_checksums_of_spans():
    draw = random.Random(1)
    data = draw.randbytes(60_000)
    starts = np.array([draw.randrange(60_000) for _ in range(800)])
    ends = np.minimum(starts + np.array([draw.choice([0, 1, 5, 127, 128, 129, 255, 256, 257, 5_000, 50_000]) for _ in starts]), 60_000)
    found = importance.checksums(np.frombuffer(data, np.uint8), starts, ends)
    assert found.tolist() == [zlib.crc32(data[s:e]) for s, e in zip(starts, ends)]


@pytest.mark.parametrize("texts", [TEXTS, [None], ["a"], ["a b"], ["", "a b c", ""]])
def test_features(texts):
    words, runs = importance.features_of(texts)
    ends = [0, 0, 0]
    for k, text in enumerate(texts):
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        assert words[k] == len(found)
        for n, (buckets, counts) in enumerate(runs):
            expected = [zlib.crc32(" ".join(found[i: i + n + 1]).encode()) % 10_000 for i in range(len(found) - n)]
            assert buckets[ends[n]: ends[n] + counts[k]].tolist() == expected
            ends[n] += counts[k]


def test_draw_follows_the_weights(session):
    """Documents like the target are drawn far more often than by chance, and every seed gives another draw."""
    draw = random.Random(5)
    like = lambda words, n: " ".join(draw.choice(words) for _ in range(n))
    some, others = [f"s{k}" for k in range(30)], [f"o{k}" for k in range(30)]
    docs = session.createDataFrame([(k, like(some if k % 5 == 0 else others, 40)) for k in range(400)], "doc_id long, text string")
    target = session.createDataFrame([(like(some, 300),)], "text string")
    draws = []
    for seed in (1, 2):
        drawn = importance.resample(docs, target, percent=5, seed=seed).where("rank IS NOT NULL").orderBy("rank").collect()
        assert [r["rank"] for r in drawn] == list(range(1, 21)) and all(r["doc_id"] % 5 == 0 for r in drawn)
        assert all(a["score"] >= b["score"] for a, b in zip(drawn, drawn[1:]))
        digest = int(hashlib.sha256(f"{seed}:{drawn[0]['doc_id']}".encode()).hexdigest()[:8], 16)
        assert drawn[0]["score"] - drawn[0]["weight"] == math.floor(-1000 * math.log(-math.log((digest + 0.5) / 4294967296)))
        draws.append([r["doc_id"] for r in drawn])
    assert draws[0] != draws[1]


# -- lexical search ----------------------------------------------------------------

def test_blocks_change_nothing(session, table, monkeypatch):
    draw = random.Random(7)
    folder = table("documents", _rows(TEXTS, draw), DOCUMENTS)
    items = [(k, " ".join(f"w{draw.randint(0, 50)}" for _ in range(draw.randint(0, 9)))) for k in range(23)] + [(3, "w3 w4"), (None, "w5")]
    folder = table("benchmark", items, BENCHMARK)
    whole = sorted(map(str, queries.op12_lexical_search(session, folder).collect()))
    monkeypatch.setattr(lexical_search, "BLOCK_CHARS", 40)
    assert sorted(map(str, queries.op12_lexical_search(session, folder).collect())) == whole
    assert len(list(lexical_search.blocks_of(session.read.parquet(f"{folder}/benchmark.parquet")))) > 5


def test_heaps_keep_the_best():
    draw = np.random.default_rng(3)
    items, top = 7, 4
    heaps, seen = lexical_search.Heaps(items, top), []
    heaps.room = 40
    for _ in range(50):
        n = int(draw.integers(1, 9))
        scores, ids = draw.integers(0, 6, (n, items)), draw.integers(0, 1000, n)
        no_id = draw.random(n) < 0.1
        heaps.offer(scores, ids, no_id)
        seen += [(i, -int(scores[k, i]), lexical_search._LAST if no_id[k] else int(ids[k])) for k in range(n) for i in range(items) if scores[k, i] > 0]
    item, score, ids, _ = heaps.settle()
    found = collections.defaultdict(list)
    for row in sorted(seen):
        found[row[0]].append(row)
    assert sorted(zip(item.tolist(), (-score).tolist(), ids.tolist())) == sorted(r for rows in found.values() for r in rows[:top])


# -- fingerprints ------------------------------------------------------------------

def _fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k: k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in root:
        for b in root:
            if a < b and (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                root[x] = y
    return {p: find(p) for p in root}


def test_masks_cover_every_pair_of_the_radius():
    draw = random.Random(2)
    fixed_ones = [0, simhash.masks()[5]]
    for _ in range(6):
        fixed_ones.append(min(simhash.masks(fixed_ones[-1]), key=int.bit_count))
    for fixed in fixed_ones:
        masks = simhash.masks(fixed)
        free = [p for p in range(64) if not fixed >> p & 1]
        assert len(masks) == 31 and all(m & fixed == fixed for m in masks)
        taken = [(m & ~fixed).bit_count() for m in masks]
        assert min(taken) >= 1 and (len(free) < 32 or max(taken) - min(taken) <= 2)
        for _ in range(3_000):
            changed = sum(1 << p for p in draw.sample(free, min(len(free), 4)))
            assert any(not m & changed for m in masks)


def test_components_of_texts(session, table):
    draw = random.Random(11)
    bases = [" ".join(f"w{draw.randint(0, 900)}" for _ in range(n)) for n in (4, 60, 300, 300)]
    texts = [*TEXTS, *TEXTS, *bases]
    for base in bases:
        for _ in range(25):
            words = base.split()
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = "new"
            texts.append(" ".join(words))
    rows = [(5 * k - 20, t, None, None, None) for k, t in enumerate(texts)] + [(None, bases[0], None, None, None), (None, "alone with a null id", None, None, None)]
    found = queries.op13_simhash(session, table("documents", rows, DOCUMENTS)).collect()
    prints = [_fingerprint(t) for _, t, *_ in rows]
    root = _components(prints)
    least = collections.defaultdict(lambda: None)
    for (i, *_), p in zip(rows, prints):
        if i is not None and (least[root[p]] is None or i < least[root[p]]):
            least[root[p]] = i
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found) == collections.Counter(
        (i, f"{p:016x}", least[root[p]]) for (i, *_), p in zip(rows, prints))


@pytest.mark.parametrize("small", [4])
def test_dense_fingerprints_are_split_finer(session, monkeypatch, small):
    """Many fingerprints close to each other, most of them not linked to the least one of their buckets."""
    monkeypatch.setattr(simhash, "SMALL", small)
    draw = random.Random(small)
    prints = {draw.getrandbits(64) for _ in range(30)} | {0, (1 << 64) - 1}
    for center in list(prints)[:3]:
        for _ in range(120):
            prints.add(center ^ sum(1 << b for b in draw.sample(range(64), draw.choice([1, 3, 6, 9]))))
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    found = {r["node"]: r["root"] for r in simhash.roots_of(session.createDataFrame([(s,) for s in signed], "node long")).collect()}
    root = _components(prints)
    groups = lambda pairs: {frozenset(g) for g in pairs.values()}
    expected, actual = collections.defaultdict(set), collections.defaultdict(set)
    for s, p in signed.items():
        expected[root[p]].add(s)
        actual[found.get(s, s)].add(s)
    assert groups(expected) == groups(actual) and all(r == min(actual[r]) for r in actual)


def test_a_star_of_many_links(session):
    """The links of one node are split over tasks; nulls, loops and repeats change nothing."""
    links = [(0, k) for k in range(1, 3_000)] + [(5_000, 5_001), (5_001, 5_001), (5_000, 5_001), (None, 3), (4, None)]
    found = {r["node"]: r["root"] for r in components.components(session.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(3_000)} | {5_000: 5_000, 5_001: 5_000}
