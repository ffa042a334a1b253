"""Language, main text, merges and token shards, against libraries and rules of thumb on small tables."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from classatlas.llm import bpe, html_text, language, pieces, queries, token_shards

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
FILE = public_tokenizers.path("byte_bpe_50k.json")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    None, "", " ", "\n\n", "  two  blanks ", "it's we'll 'S été d'été", "x" * 30_000, " " * 3_000, "a b c\x1cd \x85e",
    "漢字と\U0001F600 ١٢² tab\there", "<|endoftext|> plain", "the same", "the same", "­​" * 50,
    "word " * 5_000, "\x00\x01 control",
]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merges_as_the_library(session, table, reference):
    rows = [(k, t, None, None, None) for k, t in enumerate(TEXTS)]
    found = {r["doc_id"]: r for r in queries.op3_byte_bpe(session, table("documents", rows, DOCUMENTS)).collect()}
    assert len(found) == len(TEXTS)
    for k, text in enumerate(TEXTS):
        ids = np.array(reference.encode_ordinary(text or ""), "<u4")
        assert found[k]["n_tokens"] == len(ids)
        assert found[k]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert found[k]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_prefix_table_appends_and_edits(reference):
    vocabulary, draw = bpe.Vocabulary.load(RANKS), random.Random(5)
    for _ in range(300):
        data = "".join(draw.choice("etaoin shrdlu THE123é漢  ") for _ in range(draw.randint(1, 80))).encode()
        grown = bpe.PrefixTable(vocabulary, data[:7])
        grown.append(data[7:])
        assert grown.tokens() == reference._encode_single_piece(data)
        start = draw.randint(0, len(data))
        stop, by = draw.randint(start, len(data)), data[: draw.randint(0, 6)]
        grown.replace(start, stop, by)
        afresh = bpe.PrefixTable(vocabulary, data[:start] + by + data[stop:])
        assert (grown.data, grown.last) == (afresh.data, afresh.last)


def test_latin_split_equals_the_pattern():
    import regex

    split, pattern = pieces.Splitter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN)
    for a in range(256):
        for b in (9, 10, 32, 39, 48, 65, 115, 133, 160, 170, 178, 189, 233, a):
            text = f"x{chr(a)}{chr(b)} {chr(b)}{chr(a)}1 '{chr(a)}"
            assert split.findall(text) == pattern.findall(text)


def test_shards_hold_what_the_library_encodes(session, table):
    rows = [(k * 3 - 20, t, None, None, None) for k, t in enumerate(TEXTS)]
    rows += [(None, "null id", None, None, None), (None, None, None, None, None), ((1 << 60) + 1, "far", None, None, None),
             (4, "tie b", None, None, None), (4, "tie a", None, None, None), (4, "tie a", None, None, None)]
    folder = table("documents", rows, DOCUMENTS)
    found = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in queries.op9_token_shards(session, folder).collect())
    tokenizer = Tokenizer.from_file(FILE)
    encode = lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    starts = 0
    for start, _, n, _ in found:
        assert start == starts
        starts += n
    ids = [r[1] for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    expected = sorted((-(1 << 62) if i is None else i, len(encode(t)), zlib.crc32(encode(t).tobytes())) for i, t, *_ in rows)
    assert sorted((-(1 << 62) if i is None else i, n, c) for _, i, n, c in found) == expected
    manifest = token_shards.write_shards(session.read.parquet(f"{folder}/documents.parquet"), FILE, public_tokenizers.PATTERN)
    store = token_shards.TokenStore(manifest)
    assert [x.tolist() for x in store.get((1 << 60) + 1)] == [encode("far").tolist()]
    assert sorted(x.tolist() for x in store.get(4)) == sorted(
        encode(t).tolist() for i, t, *_ in rows if i == 4)
    assert store.get(5) == [] and store.get(-(1 << 60)) == []


def test_shards_are_read_through_their_index(tmp_path):
    """Wrong places in the index give other documents, a missing key is noticed."""
    writer = token_shards.ShardWriter(f"file://{tmp_path}/a.ids", np.dtype("<u2"))
    texts = {None: [[1]], 3: [[2, 3], [4]], 9: [[], [5]], 12: [[6] * 70_000]}
    for key, documents in texts.items():
        for ids in documents:
            writer.add(key, np.array(ids, "<u2").tobytes())
    writer.close()

    def read(shard):
        frames = list(token_shards._documents(shard, 100))
        return [(None if r.doc_id is pd.NA else r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for f in frames for r in f.itertuples()]

    shard = token_shards.Shard(f"file://{tmp_path}/a.ids")
    assert read(shard) == [(None, 100, [1]), (3, 101, [2, 3]), (3, 103, [4]), (9, 104, []), (9, 104, [5]), (12, 105, [6] * 70_000)]
    right = shard.entries
    shard.entries = right.copy()
    two = shard.index.slots(np.array([3, 9]))
    shard.entries[two] = right[two[::-1]]
    shard.entries["print"] = right["print"]
    assert [ids for key, _, ids in read(shard) if key == 3] == [[], [5]]
    shard.entries["print"] = 0
    with pytest.raises(ValueError):
        read(shard)
    shard.entries = right
    for most in (1, 5, 1 << 20):
        assert [np.frombuffer(i, "<u4").tolist() for _, some in shard.read(np.array([5, 1, 2, 4]), most) for i in some] == [[6] * 70_000, [2, 3], [4], [5]]


def test_shards_of_other_tables(session, table):
    assert queries.op9_token_shards(session, table("documents", [], DOCUMENTS)).count() == 0
    docs = session.createDataFrame([(2, "a b", "x", "y"), (1, "c", "x", "y")], "doc_id long, text string, start string, ids string")
    found = token_shards.read_shards(token_shards.write_shards(docs, FILE, public_tokenizers.PATTERN)).collect()
    assert [(r["doc_id"], r["start"], len(r["ids"]) // 4) for r in sorted(found)] == [(1, 0, 2), (2, 2, 3)]


def test_added_tokens_of_the_file_as_the_library():
    encoder, tokenizer, end = token_shards.FileEncoder(FILE, public_tokenizers.PATTERN), Tokenizer.from_file(FILE), "<|endoftext|>"
    texts = [*TEXTS, end, end * 3, f"a {end} b", f" {end}\n\n{end}  ", f"<|{end}|> <|endoftext|", f"é{end}漢", "plain"]
    found = [np.frombuffer(ids, encoder.kind).tolist() for ids in encoder.encode_all(texts)]
    assert found == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert found[TEXTS.index("<|endoftext|> plain")] == [50256, 8631]


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(3).integers(-(1 << 63), 1 << 63 - 1, 20_000))
    index = token_shards.PerfectHash.build(keys)
    assert sorted(index.slots(keys)) == list(range(len(keys)))
    assert len(index.bits) * 8 / len(keys) < 6
    with pytest.raises(ValueError):
        token_shards.PerfectHash.build(np.array([1, 1, 2]))


def test_language_of_held_out_texts(session):
    rows = queries.op1_language_id(session, "/root/testdata/sf0.01").join(
        session.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows)
    assert len(rows) > 100 and right > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_awkward_rows(session):
    learned = [(k, t, lang, None) for k in range(30) for t, lang in (("the cat and the dog", "en"), ("der hund und die katze", "de"))]
    model = language.train(session.createDataFrame(learned + [(1, None, "xx", None), (2, "text", None, None)], "doc_id long, text string, lang string, score double"))
    assert model.languages == ["de", "en"]
    texts = [None, "", "123 ... ١", "The DOG", "und die", "the dog " * 200_000, "the dog", "the dog"]
    asked = session.createDataFrame([(k, t, 9.0) for k, t in enumerate(texts)], "doc_id long, text string, score double")
    found = {r["doc_id"]: r for r in language.predict(asked, model).collect()}
    assert [found[k]["lang_pred"] for k in range(len(texts))] == ["und", "und", "und", "en", "de", "en", "en", "en"]
    assert found[0]["score"] == 0 and found[6]["score"] == found[7]["score"] > 0.5
    nothing = language.train(asked.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert {r["lang_pred"] for r in language.predict(asked, nothing).collect()} == {"und"}
    assert language.predict(asked.limit(0), model).count() == 0


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<p> </p>", ""), ("just &amp; text\n here", "just & text here"),
    ("<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><article><h1>Head</h1><p><b>First, line.<br><p>Second"
     "<p>x</article><aside>side</aside><div class='comments'><p>a comment, a long comment, by a reader</p></div><footer>&copy; f</footer>",
     "Head\nFirst, line.\nSecond\nx"),
    ("<div id=main><p>One paragraph, long enough, to count as text.</p><ul><li>a<li>b</ul>tail</div><div class='cookie-notice'>ok</div>",
     "One paragraph, long enough, to count as text.\na\nb\ntail"),
    ("<article><p>a<script>var x='<p>no</p>';</script>b</p><form>name<input></form><!-- <p>no</p> --><p hidden>no</p></article>", "ab"),
    ("<article><p>&lt;tag&gt; &eacute;&#233;&#x1F600; a b</p></article>", "<tag> éé\U0001F600 a b"),
    ("<div>" * 5_000 + "deep", "deep"), ("<p unclosed='x", "<p unclosed='x"),
])
def test_main_text(page, text):
    if page == "<p unclosed='x":
        html_text.extract(page)  # any text will do, it must end
    else:
        assert html_text.extract(page) == text


def test_slugs_in_an_article_cut_nothing():
    kept = ("<h2 id='related-work'>A</h2><p id='notice-of-change'>B</p><section id='search-algorithms'><p>C</section>"
            "<p>D <span class='tags'>E</span></p><ul><li id='login'>F</ul><div id='related-work'>G</div><div class='section' id='search'>H</div>"
            "<table><tr><td class='header'>I</table>")
    cut = ("<div class='share'>no</div><div id='comments'>no</div><div id='related-posts'>no</div><section class='newsletter-signup'>no</section>"
           "<ul class='tags'><li>no</ul><p class='ad'>no</p><section id='comments'>no</section>")
    for tag in ("article", "main"):
        assert html_text.extract(f"<{tag}>{kept}{cut}</{tag}>") == "A\nB\nC\nD E\nF\nG\nH\nI"


def test_what_stands_beside_the_best_container_is_kept():
    long = "".join(f"<p>Paragraph {k}, of some length, with commas, to be the best of all.</p>" for k in range(9))
    lines = html_text.extract(long).split("\n")
    page = f"<body><div class=post><h1>Title</h1><p>Lead.</p><div class=entry>{long}</div><p><a href=x>elsewhere</a></p></div></body>"
    assert html_text.extract(page).split("\n") == ["Title", "Lead.", *lines]
    short = "<div><h2>Second</h2><p>A short paragraph, one of few.</p><p>Another short paragraph.</p></div>"
    links = "<div><a href=x>One of the links elsewhere</a> <a href=y>another link</a></div>"
    page = f"<body><div class=all><div><h2>First</h2>{long}</div>{short}{links}</div></body>"
    assert html_text.extract(page).split("\n") == ["First", *lines, "Second", "A short paragraph, one of few.", "Another short paragraph."]


LONG = "".join(f"<p>Paragraph {k}, of some length, with commas, to be the best of all.</p>" for k in range(5))
LINES = html_text.extract(LONG).split("\n")


@pytest.mark.parametrize(("page", "before", "behind"), [
    ("<div class='with-sidebar layout'><article>{}</article><div class=sidebar>no</div></div>", [], []),
    ("<div class='search'><main>{}</main></div>", [], []),
    ("<div class='sidebar-left content'><article>{}</article></div>", [], []),
    ("<div class='has-banner no-comments'><div class=entry>{}</div></div><div class=banner>no, no</div>", [], []),
    ("<form id=all><div>{}</div><div>Name<input></div></form>", [], []),
    ("<article>{}<article class='comment'><p>no comment, no, no</p></article></article>", [], []),
    ("<article>{}</article><article class='comment depth-2'><p>no comment, no, no</p></article>", [], []),
    ("<article>{}</article><div id=comments><article><p>no, no</p></article></div>", [], []),
    ("<article>{}</article><div class=related><article><p>A teaser, no, no, of another article.</p></article></div>", [], []),
    ("<div class='page-header'>no</div><article>{}</article><div class='page-footer'>no</div><div class='content-newsletter'>no</div>", [], []),
    ("<article><header class='entry-header'><h1>Title</h1></header>{}<div class='story-share'>no</div><div class='post-tags'>no</div>"
     "<div class='post-nav'>no</div><div class='discussion'>no</div></article>", ["Title"], []),
    ("<main><h1>Head</h1>{}<h3>You may also like</h3><ul><li><a href=x>one of them</a><li><a href=y>two</a></ul></main>", ["Head"], []),
    ("<main>{}<div class=links><a href=x>x</a> <a href=y>y</a></div><h2>Next</h2><ul><li>an item, <a href=z>here</a></ul></main>", [], ["Next", "an item, here"]),
    ("<main><h1>Head</h1><ul><li><a href='#a'>contents</a></ul>{}<p><a href=x>a source</a></p></main>", ["Head"], ["a source"]),
])
def test_what_is_cut_around_and_inside_an_article(page, before, behind):
    assert html_text.extract(page.replace("{}", LONG)).split("\n") == [*before, *LINES, *behind]


@pytest.mark.parametrize("page", [
    "<div>" * 20_000 + "deep", "<i>" * 8_000 + "<p>text of a block</p>" * 3_000, "<p>" + "<b>" * 20_000 + "x" + "</b>" * 20_000,
    "<table>" + "<div><p>a" * 10_000, "<ul><li>" * 10_000 + "x", "<article><div class='sidebar x'>" * 5_000 + "x",
])
def test_time_does_not_grow_with_depth(page):
    started = time.process_time()
    html_text.extract(page)
    assert time.process_time() - started < 3


def test_points_are_those_of_all_blocks_below():
    """Against sums over all ancestors of every block, on random pages."""
    draw = random.Random(21)
    for _ in range(200):
        parts = []
        for _ in range(draw.randint(1, 60)):
            parts.append(draw.choice(["<div>", "<div class=post>", "<section>", "<p>", "</p>", "</div>", "</section>", "<ul><li>", "</ul>", "<a href=x>", "</a>",
                                      "<article>", "</article>", "<h2>", "</h2>", "word, " * draw.randint(1, 30), "text " * draw.randint(1, 90)]))
        elements, blocks = html_text.tree_of("".join(parts))
        html_text.cut_by_name(elements, blocks)
        html_text.score(elements, blocks)
        points, chars, linked = collections.Counter(), collections.Counter(), collections.Counter()
        for block in blocks:
            around, level = block.owner.parent if block.owner.tag in html_text.PASSED_ON and block.owner.parent else block.owner, 0
            while around is not None:
                points[around] += html_text._points(block) * (1, 0.5)[level] if level < 2 else html_text._points(block) / 6 * 0.75 ** (level - 2)
                around, level = around.parent, level + 1
            around = block.owner
            while around is not None:
                chars[around] += len(block.text)
                linked[around] += block.linked
                around = around.parent
        for e in elements:
            assert e.points == pytest.approx(points[e]) and (e.chars, e.linked) == (chars[e], linked[e])
        worth = {e: points[e] * (1.25 if e.good else 1) * (1 - linked[e] / max(1, chars[e])) for e in elements}
        kept = html_text.main_blocks(*html_text.tree_of("".join(parts)))
        if blocks and max(worth.values()) > 0 and not any(e.tag == "article" for e in elements):
            best = max(elements, key=lambda e: worth[e])
            inside = [b.text for b in blocks if _within(b.owner, best) and not any(_linked_list(e, chars, linked) for e in _path(b.owner, best))]
            assert set(inside) - {b.text for b in kept} <= {b.text for b in blocks if b.owner.tag == "h2"}


def _path(element, top):
    while element is not top:
        yield element
        element = element.parent


def _within(element, top):
    while element is not None and element is not top:
        element = element.parent
    return element is top


def _linked_list(element, chars, linked):
    return element.tag in html_text.LINK_LISTS and linked[element] > html_text.MOSTLY * chars[element]


def test_main_text_of_an_empty_table(session, table):
    assert queries.op2_html_text(session, table("pages", [], "page_id long, url string, html string")).count() == 0


def test_main_text_of_given_pages(session):
    """The given pages hold their text in one article of headings and paragraphs."""
    import html
    import re

    pages = session.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("text", F.lit("old"))
    for row in html_text.with_main_text(pages).collect():
        article = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?p>|</h1>", article)]
        assert row["text"] == "\n".join(p for p in parts if p)
