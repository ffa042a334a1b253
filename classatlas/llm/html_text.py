"""Main text of a web page by tree scoring.

The page is read into a tree of elements, and what remains after cutting falls into blocks of
text. Every block passes points for its length and commas to the elements around it, fewer
the farther away, discounted by the part of its text inside links. The element with most
points, discounted by its own link density, is the container; if it lies inside an
``article`` or ``main`` element, the nearest of these is. Its siblings are kept if they have
a fair part of its points, or are headings or paragraphs that are not made of links. Inside
the container lists, tables and sections that are mostly links are left out, and headings
that have nothing else below them.

What is cut:

- by tag: menus, footers, asides, form fields, scripts, styles, hidden parts, and headers
  outside of articles;
- by the words of class, id or role: sidebars, notices, adverts, menus and the like. Such an
  element is kept if it holds the page's main article (of the ``article`` and ``main``
  elements the one with most points), or, on a page without any, most of the points. Words
  of a name that says ``with``, ``has`` or ``no`` count for nothing. Inside ``article`` and
  ``main`` they count for containers only, where ids are often made from headings: an id
  counts there if it has no other words;
- reader comments, also where each is an ``article``; these are kept in no case but where
  the page has no other article.

Points pass through the tree by one walk from its end to its start, so a page takes time in
proportion to its length at any depth.

All blocks of what is kept are joined in page order, one per line: character references
decoded, white space inside a block made one blank, ends trimmed.

Defined cases: null, empty and text-free pages give an empty text. A page without any
markup is one block. Unclosed and crossing tags are closed where HTML closes them implicitly
or at the end of their parent. Nesting of any depth and pages of any length are read in one
loop, without recursion. Of containers with equal points the first in the page is taken.
Repeated rows get equal results, an empty table no rows, and other columns are kept; an input
column named like the result is replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
LEFT_OUT = frozenset(
    "head script style noscript template nav header footer aside button select option textarea iframe svg math "
    "canvas audio video object embed applet map menu dialog title xmp noembed noframes datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "tfoot thead tr ul".split())
#: Opening one of these ends an open paragraph.
ENDS_PARAGRAPH = BLOCKS - frozenset("body html tbody tfoot thead tr caption legend summary".split())
#: Opening the first ends an open one of the second, up to the nearest of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
GOOD_WORDS = frozenset("article body content entry main post story text page column".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement adv banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disclaimer discussion discussions disqus footer footnote gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notification overlay pager pagination popup promo promoted promotion register related "
    "replies reply search share sharing shoutbox sidebar signup social sponsor sponsored sponsors subscribe subscription "
    "tags toolbar widget".split())
#: Those of reader comments.
COMMENT_WORDS = frozenset("comment comments discussion discussions disqus replies reply shoutbox".split())
#: First words of names that tell of a layout, not of what the element is.
MODIFIERS = frozenset("has hide is no not show with without".split())
#: A header with one of these in its name is an article's own.
OF_ARTICLE = frozenset("article entry post story".split())
#: Words an id may have besides bad ones and still name no text; classes of adverts, on any element.
PLAIN_WORDS = frozenset("area articles bar block bottom box container form item items left links list post posts right section top wrap wrapper".split())
ADVERTS = frozenset("ad ads advert adverts advertisement".split())
#: What the words count for inside of articles; a section's id is its heading's.
CONTAINERS = frozenset("address aside center details div dl fieldset footer header hgroup ol section table ul".split())
#: Left out inside the container if they are mostly links.
LINK_LISTS = frozenset("center details dir div dl fieldset menu ol section table ul".split())
#: Part of the text inside links from which on they are.
MOSTLY = 0.6
#: Part of the best container's worth that a sibling needs.
SHARE = 0.05
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Their points go to what is around them; text straight inside a container is the container's own.
PASSED_ON = HEADINGS | {"p", "pre", "blockquote", "li"}
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
ARTICLES = frozenset(["article", "main"])

#: Kinds of elements by their names.
TEXT, SUSPECT, COMMENTS = 0, 1, 2

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    __slots__ = ("tag", "parent", "left_out", "kind", "good", "in_article", "held", "chars", "linked", "own", "near", "far", "cut")

    def __init__(self, tag: str, parent: Element | None, left_out: bool, kind: int, good: bool):
        self.tag, self.parent, self.left_out, self.kind, self.good = tag, parent, left_out, kind, good
        self.in_article = parent is not None and (parent.in_article or parent.tag in ARTICLES)
        self.held = self.own = self.near = self.far = 0.0
        self.chars = self.linked = 0
        self.cut = False

    @property
    def points(self) -> float:
        return self.own + self.near / 2 + self.far


class Block:
    __slots__ = ("owner", "text", "linked")

    def __init__(self, owner: Element, text: str, linked: int):
        self.owner, self.text, self.linked = owner, text, linked


def _words(names: str) -> set[str]:
    """Words of class names or an id; ``with-sidebar`` and the like say what is elsewhere."""
    found: set[str] = set()
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and words[0] not in MODIFIERS:
            found.update(words)
            if "header" in words and not OF_ARTICLE.isdisjoint(words):
                found.discard("header")
    return found


def _looks(tag: str, attributes: str, parent: Element) -> tuple[bool, int, bool]:
    """(left out, kind, has a word of article containers in its class or id)."""
    in_article = parent.in_article or parent.tag in ARTICLES
    if tag in LEFT_OUT and not (tag == "header" and in_article):
        return True, TEXT, False
    kind = SUSPECT if tag == "form" else TEXT
    if not attributes.strip():
        return False, kind, False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or (
            "style" in found and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found["style"], re.I)):
        return True, TEXT, False
    of_class, of_id = _words(found.get("class", "")), _words(found.get("id", ""))
    bad = (of_class | of_id) & BAD_WORDS
    if bad and (_bad_in_article(tag, of_class, of_id, found.get("class", "")) if in_article else tag not in HEADINGS or bad != {"header"}):
        kind = COMMENTS if bad & COMMENT_WORDS else SUSPECT
    elif found.get("role", "").lower() in BAD_ROLES:
        kind = SUSPECT
    return False, kind, bool((of_class | of_id) & GOOD_WORDS)


def _bad_in_article(tag: str, of_class: set[str], of_id: set[str], classes: str) -> bool:
    """Whether class and id, one of which has a bad word, name something else than text of the article around."""
    if tag == "article":
        return bool(of_class & BAD_WORDS) or of_id <= BAD_WORDS | PLAIN_WORDS
    if tag not in CONTAINERS:
        return not ADVERTS.isdisjoint(classes.lower().split())
    if of_class & BAD_WORDS - {"header"}:
        return True
    if tag not in ("div", "aside") or "section" in of_class:
        return bool(of_id) and of_id <= {*ADVERTS, "comments", "sidebar"}
    return bool(of_id) and of_id <= BAD_WORDS | PLAIN_WORDS


def tree_of(page: str) -> tuple[list[Element], list[Block]]:
    """The page's elements, parents before children, and its blocks of text outside of what is left out, in page order."""
    root = Element("html", None, False, TEXT, False)
    stack, elements, blocks = [root], [root], []
    # depths of the open elements of a tag, and of those that are blocks, innermost last
    depths: dict[str, list[int]] = {}
    block_depths = [0]
    pieces: list[str] = []
    linked = links = 0
    owner = root

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append(Block(owner, text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def close(depth: int) -> None:
        """Close all elements above ``depth`` open ones."""
        nonlocal links, owner
        for element in stack[depth:]:
            links -= element.tag == "a"
            depths[element.tag].pop()
            if element.tag in BLOCKS:
                flush()
                block_depths.pop()
        del stack[depth:]
        owner = stack[block_depths[-1]]

    def innermost(tags: Iterable[str]) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    def open_at(tags: Iterable[str], stop: Iterable[str]) -> int:
        """Depth of the innermost open element of these tags, 0 if a stopping one comes first."""
        depth = innermost(tags)
        return depth if depth and depth > innermost(stop) else 0

    def add(text: str) -> None:
        nonlocal linked
        if not stack[-1].left_out:
            decoded = html.unescape(text) if "&" in text else text
            pieces.append(decoded)
            if links:
                linked += len(decoded.strip())

    at, end = 0, len(page)
    while at < end:
        tag_match = _TAG.search(page, at)
        if tag_match is None:
            add(page[at:])
            break
        if tag_match.start() > at:
            add(page[at: tag_match.start()])
        at = tag_match.end()
        name = tag_match[2] or tag_match[5]
        if not name:
            continue
        tag, closing = name.lower(), tag_match[1] or tag_match[4]
        attributes = tag_match[3] or tag_match[6] or ""
        if closing:
            # an inline end tag does not reach beyond the block it stands in
            depth = innermost((tag,))
            if depth and (tag in BLOCKS or tag in ("td", "th") or depth > block_depths[-1]):
                close(depth)
            continue
        if tag in ("html", "body"):
            continue
        if tag in ENDS_PARAGRAPH:
            depth = open_at({"p"}, {"table", "td", "th", "button", "object"})
            if depth:
                close(depth)
        if tag in ENDS:
            ended, scope = ENDS[tag]
            depth = open_at(ended, scope)
            while depth:
                close(depth)
                depth = open_at(ended, scope)
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br" and not stack[-1].left_out:
                pieces.append(" ")
            continue
        parent = stack[-1]
        left_out, kind, good = (True, TEXT, False) if parent.left_out else _looks(tag, attributes, parent)
        if tag in RAW:
            finish = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = finish.end() if finish else end
            continue
        if attributes.endswith("/") and tag in ("svg", "math", "path"):
            continue
        if tag in BLOCKS:
            flush()
        elif tag in ("td", "th") and not left_out:
            pieces.append(" ")
        element = Element(tag, parent, left_out, kind, good)
        depths.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            block_depths.append(len(stack))
            owner = element
        stack.append(element)
        elements.append(element)
        links += tag == "a"
    flush()
    return elements, blocks


def _points(block: Block) -> float:
    length = len(block.text)
    points = (1.0 if length >= 25 else 0.1) + block.text.count(",") + min(length / 100, 3.0)
    return points * (1 - block.linked / length)


def cut_by_name(elements: list[Element], blocks: list[Block]) -> None:
    """Marks what is cut for its names, with all that it holds."""
    for block in blocks:
        block.owner.held += _points(block)
    for element in reversed(elements[1:]):
        element.parent.held += element.held
        element.cut = False
    comments = set()
    for element in elements[1:]:
        if element.kind == COMMENTS or element.parent in comments:
            comments.add(element)
    articles = [e for e in elements if e.tag in ARTICLES and e.held > 0]
    main = max((e for e in articles if e not in comments), key=lambda e: e.held, default=None)
    main = main or max(articles, key=lambda e: e.held, default=None)
    spared, around = set(), main
    while around is not None:
        spared.add(around)
        around = around.parent
    half = elements[0].held / 2
    for element in elements[1:]:
        kept = element in spared or main is None and element.kind == SUSPECT and element.held > half
        element.cut = element.parent.cut or element.kind != TEXT and not kept


def score(elements: list[Element], blocks: list[Block]) -> None:
    """Sums points, characters and characters in links of all elements, from the last to the first.

    A block's points count in full where they go to, by half one element farther out, then by
    a sixth, and by three quarters of that for each element more.
    """
    for block in blocks:
        owner = block.owner
        owner.chars += len(block.text)
        owner.linked += block.linked
        (owner.parent if owner.tag in PASSED_ON and owner.parent else owner).own += _points(block)
    for element in reversed(elements[1:]):
        parent = element.parent
        parent.near += element.own
        parent.far += element.near / 6 + element.far * 0.75
        parent.chars += element.chars
        parent.linked += element.linked


def _worth(element: Element) -> float:
    bonus = 1.25 if element.good else 1.0
    return element.points * bonus * (1 - element.linked / max(1, element.chars))


def _cut_link_lists(elements: list[Element], best: Element) -> None:
    """Marks what is mostly links inside ``best``, and headings with nothing else behind them."""
    children: dict[Element, list[Element]] = {}
    inside = {best}
    for element in elements[1:]:
        if element.parent in inside:
            inside.add(element)
            element.cut |= element.parent.cut or (element.tag in LINK_LISTS and element.linked > MOSTLY * element.chars)
            if element.chars:
                children.setdefault(element.parent, []).append(element)
    for row in children.values():
        last = None  # a heading that only link lists have followed
        for element in [*row, None]:
            if element is not None and element.cut and element.tag in LINK_LISTS:
                dropped = last is not None
            elif element is None or element.tag in HEADINGS:
                if last is not None and dropped:
                    last.cut = True
                last, dropped = element, False
            else:
                last = None


def main_blocks(elements: list[Element], blocks: list[Block]) -> list[Block]:
    """The blocks of the best container and of the siblings that belong to it."""
    cut_by_name(elements, blocks)
    blocks = [b for b in blocks if not b.owner.cut]
    if not blocks:
        return []
    score(elements, blocks)
    best = max((e for e in elements if not e.cut and e.points), key=_worth, default=elements[0])  # of equals the first in page order
    around = best
    while around is not None:
        if around.tag in ARTICLES:
            best = around
            break
        around = around.parent
    threshold = SHARE * _worth(best)
    _cut_link_lists(elements, best)
    kept = {best}
    for element in elements[1:]:
        if element.cut or element is best:
            continue
        if element.parent is best.parent:
            running = element.tag in HEADINGS or element.tag == "p" and element.linked < 0.25 * element.chars
            if running or _worth(element) >= threshold > 0:
                kept.add(element)
        elif element.parent in kept:
            kept.add(element)
    return [b for b in blocks if b.owner in kept]


def extract(page: str | None) -> str:
    return "\n".join(b.text for b in main_blocks(*tree_of(page))) if page else ""


def with_main_text(pages: DataFrame, page: str = "html", result: str = "text") -> DataFrame:
    """Adds the main text of every page and keeps all other columns."""

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages_ in batches:
            yield pd.Series([extract(p) for p in pages_], dtype=object)

    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() != result.lower()]
    return pages.select(*kept, main_text(F.col(f"`{page}`")).alias(result))
