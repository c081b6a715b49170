"""HTML extraction by tag-path ratios.

A page is read once into text nodes, each with its root-to-leaf tag path. Per
path the text length and the punctuation are added up and divided by the number
of its nodes; along the page both ratios are smoothed with a Gaussian window
and fused into one product. Paths whose fused ratio reaches the threshold (a
share of its standard deviation over the page) are content paths. The article is
the smallest section that holds all nodes of content paths, an ``article`` or
``main`` element where one holds them all. Of it the nodes of content paths are
given, in page order, and what belongs to them: the rest of their blocks,
headings, text of an article or main element, and what stands between content
nodes of the same section. Other groups (sections, lists, tables) without a
content node are dropped: before the first and after the last content node,
unless it is a list of sentences, and anywhere if most of their text is links.

Parts that never are article text are left out before by their tag: scripts,
styles, forms, menus, page headers and footers. A word of class, id or role
(advert, notice, comment, ...) only marks an element. Marked elements are left
out when they hold little of the page's content text and no main part of it;
what holds more than half of that text (nearly all of it, beside an unmarked
article or main element), alone or together with all others of the same word,
stays, and so does the page if nothing else would be left.

Definitions: null or empty html gives empty text. White space of a block becomes
one space; blocks are joined by one line feed. Unclosed and stray tags are
accepted as browsers do; a page cut off inside a tag ends there. A path of any
depth is a place in a trie, and a page is read in time linear in its length. Nodes
tied at the threshold are content. Rows that repeat are given as often; extra
columns are dropped; a table without rows gives none.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import typed

SPREAD = 1.0  # standard deviation of the smoothing window, in text nodes
THRESHOLD = 0.5  # share of the fused ratio's standard deviation
OWN = 0.25  # least text ratio of a content path as a share of its smoothed one: the rest is its neighbours'
MARKED_HOLDS = 0.5  # share of the content text a marked element that is left out holds at most
BESIDE_HOLDS = 0.9  # the same on a page with an unmarked article or main element
LITTLE = 0.1  # share of it an article element holds at least to keep a marked element around it
LINKED = 0.5  # share of a group's text in links that makes it a menu

_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<(?:[!?]|/[^A-Za-z])[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)", re.DOTALL
)
_TO_VALUE = re.compile(r"([^>=]*)(>|=\s*)")
_BARE = re.compile(r"[^\s>]*")
_NAME_ENDS = re.compile(r"[\s/\"']+")
_PUNCTUATION = ".,;:!?…。，；：！？、"

# Fixed by HTML.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot"
    " th thead title tr ul caption option".split()
)
_CLOSES = {  # a start tag ends these open elements, up to the nearest of the second set
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_PARAGRAPH = ({"p"}, {"td", "th", "table", "article", "section", "main", "div", "body", "blockquote", "li", "aside"})
_SECTIONS = set("html body div main article section td center table tbody tr blockquote form figure details".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup header".split())
_LISTS = set("ul ol dl table".split())

# Elements, and words of class, id or role, that are no article text.
_LEFT_OUT = set("script style noscript template head title nav footer aside form button select textarea iframe svg dialog menu".split())
_WORDS = set(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent"
    " disqus footer masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted recommended"
    " related replies search share sharing sidebar social sponsor sponsored subscribe subscription teaser toolbar widget"
    " complementary contentinfo site-header page-header".split()
)


def _marks(values: list[str]) -> frozenset[str]:
    """The words of class, id and role that speak against article text."""
    found = set()
    for value in values:
        for word in value.lower().split():
            found.update(w for w in (word, *re.split(r"[-_]", word)) if w in _WORDS)
    return frozenset(found)


def _attributes(source: str, at: int) -> tuple[int, list[str], bool]:
    """Where the tag ends, its values of class, id and role, and whether it closes itself.

    A tag that never ends takes the rest of the page: its end is the page's.
    """
    values: list[str] = []
    while True:
        m = _TO_VALUE.match(source, at)
        if m is None:
            return len(source), [], False
        at = m.end()
        if m[2] == ">":
            return at, values, m[1].rstrip().endswith("/")
        name = _NAME_ENDS.split(m[1].rstrip()[-8:])[-1].lower()
        quote = source[at : at + 1]
        if quote in ("'", '"') and quote:
            stop = source.find(quote, at + 1)
            if stop < 0:
                return len(source), [], False
            value, at = source[at + 1 : stop], stop + 1
        else:
            bare = _BARE.match(source, at)
            value, at = bare[0], bare.end()
        if name in ("class", "id", "role"):
            values.append(value)


class _Page:
    """Text nodes of one page: text, path, element, block number."""

    def __init__(self, source: str):
        self.nodes: list[tuple[str, int, int, int]] = []
        self.parents: list[int] = [-1]
        self.tags: list[str] = [""]
        self.out: list[bool] = [False]
        self.marks: list[frozenset[str]] = [frozenset()]
        self.paths: list[int] = [0]
        self.depth: list[int] = [0]
        self.block = 0
        self.stack = [0]
        self.open: dict[str, list[int]] = {}  # per tag, the places of its open elements in the stack
        self.trie: dict[tuple[int, str], int] = {}
        self._read(source)

    def _push(self, tag: str, values: list[str]) -> None:
        top = self.stack[-1]
        inside_main = self.open.get("article") or self.open.get("main")
        out = self.out[top] or tag in _LEFT_OUT or tag == "header" and not inside_main
        self.parents.append(top)
        self.tags.append(tag)
        self.out.append(out)
        self.marks.append(_marks(values) if values and not out else frozenset())
        self.depth.append(self.depth[top] + 1)
        self.paths.append(self.trie.setdefault((self.paths[top], tag), len(self.trie) + 1))
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(len(self.tags) - 1)

    def _pop(self, place: int) -> None:
        """Close the element at this place of the stack and all inside it."""
        for element in self.stack[place:]:
            self.open[self.tags[element]].pop()
        del self.stack[place:]

    def _nearest(self, tags: set[str]) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _text(self, text: str, as_is: bool = False) -> None:
        element = self.stack[-1]
        if text and not self.out[element]:
            self.nodes.append((text if as_is else html.unescape(text), self.paths[element], element, self.block))

    def _read(self, source: str) -> None:
        at = 0
        while at < len(source):
            m = _MARKUP.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            self._text(source[at : m.start()])
            at = m.end()
            if m[1] is not None:
                self._text(m[1], as_is=True)
            if m[3] is None:
                continue
            tag = m[3].lower()
            at, values, closed = _attributes(source, at)
            if at == len(source) and source[-1] != ">":
                break  # cut off inside a tag
            if tag in _BLOCK:
                self.block += 1
            elif tag == "br":
                self._text("\n")
            if m[2]:
                if self.open.get(tag):
                    self._pop(self.open[tag][-1])
                continue
            if tag in _VOID:
                continue
            ends, within = _CLOSES.get(tag, (None, None))
            if tag in _BLOCK and ends is None:
                ends, within = _PARAGRAPH
            if ends:
                place = self._nearest(ends)
                if place > self._nearest(within):
                    self._pop(place)
            if closed and tag in ("svg", "path"):
                continue
            if tag in _RAW:
                found = re.compile(rf"</{re.escape(tag)}(?:[\s/][^>]*)?>", re.IGNORECASE).search(source, at)
                at = found.end() if found else len(source)
            else:
                self._push(tag, values)


def _smooth(values: np.ndarray) -> np.ndarray:
    reach = int(np.ceil(2 * SPREAD))
    window = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SPREAD) ** 2)
    total = np.convolve(values, window, "full")[reach : reach + len(values)]
    weight = np.convolve(np.ones(len(values)), window, "full")[reach : reach + len(values)]
    return total / weight


def content_scores(nodes: list[tuple[str, int, int, int]]) -> np.ndarray:
    """Fused ratio per text node, 0 for nodes of paths below the threshold."""
    sizes = np.array([len(n[0].strip()) for n in nodes], float)
    signs = np.array([sum(map(n[0].count, _PUNCTUATION)) for n in nodes], float)
    paths, which = np.unique(np.array([n[1] for n in nodes]), return_inverse=True)
    many = np.bincount(which, sizes > 0, len(paths))
    many = np.maximum(many, 1)
    text_ratio = np.bincount(which, sizes) / many
    sign_ratio = np.bincount(which, signs) / many
    smoothed = _smooth(text_ratio[which])
    fused = smoothed * _smooth(1 + sign_ratio[which])
    bar = THRESHOLD * fused.std()
    per_path = np.bincount(which, fused) / np.bincount(which)
    lent = np.bincount(which, smoothed * (sizes > 0), len(paths)) / many
    chosen = ((per_path >= bar) & (text_ratio >= OWN * lent))[which]
    return np.where(chosen, fused * sizes, 0.0)


def _held(page: _Page, nodes: list[tuple[str, int, int, int]], weights: np.ndarray) -> np.ndarray:
    """The weight of the nodes in each element, those in its descendants included."""
    held = np.zeros(len(page.tags))
    np.add.at(held, [n[2] for n in nodes], weights)
    for element in range(len(page.tags) - 1, 0, -1):  # children come after their parents
        held[page.parents[element]] += held[element]
    return held


def _unmarked(page: _Page) -> list[tuple[str, int, int, int]]:
    """The nodes outside the marked elements that are left out."""
    nodes, tags, marks = page.nodes, page.tags, page.marks
    marked = [e for e, m in enumerate(marks) if m and tags[e] not in ("html", "body", "article", "main")]
    if not marked:
        return nodes
    held = _held(page, nodes, np.where(content_scores(nodes) > 0, [len(n[0].strip()) for n in nodes], 0.0))
    total = held[0]
    # Comments may be article elements too: their own marks tell them from the page's.
    articles = [e for e, t in enumerate(tags) if t == "article" and not marks[e]]
    bar = min(LITTLE * total, max((held[e] for e in articles), default=0.0))
    holds_main = np.zeros(len(tags), bool)
    holds_main[[e for e, t in enumerate(tags) if t == "main"] + [e for e in articles if held[e] >= bar]] = True
    for element in range(len(tags) - 1, 0, -1):
        holds_main[page.parents[element]] |= holds_main[element]
    of_word: dict[str, float] = {}
    above: list[frozenset[str]] = [frozenset()] * len(tags)  # marks of the element and its ancestors
    for element in range(1, len(tags)):
        up = above[page.parents[element]]
        above[element] = up | marks[element] if marks[element] else up
    for element in marked:
        for word in marks[element] - above[page.parents[element]]:
            of_word[word] = of_word.get(word, 0.0) + held[element]
    # Beside an article or main element with text, a mark weighs more.
    named = any(held[e] > 0 and not above[e] for e, t in enumerate(tags) if t in ("article", "main"))
    most = (BESIDE_HOLDS if named else MARKED_HOLDS) * total
    out = np.zeros(len(tags), bool)
    for element in marked:
        speaks = any(of_word.get(word, 0.0) <= most for word in marks[element])
        out[element] = speaks and held[element] <= most and not holds_main[element]
    for element in range(1, len(tags)):
        out[element] |= out[page.parents[element]]
    left = [n for n in nodes if not out[n[2]]]
    return left if any(n[0].strip() for n in left) else nodes


def _belonging(page: _Page, nodes: list[tuple[str, int, int, int]], chosen: np.ndarray, held: np.ndarray) -> np.ndarray:
    """For each node, whether it is content or belongs to some (all do where there is none)."""
    if not chosen.any():
        return np.ones(len(nodes), bool)
    tags, parents, many = page.tags, page.parents, len(page.tags)
    of = np.array([n[2] for n in nodes])
    # For each element: the nearest section with content, and the group without any below it.
    section, group = list(range(many)), [-1] * many
    named, linked = np.zeros(many, bool), np.zeros(many, bool)
    for e in range(many):
        up = parents[e]
        named[e] = tags[e] in ("article", "main") or up >= 0 and named[up]
        linked[e] = tags[e] == "a" or up >= 0 and linked[up]
        if held[e] == 0 and up >= 0:
            section[e], group[e] = section[up], e if held[up] > 0 else group[up]
    first, last = np.full(many, len(nodes)), np.full(many, -1)
    at = np.flatnonzero(chosen)
    np.minimum.at(first, of[at], at)
    np.maximum.at(last, of[at], at)
    for e in range(many - 1, 0, -1):
        first[parents[e]], last[parents[e]] = min(first[parents[e]], first[e]), max(last[parents[e]], last[e])
    sizes = np.array([len(n[0].strip()) for n in nodes], float)
    size = _held(page, nodes, sizes)
    in_links = _held(page, nodes, sizes * linked[of])
    signs = _held(page, nodes, np.array([sum(map(n[0].count, _PUNCTUATION)) for n in nodes], float))
    blocks = {n[3] for n, c in zip(nodes, chosen, strict=True) if c}

    def wanted(i: int) -> bool:
        e = of[i]
        g, s = group[e], section[e]
        if chosen[i] or nodes[i][3] in blocks or g < 0 or named[s] or tags[g] in _HEADINGS:
            return True
        menu = in_links[g] >= LINKED * size[g]
        grouped = tags[g] in _SECTIONS or tags[g] in _LISTS
        if first[s] < i < last[s]:
            return not (menu and grouped)
        return not menu and (not grouped or tags[g] in _LISTS and signs[g] > 0)

    return np.array([wanted(i) for i in range(len(nodes))])


def main_text(source: str) -> str:
    """The article of one page."""
    page = _Page(source)
    if not page.nodes:
        return ""
    nodes = _unmarked(page)
    chosen = (content_scores(nodes) > 0).astype(float)
    total = chosen.sum()
    held = _held(page, nodes, chosen)
    article = 0
    if total > 0:
        main = [e for e, t in enumerate(page.tags) if t in ("article", "main") and held[e] == total]
        if main:
            article = max(main, key=lambda e: (page.tags[e] == "article", -page.depth[e]))
        else:
            fit = [e for e, t in enumerate(page.tags) if (t in _SECTIONS or e == 0) and held[e] == total]
            article = max(fit, key=lambda e: page.depth[e])
    inside = np.zeros(len(page.tags), bool)
    inside[article] = True
    for element in range(article + 1, len(page.tags)):
        inside[element] = inside[page.parents[element]]
    belongs = _belonging(page, nodes, chosen > 0, held)
    blocks: dict[int, list[str]] = {}
    for (text, _, element, block), wanted in zip(nodes, belongs, strict=True):
        if inside[element] and wanted:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(source: Column) -> Column:
    """The article text of an html column."""

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p) if p else "" for p in pages.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(source.cast("string"))


def articles(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    made = typed(pages, page_id="bigint", url="string", html="string").withColumn("text", extract(F.col("html")))
    return made.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
