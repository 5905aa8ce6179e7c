"""Main text of web pages by tag-path ratios.

A page is read as blocks of text, each at a path of tags from the root; paths
are nodes of a trie. For every path the text length, punctuation and link text
of its blocks are added up and divided by its blocks. The ratios are smoothed
over similar paths (those that differ in the last tags only), which sums of the
trie's nodes over their nearest descendants give in a fixed number of steps per
path, fused into one number per path, and paths above a threshold are content.
Elements whose kind says that they are something else (navigation, forms, hidden
parts and so on) carry no content; names of classes only weigh a path.

All steps take time in proportion to the page, whatever its depth, its number of
paths and classes, and however broken its tags are.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import prepare

#: A path is content from this share of the page's mean (weighted by text) on, and within its article or main element.
THRESHOLD, INSIDE_THRESHOLD = 0.25, 0.02
#: Width of the smoothing, in tags that two paths don't share, and how far it reaches.
WIDTH, REACH = 1.0, 3
#: Weight of paths outside the page's own article or main element, if it has one with text.
OUTSIDE = 0.02
#: Weight of paths through a container whose class or id names something that isn't the article.
NAMED = 0.004
#: Characters of a tag in which quotes hide a ">"; beyond, the tag ends at its first ">".
LONG_TAG = 1 << 14

_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""(?:"[^"]*"|'[^']*'|[^'">])*+>""")
_ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)|(\bhidden\b)""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？：；\"'()«»]")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes iframe noscript template svg math object canvas audio video".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_NEVER = frozenset("nav footer aside form script style noscript template head button select option menu dialog fieldset".split())
#: What a start tag closes where its end was left out, and the elements beyond which it doesn't.
_CLOSED_BY = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
_BLOCKS_END_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SCOPE = frozenset("table ul ol dl td th body html div section article".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_OTHER = frozenset(
    "nav navbar navigation menu masthead banner footer sidebar aside widget widgets related recommended recommendations promo promos promotion promoted advert adverts advertisement advertising ad ads adsense sponsor sponsored sponsors cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay newsletter subscribe subscription signup login form search share sharing social breadcrumb breadcrumbs pagination pager comment comments disqus respond reply replies toolbar copyright disclaimer skip".split()
)
_WEAK = frozenset("widget widgets notice notices alert banner form search skip copyright disclaimer".split())
_CONTENT = frozenset("content main article post entry story body text page wrapper container layout".split())
#: Elements that hold a block's own text: their class says how it looks rather than what it is.
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption address summary html body".split())
#: Parts of a table that don't count as steps, so that its cells are as near to a paragraph as the table is.
_TABLE_PARTS = frozenset("tr tbody thead tfoot".split())


def _described(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, str]:
    """Whether an element's kind says that it isn't content, whether its names do, and its step in a path."""
    step, named = tag, False
    if tag in _NEVER or tag == "header" and not inside:
        return True, False, step
    if attributes and tag not in ("html", "body"):
        for name, value, hidden in _ATTRIBUTE.findall(attributes):
            if hidden:
                return True, False, step
            name, value = name.lower(), value.strip("\"'")
            if name == "role" and value.lower() in _ROLES or name == "aria-hidden" and value.lower() == "true":
                return True, False, step
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, False, step
            if name in ("class", "id") and value:
                words = {w.lower() for w in _WORDS.findall(value)}
                other = words & _OTHER
                if words & _CONTENT:  # "post-notice" may be content, "post-comments" is not, "has-sidebar" says nothing
                    other -= _WEAK | (_OTHER if words & {"with", "has", "no", "without"} else set())
                if tag not in _LEAF and (other or "header" in words and not inside and not words & {"article", "post", "entry", "story"}):
                    named = True
                if name == "class":
                    step = f"{tag}.{'.'.join(sorted(words))}"
    return False, named, f"{step}!" if named else step


class Page:
    """Blocks of a page, and the trie of their paths: of each node its parent, and what is said of it on the way from the root."""

    def __init__(self, page: str):
        self.parent, self.inside, self.named = [-1], [False], [False]
        self.children: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters inside links
        self.stack: list[tuple[str, int, bool]] = []  # tag, node, excluded (itself or one above)
        self.open: dict[str, list[int]] = defaultdict(list)  # places of a tag's open elements in the stack
        self.solid, self.scopes = [-1], [-1]  # places of elements that aren't inline, and of those that bound what a tag closes
        self.pieces: list[str] = []
        self.linked: list[str] = []
        self._read(page)
        self._end_block()

    def _text(self, piece: str) -> None:
        if piece and not (self.stack and self.stack[-1][2]):
            self.pieces.append(piece)
            if self.open["a"]:
                self.linked.append(piece)

    def _end_block(self) -> None:
        if self.pieces:
            words = " ".join(html.unescape("".join(self.pieces)).split())
            if words:
                self.blocks.append((self.stack[-1][1] if self.stack else 0, words, len(" ".join(html.unescape("".join(self.linked)).split()))))
            self.pieces.clear()
        self.linked.clear()

    def _close(self, place: int) -> None:
        for tag, _, _ in reversed(self.stack[place:]):
            self.open[tag].pop()
        del self.stack[place:]
        for places in (self.solid, self.scopes):
            while places[-1] >= place:
                places.pop()

    def _push(self, tag: str, attributes: str) -> None:
        above, node = (self.stack[-1][2], self.stack[-1][1]) if self.stack else (False, 0)
        inside = bool(self.open["article"] or self.open["main"])
        excluded, named, step = (True, False, tag) if above else _described(tag, attributes, inside)
        if tag not in _INLINE and not excluded and tag not in _TABLE_PARTS:
            child = self.children.setdefault((node, step), len(self.parent))
            if child == len(self.parent):
                self.parent.append(node)
                self.inside.append(self.inside[node] or tag in ("article", "main"))
                self.named.append(self.named[node] or named)
            node = child
        place = len(self.stack)
        self.open[tag].append(place)
        if tag not in _INLINE:
            self.solid.append(place)
        if tag in _SCOPE:
            self.scopes.append(place)
        self.stack.append((tag, node, excluded))

    def _end_tag(self, tag: str) -> None:
        places = self.open[tag]
        if not places:
            return
        if tag in _INLINE and self.solid[-1] > places[-1] or tag == "p" and self.scopes[-1] > places[-1]:
            return
        self._close(places[-1])

    def _start_tag(self, tag: str, attributes: str) -> None:
        if tag in _CLOSED_BY:
            closed, bounds = _CLOSED_BY[tag]
            nearest = max((self.open[t][-1] for t in closed if self.open[t]), default=-1)
            if nearest > max((self.open[t][-1] for t in bounds if self.open[t]), default=-1):
                self._close(nearest)
        elif tag in _BLOCKS_END_P and self.open["p"] and self.open["p"][-1] > self.scopes[-1]:
            self._close(self.open["p"][-1])
        if tag in ("html", "body") and self.open[tag]:
            return
        if tag == "body" and self.stack and self.stack[-1][0] == "head":
            self._close(len(self.stack) - 1)
        self._push(tag, attributes)

    def _read(self, page: str) -> None:
        at, size, last = 0, len(page), page.rfind(">")
        while m := _OPEN.search(page, at):
            start, kind = m.start(), m.group()
            if start > last and kind[1] not in "!?":
                break  # no tag ends from here on
            self._text(page[at:start])
            if kind == "<!--":
                end = page.find("-->", m.end())
                at = size if end < 0 else end + 3
                continue
            if kind[1] in "!?":
                end = page.find(">", m.end())
                at = size if end < 0 else end + 1
                continue
            name = _NAME.match(page, start + 1)
            rest = _REST.match(page, name.end(), min(size, name.end() + LONG_TAG))
            at = rest.end() if rest else page.find(">", name.end()) + 1
            self._tag(name[1].lower(), kind[1] == "/", page[name.end() : at - 1])
            if kind[1] != "/" and name[1].lower() in _RAW:
                stop = _raw_end(name[1].lower()).search(page, at)
                at = stop.end() if stop else size
        self._text(page[at:])

    def _tag(self, tag: str, ending: bool, attributes: str) -> None:
        if tag == "br":
            self._text(" ")
            return
        if tag not in _INLINE:
            self._end_block()
        if ending:
            self._end_tag(tag)
        elif tag not in _RAW and tag not in _VOID:
            self._start_tag(tag, attributes)


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def content_paths(page: Page) -> set[int]:
    """The paths whose fused, smoothed ratios pass the threshold."""
    sums: dict[int, list[float]] = {}
    for node, words, linked in page.blocks:
        s = sums.setdefault(node, [0, 0, 0, 0])
        s[0] += len(words)
        s[1] += len(_PUNCTUATION.findall(words))
        s[2] += linked
        s[3] += 1
    has_inside = any(page.inside[n] for n in sums)
    # Text and punctuation that isn't linked, per block, in sums over a node's descendants of each depth.
    below: dict[tuple[int, int], list[float]] = {}
    for node, (chars, marks, linked, blocks) in sums.items():
        free = max(0, chars - linked)
        own = (chars, chars * free / blocks, chars * marks * free / chars / blocks)
        up = node
        for depth in range(REACH + 1):
            s = below.setdefault((up, depth), [0.0, 0.0, 0.0])
            for i in range(3):
                s[i] += own[i]
            up = page.parent[up]
            if up < 0:
                break
    weights = [math.exp(-0.5 * (d / WIDTH) ** 2) for d in range(REACH + 1)]
    nothing = (0.0, 0.0, 0.0)
    fused = {}
    for node in sums:
        total = [0.0, 0.0, 0.0]
        up, under = node, None
        for k in range(REACH + 1):  # paths that share with this one all but its last k steps
            for j in range(REACH + 1):
                here = below.get((up, j), nothing)
                there = below.get((under, j - 1), nothing) if under is not None and j else nothing
                w = weights[max(k, j)]
                for i in range(3):
                    total[i] += w * (here[i] - there[i])
            up, under = page.parent[up], up
            if up < 0:
                break
        chars, _, linked, _ = sums[node]
        outside = OUTSIDE if has_inside and not page.inside[node] else 1
        fused[node] = total[1] / total[0] * (1 + math.log1p(max(0.0, total[2] / total[0]))) * (1 - linked / chars) * outside * (NAMED if page.named[node] else 1)
    all_chars = sum(s[0] for s in sums.values())
    mean = sum(fused[n] * s[0] for n, s in sums.items()) / all_chars if all_chars else 0
    return {n for n in sums if fused[n] > 0 and fused[n] >= (INSIDE_THRESHOLD if page.inside[n] else THRESHOLD) * mean}


def main_text(page: str | None) -> str:
    """The page's content blocks in page order, one per line."""
    read = Page(page or "")
    keep = content_paths(read)
    return "\n".join(words for node, words, _ in read.blocks if node in keep)


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([main_text(p) for p in batch.column(2).to_pylist()], pa.string())], ["id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text), one row per row.

    Null and empty pages, and pages without content, give an empty text. Pages of
    any length are read whole, in time that follows their length. Rows that
    repeat, rows without an id and ties give a row each; other columns, whatever
    their names, are not read. An empty table gives an empty result.
    """
    prepare(pages.sparkSession)
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col)).mapInArrow(_text_rows, f"id {kinds[0]}, url {kinds[1]}, text string")


def extract_report(pages: DataFrame) -> DataFrame:
    """The contract's columns, one row per page."""
    return extract(pages).select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
