"""Main text of web pages by tag-path ratios.

A tolerant reader turns a page into blocks of text, each with its tag path: the elements from the root to the block, those that group others (``div``,
``section``, lists and the like) with their class. Blocks inside elements that never hold an article's text by their tag or role (menus, forms, scripts, side bars) are left out at once.
For the rest, text length and punctuation are summed up per tag path:

    ratio(path) = characters / blocks,  punctuation ratio(path) = punctuation marks / blocks

Both series, in the order in which the paths first occur, are smoothed with a Gaussian and fused by their geometric mean; paths over
the threshold (the mean less a share of the standard deviation, in logarithms) are content paths. The content nodes' blocks vote, by length and ratio, for the
container that holds the article: an article or main element that has half of their votes, else the deepest grouping element with nearly all of them.

Words in class and id (``comments``, ``related``) are hints, of three kinds. What a sure word names, alone or among words that leave it what it is (``site-footer``), is set aside, unless it holds nearly
all the text. A soft word (``legal``, ``related``) or a word in a longer name (``legal-aspects``) has no vote for the container; outside of the container it goes, inside its ratio decides: it stays if
a content path ends in it. Without an article element the ratios decide beside the container too: of the branches that hang from the elements around it, or from itself if it has no text of its own,
a ``div`` or ``section`` goes if no content path ends in it, and so does any list of links; paragraphs, headings and tables stay.

Character references are decoded, white space in a block becomes one space, blocks are trimmed and joined by a line feed.

Nulls and empty pages give an empty text. Long pages: reading and choosing take time and memory in proportion to the page, at any depth of elements; a page is held whole. Ties: of containers with equal votes
the first is taken. Repeated rows come back as often as they occur; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, slices

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
ASIDE = frozenset("head nav header footer aside form button select option menu menuitem dialog script style noscript template iframe object embed canvas svg math audio video map textarea fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_SURE = (
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side-bar footer foot header masthead cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe signup login comment comments reply replies respond disqus share sharing social pagination pager banner aside widget notice notices notification alert toolbar skip hidden"
).split()
_SOFT = "related recommended recommendations copyright legal".split()


def _words(words: list[str]) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{'|'.join(words)})(?:$|[\s_-])")


SURE, WORDS = _words(_SURE), _words(_SURE + _SOFT)
#: Names such as ``has-sidebar`` tell what an element stands beside.
_BESIDE = re.compile(r"(?:^|(?<=[\s_-]))(?:has|with|no|without)[_-][\w-]+")
#: Parts that leave a listed word what it is: ``site-footer`` is a footer, ``legal-aspects`` may be a chapter.
_PARTS = frozenset(
    "site page main top bottom left right global primary secondary post posts entry article articles story stories news list box block wrapper wrap container area section item items link links bar inner outer content "
    "button buttons icon icons media text message form js slot unit side in up out back policy title row col column sm md lg xs".split()
)
#: Elements that an open one of the same kind, or of these, ends; and elements at which the search for it ends.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDS = {"p": ("table", "td", "button"), "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: A start tag of one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may be containers, and those whose class is part of the path.
GROUPS = frozenset("# html body main article section div center".split())
CLASSED = frozenset("main article section div ul ol dl table td".split())
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？؛،·]")
# a quote without its second one is a character like others
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SMOOTH = np.exp(-0.5 * (np.arange(-2, 3) / 0.6) ** 2)


class Node:
    """An element. Elements with equal paths from the root on share the number ``path``; numbers rise from parents to children."""

    __slots__ = ("tag", "path", "parent", "aside", "number", "depth", "named", "pieces", "linked", "nested")

    def __init__(self, tag: str, parent: Node | None, aside: bool, number: int, path: int = 0, named: str = ""):
        self.tag, self.parent, self.aside, self.number, self.path = tag, parent, aside, number, path
        self.depth = parent.depth + 1 if parent else 0
        self.named = named  # "sure" or "doubtful" if the element's class or id has a listed word
        self.pieces: list[str] = []  # text that is not yet a block
        self.linked = 0  # characters of its blocks that stand in links
        self.nested = 0  # of an inline element: open ones of its tag inside


def _by_name(tag: str, value: str) -> str:
    """Whether a class or id tells that an element holds no article's text: "sure" if one of its names is a sure word, alone or among words
    that leave it what it is; "doubtful" if it has another listed word, or one that is but a part of a name."""
    value = _BESIDE.sub(" ", value)
    if tag in ("body", "html", "main") or not WORDS.search(value):
        return ""
    for name in value.split():
        if SURE.search(name) and all(WORDS.search(x) or x in _PARTS or not x.isalpha() for x in re.split("[_-]+", name)):
            return "sure"
    return "doubtful"


def _told(tag: str, attributes: str, parent: Node) -> tuple[bool, str, str]:
    """Whether an element is set aside by its tag, role or hiding, what its names tell, and its class."""
    if parent.aside or tag in ASIDE:
        return True, "", ""
    named = kind = ""
    for name, a, b, c in _ATTRIBUTE.findall(attributes or ""):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id") and named != "sure":
            named = _by_name(tag, value) or named
        if name == "class":
            kind = re.sub(r"\d+", "", value)
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, "", ""
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, "", ""
    return False, "" if tag == "article" and named == "doubtful" else named, kind if tag in CLASSED else ""


class Reader:
    """Reads a page into ``blocks`` (text, node) and ``nodes``, in one pass. Of each tag the open elements are known, so nothing is searched up the tree."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, Node]] = []
        self.now = root = Node("#", None, False, 0)
        self.nodes, self.open, self.paths = [root], {}, {}
        self.link = False
        self.read(html)

    def flush(self, node: Node) -> None:
        if node.pieces:
            text = " ".join("".join(node.pieces).split())
            node.pieces = []
            if text:
                self.blocks.append((text, node))

    def text(self, text: str) -> None:
        if not self.now.aside:
            self.now.pieces.append(text)
            if self.link:
                self.now.linked += len(text.strip())

    def nearest(self, tags) -> Node | None:
        return max((self.open[x][-1] for x in tags if self.open.get(x)), key=lambda x: x.depth, default=None)

    def close(self, node: Node) -> None:
        """Ends an open element and all in it."""
        while True:
            last, self.now = self.now, self.now.parent
            self.flush(last)
            self.open[last.tag].pop()
            if last is node:
                return

    def interrupt(self) -> None:
        """A block begins or ends here: what came before is a block of its own."""
        node = self.now
        while not node.aside and node.parent and node.tag in INLINE:
            self.flush(node)
            node = node.parent
        if not node.aside:
            self.flush(node)

    def push(self, tag: str, attributes: str) -> None:
        hides, named, kind = _told(tag, attributes, self.now)
        if tag in INLINE and not hides and named != "sure":
            return
        key = (self.now.path, tag, kind)
        self.now = Node(tag, self.now, hides, len(self.nodes), self.paths.setdefault(key, len(self.paths) + 1), named)
        self.nodes.append(self.now)
        self.open.setdefault(tag, []).append(self.now)

    def start(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            self.link = self.link or tag == "a"
            if self.open.get(tag):
                self.open[tag][-1].nested += 1
            else:
                self.push(tag, attributes)
            return
        self.interrupt()
        for ended in ("p",) * (tag in ENDS_P), CLOSES.get(tag, ()):
            node = self.nearest(ended)
            bound = self.nearest(BOUNDS.get("p" if ended == ("p",) else tag, ()))
            if node and not (bound and bound.depth > node.depth):
                self.close(node)
        if tag in HEADINGS and self.now.tag in HEADINGS:
            self.close(self.now)
        self.push(tag, attributes.rstrip("/"))

    def end(self, tag: str) -> None:
        node = self.open[tag][-1] if self.open.get(tag) else None
        if tag in INLINE:
            self.link = self.link and tag != "a"
            if node and node.nested:
                node.nested -= 1
            elif node:
                self.close(node)
            return
        self.interrupt()
        self.link = False
        if node:
            self.close(node)

    def read(self, html: str) -> None:
        at, length, endless = 0, len(html), set()
        while at < length:
            found = _TOKEN.search(html, at)
            if not found:
                self.text(unescape(html[at:]))
                break
            if found.start() > at:
                self.text(unescape(html[at : found.start()]))
            at = found.end()
            closing, tag = found.group(1), (found.group(2) or "").lower()
            if not tag:
                continue
            if tag == "br":
                self.text(" ")
            elif closing:
                self.end(tag)
            elif tag in RAW:
                end = None if tag in endless else re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*>?", re.I).search(html, at)
                if not end:
                    endless.add(tag)
                if end or tag != "noscript":
                    at = end.end() if end else length
                    self.text(" ")
            elif tag in VOID:
                if tag == "hr":
                    self.interrupt()
            else:
                self.start(tag, found.group(3) or "")
        while self.now.parent:
            self.close(self.now)
        self.flush(self.now)


def _smoothed(values: np.ndarray) -> np.ndarray:
    weight = np.convolve(np.ones(len(values)), SMOOTH, "full")[2 : 2 + len(values)]
    return np.convolve(values, SMOOTH, "full")[2 : 2 + len(values)] / weight


def content_paths(found: list[tuple[str, Node]], share: float = 0.5) -> dict[int, float]:
    """Fused, smoothed ratio of each tag path that passes the threshold."""
    totals: dict[int, list[int]] = {}
    for text, node in found:
        total = totals.setdefault(node.path, [0, 0, 0])
        total[0] += len(text)
        total[1] += len(PUNCTUATION.findall(text))
        total[2] += 1
    sums = np.array([*totals.values()], np.float64).reshape(-1, 3)
    length, marks = sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]
    fused = np.log1p(np.sqrt(_smoothed(length) * _smoothed(marks + 0.1)))
    least = fused.mean() - share * fused.std()
    return {path: float(x) for path, x in zip(totals, fused, strict=True) if x >= least - 1e-9}


class Page:
    """A page's blocks, and what of them is the main text."""

    def __init__(self, html: str, cover: float = 0.9):
        self.cover = cover
        own = Reader(html)
        self.nodes, self.found = own.nodes, own.blocks

    def held(self, values: dict[int, float]) -> list[float]:
        """Of each element the sum over all blocks in it; values: of elements, of their own blocks."""
        out = [0.0] * len(self.nodes)
        for k, x in values.items():
            out[k] = x
        for node in reversed(self.nodes[1:]):
            out[node.parent.number] += out[node.number]
        return out

    def down(self, first, then) -> list:
        """A value for each element: ``first`` of the root, and of another ``then(element, its parent's value)``."""
        out = [first]
        for node in self.nodes[1:]:
            out.append(then(node, out[node.parent.number]))
        return out

    def main(self) -> list[str]:
        def sized(found):
            out: dict[int, float] = {}
            for text, node in found:
                out[node.number] = out.get(node.number, 0) + len(text)
            return out

        size = self.held(sized(self.found))
        set_aside = self.down(False, lambda x, above: above or x.named == "sure" and size[x.number] < self.cover * size[0])
        found = [(text, node) for text, node in self.found if not set_aside[node.number]]
        if not found:
            return []
        doubt = self.down(0, lambda x, above: above or (x.number if x.named == "doubtful" else 0))  # the outermost doubtful element
        sure = [x for x in found if not doubt[x[1].number]] or found
        paths = content_paths(found)
        votes: dict[int, float] = {}
        for text, node in sure:
            if node.path in paths:
                votes[node.number] = votes.get(node.number, 0) + len(text) * paths[node.path]
        if not votes:  # only doubtful parts have content
            votes = sized(sure)
        container = self.container(self.held(votes))
        inside = self.down(container is self.nodes[0], lambda x, above: above or x is container)
        content = {node.number for _, node in found if node.path in paths and node.tag not in HEADINGS}
        holds = self.held(dict.fromkeys(content, 1))
        branch = self.branches(container, found)
        linked = self.held({x.number: x.linked for x in self.nodes if x.linked})
        many = self.held(sized([("x", x) for _, x in found]))
        article = container.tag in ("article", "main")

        def stays(node: Node) -> bool:
            if named := doubt[node.number]:
                return (inside[node.number] or sure is found) and holds[named] > 0
            top = branch[node.number]
            if article or top is None:
                return not article or inside[node.number]
            links = many[top.number] > 1 and linked[top.number] >= 0.8 * size[top.number]
            return not links and (holds[top.number] > 0 or top.tag not in ("div", "section", "center"))

        return [text for text, node in found if stays(node)]

    def container(self, votes: list[float]) -> Node:
        """An article or main element with half of all votes, else the deepest grouping element with nearly all."""
        in_article = self.down(False, lambda x, above: above or x.parent.tag == "article")
        named = [x for x in self.nodes if x.tag in ("article", "main") and votes[x.number] >= 0.5 * votes[0] and not in_article[x.number]]
        if named:
            return max(named, key=lambda x: (x.tag == "article", votes[x.number], -x.number))
        return max((x for x in self.nodes if x.tag in GROUPS and votes[x.number] >= self.cover * votes[0]), key=lambda x: (x.depth, -x.number))

    def branches(self, container: Node, found: list[tuple[str, Node]]) -> list[Node | None]:
        """Of each element the one in which it hangs from an element around the container (or from the container, if that has no text of its own
        or is the whole page); None for those around it and, else, in it."""
        around, node = {0}, container
        while node:
            around.add(node.number)
            node = node.parent
        loose = {x.parent.number for _, x in found if x.parent and x.tag not in GROUPS} | {x.number for _, x in found}
        if container.number in loose and container.tag not in ("#", "html", "body"):
            inside = self.down(container is self.nodes[0], lambda x, above: above or x is container)
        else:
            inside = [False] * len(self.nodes)
        return self.down(None, lambda x, above: None if x.number in around or inside[x.number] else above or x)


def main_text(html: str, cover: float = 0.9) -> str:
    """The main text of a page, its blocks joined by line feeds."""
    return "\n".join(Page(html, cover).main())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    bounded_batches(pages.sparkSession)
    narrow = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    kinds = [narrow.schema[k].dataType.simpleString() for k in range(2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(x or "") for x in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return narrow.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
