"""Main text of web pages from flat blocks of text.

A page is read once, from left to right, without building its tree. Block tags
and the page's ends cut it into text blocks; character references are decoded and
white space inside a block becomes one space. A block is described by its words
and its share of linked words, those of the blocks before and after it, and by
what encloses it: an article or main element, boxes that are named or classed as
menus, headers, footers, sidebars, notices, adverts, forms or comments, and
whether it is a heading. A decision tree, trained on the labelled table in
``main_text_table``, says which blocks are main text; these are joined by two
newlines in page order.

Scripts, styles, templates, controls of forms and comments in the markup are no
text. An end tag that opens nothing is ignored, one that is missing ends with
what encloses it, and a tag that the page's end cuts off is dropped. Null and
empty pages, and pages without main text, have an empty text. Equal pages have
equal texts; every row is kept. Nothing is cut off, however long a page is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices
from .main_text_table import PAGES

FEATURES = ("words", "linked", "before_words", "before_linked", "after_words", "after_linked", "inside", "boxed", "heading")
#: more words than that tell nothing more
MANY = 60.0

# fixed values: elements of HTML
SKIPPED = "script style noscript template svg math textarea select button iframe object canvas audio video title datalist"
BLOCKS = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul"
)
VOID = "area base br col embed hr img input link meta source track wbr"
#: elements that enclose others
HOLDERS = "article aside blockquote details dialog div dl fieldset figure footer form header main menu nav ol search section table ul"
#: elements that never hold main text
BOXES = "aside dialog footer form menu nav search"
#: words of classes, ids and roles that name boxes without main text
NAMES = (
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie "
    "cookies copyright dialog discussion disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notification pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing "
    "sidebar signup skyscraper social sponsor sponsored subscribe subscription teaser teasers toolbar topbar widget widgets"
)
#: names of a whole page that say which boxes it has
ABOUT = {"has", "no", "with", "without"}
#: with these beside it, ``header`` names the head of the text itself
OWN = {"article", "content", "entry", "page", "post", "section", "story"}

_SKIP, _BLOCK, _VOID, _HOLD, _BOX, _NAME = (frozenset(x.split()) for x in (SKIPPED, BLOCKS, VOID, HOLDERS, BOXES, NAMES))
_TALK = frozenset({"comment", "comments", "commentlist", "discussion", "disqus", "replies", "reply", "respond"})
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<skip>{'|'.join(sorted(_SKIP))})(?=[\s/>])[^>]*>.*?(?:</(?P=skip)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<attrs2>[^>]*+)>"
    r"|<[!?][^>]*+>"
    r"|</?[a-z!?][^>]*\Z",
    re.S | re.I,
)
_NAMING = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S | re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HEADING = re.compile(r"h[1-6]\Z")


@dataclass(frozen=True)
class Block:
    text: str
    words: int
    linked: float
    inside: bool
    boxed: bool
    heading: bool


def _box(tag: str, attrs: str) -> str:
    """What an element is by its tag and names: talk, box, named, hidden, or nothing."""
    if tag in _BOX:
        return "box"
    for name, a, b, c in _NAMING.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return "hidden"
        if name in ("class", "id", "role"):
            for label in value.split():
                parts = {x.lower() for x in _PART.findall(label)}
                found = parts & _NAME
                if found & _TALK:
                    return "talk"
                if found and not parts & ABOUT and not (found == {"header"} and parts & OWN):
                    return "named"
    return ""


def blocks(html: str) -> list[Block]:
    """The text blocks of a page."""
    out: list[Block] = []
    # enclosing elements: tag, inside an article, in a box, in a box that reaches into articles
    around: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]
    opened: Counter[str] = Counter()
    pieces: list[tuple[str, bool]] = []
    linked = 0
    heading = False
    at = 0

    def entered(tag: str, kind: str) -> tuple[str, bool, bool, bool]:
        _, inside, boxed, lasting = around[-1]
        if tag == "main":
            return tag, True, False, False
        if tag == "article" and kind not in ("talk", "hidden"):
            # a box that is only named, or a tag left open, doesn't reach into an article
            return tag, True, lasting, lasting
        if kind or (tag == "header" and not inside):
            return tag, inside, True, lasting or kind in ("talk", "hidden") or tag == "aside"
        return tag, inside, boxed, lasting

    def flush() -> None:
        if not pieces:
            return
        # an end of a link may fall inside a word
        text = " ".join(unescape("".join(p for p, _ in pieces)).split())
        if text:
            n = len(text.split(" "))
            share = sum(len(unescape(p).split()) for p, is_link in pieces if is_link) / n
            out.append(Block(text, n, min(share, 1.0), around[-1][1], around[-1][2], heading))
        pieces.clear()

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            pieces.append((html[at : m.start()], linked > 0))
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["skip"]:
                pieces.append((" ", False)) if pieces else None
            continue
        tag = tag.lower()
        end = bool(m["end"] or m["end2"])
        if tag == "a":
            linked = 0 if end else 1
        elif tag == "br":
            pieces.append((" ", False))
        elif tag in _BLOCK:
            flush()
            linked = 0
            heading = bool(_HEADING.match(tag)) and not end
            if tag in _HOLD:
                if not end:
                    around.append(entered(tag, _box(tag, m["attrs"] or m["attrs2"] or "")))
                    opened[tag] += 1
                elif opened[tag]:
                    closed = ""
                    while closed != tag:
                        closed = around.pop()[0]
                        opened[closed] -= 1
    if at < len(html):
        pieces.append((html[at:], linked > 0))
    flush()
    return out


def described(found: list[Block]) -> list[list[float]]:
    """The features of the blocks of a page."""
    size = [min(float(b.words), MANY) for b in found]
    rows = []
    for i, b in enumerate(found):
        before = (size[i - 1], found[i - 1].linked) if i else (0.0, 0.0)
        after = (size[i + 1], found[i + 1].linked) if i + 1 < len(found) else (0.0, 0.0)
        rows.append([size[i], b.linked, *before, *after, float(b.inside), float(b.boxed), float(b.heading)])
    return rows


def labelled() -> list[tuple[int, list[float]]]:
    """Label and features of the blocks of the labelled table."""
    out = []
    for page in PAGES:
        found = described(blocks("".join(html for _, html in page)))
        labels = [is_main for is_main, _ in page if is_main is not None]
        if len(labels) != len(found):
            raise ValueError("a piece of the labelled table holds another number of blocks")
        out += list(zip(labels, found))
    return out


#: (feature, threshold, where to go up to it, where to go above it), or (-1, label, 0, 0)
Tree = list[tuple[int, float, int, int]]


def learn(spark: SparkSession, depth: int = 6) -> Tree:
    """A decision tree over the labelled table."""
    rows = spark.createDataFrame([(float(y), Vectors.dense(x)) for y, x in labelled()], ["label", "features"])
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=128, minInstancesPerNode=1, seed=1).fit(rows.coalesce(1))
    tree: Tree = []

    def add(node) -> int:
        place = len(tree)
        tree.append((-1, float(node.prediction()), 0, 0))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            tree[place] = (split.featureIndex(), split.threshold(), add(node.leftChild()), add(node.rightChild()))
        return place

    add(model._java_obj.rootNode())
    return tree


def is_main(tree: Tree, features: list[float]) -> bool:
    at = 0
    while tree[at][0] >= 0:
        feature, threshold, left, right = tree[at]
        at = left if features[feature] <= threshold else right
    return tree[at][1] > 0.5


def main_text(tree: Tree, html: str | None) -> str:
    found = blocks(html or "")
    return "\n\n".join(b.text for b, x in zip(found, described(found)) if is_main(tree, x))


def extract(pages: DataFrame, html: str = "html", out: str = "text", tree: Tree | None = None) -> DataFrame:
    """``pages`` with their main text in ``out``, in place of a column of that name.

    Only the html goes to Python and only the text comes back.
    """
    tree = learn(pages.sparkSession) if tree is None else tree

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            parts = [pa.array([main_text(tree, x) for x in s.column(0).to_pylist()], pa.string()) for s in slices(pa.RecordBatch.from_arrays([b], ["html"]), 0)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return pages.withColumn(out, texts(F.col(html)))
