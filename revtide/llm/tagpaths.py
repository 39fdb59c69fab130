"""Main text of web pages by tag-path ratios.

A page is read once into its text leaves, each with the path of elements above it. Leaves of the same path are taken
together: the text length and the punctuation per leaf of a path are smoothed along the page, fused to one score, and
paths above a threshold mark content. The element that holds nearly all marked text is the article; its blocks come
out in page order. Leaves under elements that never hold the article (menus, forms, scripts and so on, by element
name or by the words of class, id and role) take no part.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from statistics import pstdev

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revtide.llm.common import with_column

# Element names by their role in HTML, and words that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
FURNITURE = frozenset("head nav footer aside form button select option datalist dialog menu script style textarea title iframe noscript noembed noframes template svg math object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
LEAF_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody thead tfoot table ul ol dl figure figcaption address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disqus footer gdpr "
    "header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promotion "
    "recommended related respond search share sharing sidebar signup social sponsor sponsored subscribe subscription taboola teaser toolbar widget widgets "
    "contentinfo complementary replies reply discussion alert toc disclaimer".split()
)
#: Elements that close an open element of their own kind, and those that close an open paragraph.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NOT_IN_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
PUNCTUATION = frozenset(".,;:!?…。，、；：！？؟،।")

#: Leaves on either side that a path's ratio is smoothed with, the share of marked text that an article holds, and a menu's share of links.
RADIUS, SHARE, LINKS = 2, 0.8, 0.8

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_NAMES = re.compile(r"""(?i)\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"""(?i)(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""")


class _Page:
    """Elements and text leaves of one page."""

    def __init__(self, text: str):
        self.parent, self.tag, self.path, self.out, self.inside = [-1], [""], [0], [False], [False]
        self.leaves: list[tuple[int, int, str, bool]] = []  # element, block, text, in a link
        self.paths: dict[tuple[int, str], int] = {}
        self.stack = [0]
        self.block = 0
        self._read(text)

    def _open(self, tag: str, attributes: str) -> None:
        up = self.stack[-1]
        words: set[str] = set()
        if attributes:
            for m in _NAMES.finditer(attributes):
                words.update(w.lower() for w in _WORD.findall(m[1] or m[2] or m[3] or ""))
        article = self.inside[up] or tag in ("article", "main")
        furniture = tag in FURNITURE or (tag == "header" and not self.inside[up])
        if tag not in ("html", "body", "article", "main"):
            marked = words & WORDS
            if article and tag == "header":
                marked -= {"header"}
            furniture |= bool(marked) or bool(attributes and _HIDDEN.search(attributes))
        name = ".".join([tag, *sorted(words)])
        self.parent.append(up)
        self.tag.append(tag)
        self.path.append(self.paths.setdefault((self.path[up], name), len(self.paths) + 1))
        self.out.append(self.out[up] or furniture)
        self.inside.append(article)
        self.stack.append(len(self.parent) - 1)

    def _close(self, tag: str, stop: frozenset[str] = frozenset()) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.tag[self.stack[i]]
            if name == tag:
                if tag in INLINE:
                    del self.stack[i]
                else:
                    del self.stack[i:]
                return
            if name in stop or (tag in INLINE and name not in INLINE):
                return

    def _read(self, text: str) -> None:
        at, low = 0, None
        links = 0
        while True:
            m = _TOKEN.search(text, at)
            chunk = text[at : m.start() if m else len(text)]
            if chunk and not chunk.isspace():
                self.leaves.append((self.stack[-1], self.block, references.unescape(chunk), links > 0))
            elif chunk:
                self.leaves.append((self.stack[-1], self.block, " ", False))
            if not m:
                return
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing, attributes = m[1] or m[4], m[3] or m[6] or ""
            if tag not in INLINE:
                self.block += 1
            if closing:
                self._close(tag)
                links = max(0, links - (tag == "a"))
                continue
            if tag in NOT_IN_P:
                self._close("p", frozenset(("button", "table", "div", "section", "article", "li", "td", "th")))
            for other in CLOSES.get(tag, ()):
                self._close(other, frozenset(("ul", "ol", "dl", "table", "select")))
            if tag in VOID or attributes.endswith("/") and tag in ("svg", "path", "br"):
                continue
            if tag in RAW:
                low = low if low is not None else text.lower()
                if len(low) != len(text):
                    low = re.sub(r"[A-Z]", lambda x: x[0].lower(), text)
                end = low.find(f"</{tag}", at)
                close = low.find(">", end) if end >= 0 else -1
                at = close + 1 if close >= 0 else len(text)
                continue
            links += tag == "a"
            self._open(tag, attributes)


def _smooth(values: list[float]) -> list[float]:
    weights = {i: 2.0 ** -(i * i) for i in range(-RADIUS, RADIUS + 1)}
    out = []
    for i in range(len(values)):
        near = [(w, values[i + d]) for d, w in weights.items() if 0 <= i + d < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def main_text(page: str | None) -> str:
    """Text of the article of a page, one block a line; empty if there is none."""
    if not page:
        return ""
    read = _Page(page)
    blocks: dict[int, list[int]] = {}
    for i, (element, block, _, _) in enumerate(read.leaves):
        if not read.out[element]:
            blocks.setdefault(block, []).append(i)
    menus = set()
    for block, own in blocks.items():  # list items that are nothing but links
        size = sum(len(read.leaves[i][2].strip()) for i in own)
        linked = sum(len(read.leaves[i][2].strip()) for i in own if read.leaves[i][3])
        if size and linked >= LINKS * size and _under(read, read.leaves[own[0]][0], "li"):
            menus.add(block)
    leaves = [x for x in read.leaves if not read.out[x[0]] and x[1] not in menus]
    full = [x for x in leaves if not x[2].isspace()]
    if not full:
        return ""
    count: dict[int, int] = {}
    length: dict[int, int] = {}
    marks: dict[int, int] = {}
    for element, _, text, _ in full:
        path = read.path[element]
        count[path] = count.get(path, 0) + 1
        length[path] = length.get(path, 0) + len(text.strip())
        marks[path] = marks.get(path, 0) + sum(c in PUNCTUATION for c in text)
    order = [read.path[x[0]] for x in full]
    ratios = _smooth([length[p] / count[p] for p in order])
    dots = _smooth([marks[p] / count[p] for p in order])
    fused: dict[int, float] = {}
    for p, r, d in zip(order, ratios, dots, strict=True):
        fused[p] = fused.get(p, 0.0) + r * (d + 0.1) / count[p]
    threshold = min(pstdev(fused.values()), max(fused.values()))
    content = {p for p, score in fused.items() if score >= threshold}
    held = [0] * len(read.parent)
    for element, _, text, _ in full:
        if read.path[element] in content:
            while element >= 0:
                held[element] += len(text)
                element = read.parent[element]
    article = 0
    for element in range(1, len(read.parent)):
        if read.parent[element] == article and held[element] >= SHARE * held[0] and read.tag[element] not in LEAF_BLOCKS | INLINE:
            article = element
    loose = read.tag[article] in ("", "html", "body")
    inside = [False] * len(read.parent)
    inside[article] = True
    for element in range(article + 1, len(read.parent)):
        inside[element] = inside[read.parent[element]]
    out: dict[int, list[str]] = {}
    keep: set[int] = set()
    for element, block, text, _ in leaves:
        if inside[element]:
            out.setdefault(block, []).append(text)
            if not loose or read.path[element] in content or _under(read, element, *HEADINGS):
                keep.add(block)
    lines = (" ".join("".join(parts).split()) for block, parts in out.items() if block in keep)
    return "\n".join(line for line in lines if line)


def _under(read: _Page, element: int, *tags: str) -> bool:
    while element > 0:
        if read.tag[element] in tags:
            return True
        element = read.parent[element]
    return False


def extract_main_text(pages: DataFrame, text: str = "text", html_col: str = "html") -> DataFrame:
    """``pages`` with the main text of each in a column ``text``.

    Null, empty and text-less pages give an empty text. Repeated pages give it each; other columns stay; ``text``
    must be a new name.
    """
    schema = T.StructType([*pages.schema.fields, T.StructField(text, T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(batch.schema.get_field_index(html_col))
            yield with_column(batch, text, pa.array([main_text(x.as_py()) for x in html], pa.string()))

    return pages.mapInArrow(scan, schema)


def extraction_report(pages: DataFrame) -> DataFrame:
    """One row per page: id, address, text and its length in code points."""
    slim = pages.select("page_id", "url", "html")
    return extract_main_text(slim).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
