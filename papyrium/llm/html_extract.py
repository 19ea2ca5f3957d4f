"""Main text of web pages by composite text density.

A page becomes a small tree of elements. Elements that name themselves as something else than the article
(menus, page headers, footers, sidebars, notices, adverts, forms, reader comments, scripts, styles) are
taken out, except where such a name or form stands on what holds the article or most of the page's text,
or on a block of prose within the article. For every other element the characters a tag, adjusted for the share of links, are its density;
an element's density sum adds the densities of its children. The element with the largest sum leads to the
article: if it stands in an article or main element, that whole element is the article. Otherwise the
lowest density on the path from the body to it is the threshold, and the path's other children are kept
where they reach it, headings always.

A map over the pages with no shuffle; each page is read whole.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._batch import bounded
from ._session import packed, quoted, ship, table, without

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")

RAW = {"script", "style", "title", "textarea", "xmp", "noembed", "noframes", "iframe"}
VOID = set("area base br col embed hr img input link meta param source track wbr keygen frame basefont".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
GONE = set("head script style title textarea noscript template iframe object embed applet svg canvas audio video map nav footer aside form button select option datalist dialog menu menuitem noembed noframes xmp input fieldset legend".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist note status".split())
#: Words in a class or id that name what isn't the article.
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "sidebar sidebars aside rail widget widgets menu menus nav navbar navigation navigations breadcrumb breadcrumbs topbar toolbar masthead footer footers "
    "copyright comment comments commentlist disqus respond reply replies discussion share sharing social newsletter subscribe subscription signup login "
    "related recommended recommendations popup modal overlay alert paywall pagination pager skip sitemap toc search hidden".split()
)
#: Names of sections of an article, too: within one they only tell what is mostly links.
SECTIONS = set("discussion related notice notices".split())
#: A class that starts with one of these says something of the layout, not what its element is.
LAYOUT = {"has", "no", "not", "non", "with", "without"}
#: Elements that are taken out like those with a name; the other ones of GONE never hold an article.
DOUBTED = {"form", "fieldset", "aside", "dialog"}
HEADER_NAMES = {"header", "head", "siteheader", "pageheader"}
#: An opening tag of these ends an open paragraph.
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt body".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"},
}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
ROOTS = {"article", "main"}


class _Node:
    __slots__ = ("tag", "parent", "children", "gone", "root", "chars", "tags", "link_chars", "link_tags", "link", "within", "doubt", "mild", "density", "total", "keep")

    def __init__(self, tag, parent, gone=False, root=False, doubt=False, mild=False):
        self.tag, self.parent, self.children, self.gone, self.root = tag, parent, [], gone, root
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.link = tag == "a" or (parent is not None and parent.link)
        self.within = root or (parent is not None and parent.within)
        self.doubt, self.mild = doubt, mild
        self.density = self.total = 0.0
        self.keep = False


def _names(value: str) -> set[str]:
    out = set()
    for one in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split():
        parts = [p for p in re.split(r"[_\-:/]+", one) if p]
        if parts and parts[0] not in LAYOUT:
            out.update(p.rstrip("0123456789") for p in parts)
    return out


def _is_gone(tag: str, attrs: str, within: bool) -> tuple[bool, bool, bool, bool]:
    """Whether an element is never part of the article, says that it holds the article, names itself as
    something else, and does so by the name of a section of an article only."""
    if tag in GONE and tag not in DOUBTED:
        return True, False, False, False
    root = tag in ROOTS
    doubt = tag in DOUBTED or tag == "header" and not within
    mild = False
    if attrs:
        a = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
            return True, False, False, False
        roles = set(a.get("role", "").lower().split())
        root = root or bool(roles & ROOTS) or "articlebody" in a.get("itemprop", "").lower()
        doubt = doubt or bool(roles & ROLES)
        if tag not in ("html", "body"):
            names = _names(a.get("class", "")) | _names(a.get("id", ""))
            # A root that is called a comment is one; other names on a root describe its page.
            found = names & ({"comment", "comments", "ad", "ads", "advert", "related", "reply"} if root else NAMES)
            mild = within and not doubt and bool(found) and found <= SECTIONS
            doubt = doubt or bool(found) or (not within and not root and bool(names & HEADER_NAMES))
    return False, root, doubt, mild


def _settle(top: _Node) -> None:
    """Takes doubted elements out, except those that hold the article or most of the page's text."""
    order, todo, free = [], [(top, True)], False
    while todo:
        n, sure = todo.pop()
        sure = sure and not n.doubt
        order.append((n, sure))
        todo.extend((c, sure) for c in n.children)
    if not any(n.doubt for n, _ in order):
        return
    total = sum(n.chars for n, _ in order)

    def weigh(decide):
        chars, links, held, main = {}, {}, {}, {}  # of what isn't doubted; held: the largest root
        found = False
        for n, sure in reversed(order):
            own = [c for c in n.children if not c.doubt]
            k = id(n)
            chars[k] = n.chars + sum(chars[id(c)] for c in own)
            links[k] = n.link_chars + sum(links[id(c)] for c in own)
            held[k] = max((held[id(c)] for c in own), default=0)
            main[k] = any(main[id(c)] for c in own)
            found = found or (sure and n.root and chars[k] > 0)
            if decide and n.doubt:
                if n.mild:
                    n.doubt = 2 * links[k] >= chars[k]
                elif not n.root:
                    n.doubt = not (main[k] or not free and (4 * held[k] >= total > 0 and held[k] > 0 or 2 * chars[k] > total))
            if n.root and not n.doubt and chars[k]:
                held[k], main[k] = max(held[k], chars[k]), main[k] or n.tag == "main"
        return found

    free = weigh(False)
    weigh(True)
    for n, _ in order:  # parents come before children
        n.gone = n.gone or n.doubt or (n.parent is not None and n.parent.gone)
        n.children = [c for c in n.children if not c.doubt]


class _Open:
    """The open elements, and where in the stack those of a name stand, so that no tag walks the stack."""

    def __init__(self, top: _Node):
        self.stack = [top]
        self.places: dict[str, list[int]] = {}
        self.solid: list[int] = []  # all but inline elements
        self.walls: list[int] = []  # and but paragraphs: a stray inline end doesn't close them

    def push(self, node: _Node) -> None:
        i = len(self.stack)
        self.stack.append(node)
        self.places.setdefault(node.tag, []).append(i)
        if node.tag not in INLINE:
            self.solid.append(i)
            if node.tag != "p":
                self.walls.append(i)

    def pop(self) -> _Node:
        node = self.stack.pop()
        self.places[node.tag].pop()
        if node.tag not in INLINE:
            self.solid.pop()
            if node.tag != "p":
                self.walls.pop()
        return node

    def last(self, tags) -> int:
        """Place of the innermost open element with one of these names, 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def first(self, tags, after: int) -> int:
        """Place of the outermost open element with one of these names inside the place `after`, 0 if there is none."""
        found = []
        for t in tags:
            own = self.places.get(t, ())
            k = bisect_right(own, after)
            found += own[k : k + 1]
        return min(found, default=0)


def _parse(page: str):
    """The tree and the text pieces in page order: (node, text) with None for a break between blocks."""
    top = _Node("html", None)
    opened = _Open(top)
    stack, pieces, at = opened.stack, [], 0

    def text(raw):
        node = stack[-1]
        if node.gone or not raw:
            return
        raw = html.unescape(raw) if "&" in raw else raw
        pieces.append((node, raw))
        n = sum(map(len, raw.split()))
        node.chars += n
        if node.link:
            node.link_chars += n

    def pop_to(i):
        while len(stack) > i:
            if opened.pop().tag not in INLINE:
                pieces.append((stack[-1], None))

    end = len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = _TOKEN.match(page, lt)
        if not m:  # a bare "<" is text
            nxt = page.find("<", lt + 1)
            text(page[at : nxt if nxt >= 0 else end])
            at = nxt if nxt >= 0 else end
            continue
        if lt > at:
            text(page[at:lt])
        at = m.end()
        if m[1] is not None:
            text(m[1])
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            i = opened.last((tag,))
            if i and not (tag in INLINE and opened.walls and opened.walls[-1] > i):
                pop_to(i)
            continue
        if tag in ENDS_P and opened.solid and stack[opened.solid[-1]].tag == "p":
            pop_to(opened.solid[-1])
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            pop_to(len(stack) - 1)
        if tag in CLOSES:
            i = opened.first(CLOSES[tag], opened.last(STOPS.get(tag, {"table"})))
            if i:
                pop_to(i)
        parent = stack[-1]
        if tag in ("html", "body"):
            if tag == "body":
                while len(stack) > 1:
                    opened.pop()
                parent = top
            else:
                continue
        gone, root, doubt, mild = (True, False, False, False) if parent.gone else _is_gone(tag, m[4], parent.within)
        node = _Node(tag, parent, gone, root, doubt, mild)
        if not gone:
            parent.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|</{tag}\Z", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                pieces.append((parent, None))
            continue
        if tag not in INLINE:
            pieces.append((node, None))
        if m[4].endswith("/") and tag not in INLINE and tag not in ENDS_P:
            continue
        opened.push(node)
    pop_to(1)
    _settle(top)
    return top, [x for x in pieces if x[1] is None or not x[0].gone]


def _weigh(top: _Node) -> list[_Node]:
    """Counts of each subtree, its density and density sum; the elements in page order."""
    order, todo = [], [top]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(reversed(n.children))
    for n in reversed(order):
        n.tags = sum(1 + c.tags for c in n.children)
        n.link_tags = sum((c.tag == "a") + c.link_tags for c in n.children)
        n.chars += sum(c.chars for c in n.children)
        n.link_chars += sum(c.link_chars for c in n.children)
    body_c, body_l = max(top.chars, 1), top.link_chars
    for n in order:
        c, t, lc, lt = n.chars, max(n.tags, 1), n.link_chars, n.link_tags
        if c:
            base = math.log(c / max(c - lc, 1) * lc + body_l / body_c * c + math.e)
            x = c / max(lc, 1) * t / max(lt, 1)
            n.density = c / t * (math.log(x) / math.log(base) if base > 1.0 + 1e-9 else math.log(x)) if x > 1.0 else 0.0
    for n in order:
        n.total = sum(c.density for c in n.children)
    return order


def extract(page: str | None) -> str:
    """The main text of a page: blocks in page order, one a line. Empty where there is none."""
    if not page:
        return ""
    top, pieces = _parse(page)
    order = _weigh(top)
    if not top.chars:
        return ""
    # Of equal sums the first in page order; a page of one bare element leads to itself.
    best = max(order, key=lambda n: (n.total, n.density if not n.children else 0.0))
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    root = next((n for n in reversed(path) if n.root), None)
    if root is not None:
        root.keep = True
    else:
        threshold = min(n.density for n in path if n.density > 0) if any(n.density > 0 for n in path) else 0.0
        best.keep = True
        for n in path[1:]:
            for c in n.children:
                if c.density >= threshold and c.density > 0 or c.tag in HEADINGS:
                    c.keep = True
        for n in path[1:]:
            n.keep = False
    for n in order:  # parents come before children
        if n.parent is not None and n.parent.keep:
            n.keep = True
    blocks, now = [], []
    inner = {id(n) for n in order if n.keep}
    for node, piece in pieces:
        if piece is None:
            if now:
                blocks.append(" ".join("".join(now).split()))
                now = []
        elif id(node) in inner:
            now.append(piece)
    if now:
        blocks.append(" ".join("".join(now).split()))
    return "\n".join(b for b in blocks if b)


def extract_pages(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """All rows and columns of `pages` except the html, plus `out_col`, the main text.

    Null and empty pages give an empty text; a column that is called like the result is replaced, others
    pass through, whatever their names; repeated rows are extracted each by itself; of equal density sums the
    first in page order wins; very long pages are read whole, in time in proportion to their length; an
    empty table gives an empty result.
    """
    ship(pages.sparkSession)
    rest = without(pages, html_col, out_col)
    rows = pages.select(packed(rest), F.col(quoted(html_col)).alias("html"))

    def scan(batches):
        for batch in bounded(batches, "html"):
            texts = pa.array([extract(x) for x in batch.column("html").to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), texts], ["row", "text"])

    kinds = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])
    out = rows.mapInArrow(scan, kinds)
    return out.select(*(F.col("row").getField(c).alias(c) for c in rest.columns), F.col("text").alias(out_col))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
