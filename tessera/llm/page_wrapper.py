"""Main text of web pages by wrapper induction: pages of a host are aligned by simple tree matching."""

from __future__ import annotations

import html as references
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# ---- fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header"
    " hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of the key ends open elements of the first list, up to the nearest one of the second.
_ENDS = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "thead": ("tbody thead tfoot tr td th", "table"), "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"),
    "option": ("option", "select"), "optgroup": ("option optgroup", "select"), "body": ("head", ""),
}
ENDS = {tag: (frozenset(close.split()), frozenset(fence.split())) for tag, (close, fence) in _ENDS.items()}
#: Elements that no open paragraph holds.
_NO_P = BLOCK - {"br", "caption", "legend", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "head", "html"}
_FENCE = frozenset("article aside body td th table caption button object section div main".split())
_P, _NONE = frozenset(("p",)), frozenset()

# ---- fixed values of the boilerplate that a page shows
NEVER = frozenset(
    "head nav footer aside form script style noscript iframe template svg canvas button select textarea option menu dialog object embed noembed noframes xmp plaintext"
    " title audio video map input label fieldset datalist math".split())
#: Words of class, id and role that name boilerplate.
CUES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices alert"
    " notification notifications popup modal overlay toast menu menus nav navbar navigation breadcrumb breadcrumbs sidebar rail widget widgets footer foot masthead topbar toolbar"
    " header comment comments commentlist disqus replies reply discussion respond share sharing social related recommended recommendations newsletter subscribe subscription signup"
    " login search searchform form pagination pager paging copyright legal skip hidden complementary contentinfo".split())
_OTHERS = frozenset("has with no without is".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_REGION = frozenset("html body div section main article center table tbody tr td fieldset details".split())

#: Pages of a host on which a text must be the same to be its template, and shapes that are merged in one group.
SAME_PAGES, TOGETHER = 3, 500
#: Nodes that a template holds at most; None, as every query has it, keeps every place.
NODES: int | None = None
#: Elements deeper than this stand beside their parents, as in browsers; labels of siblings beyond which their tags alone count.
DEPTH, LABELS = 120, 48
#: Shapes that a task holds before it hands them on.
HELD = 2000
#: Templates are broadcast up to so many bytes in all, else joined by shuffle.
BROADCAST_BYTES = 32_000_000
#: A child that holds this share of a region's running text is the region; a list whose text is linked by this share is a menu.
DOMINANT, LINKED = 0.6, 0.9

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*(?:>|\Z))|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_PART = re.compile(r"[A-Za-z][a-z]*")
_DIGITS = re.compile(r"[0-9]+")


class Node:
    """An element: its label and its content in order (an element, or a pair of text and whether it is linked); ``place`` numbers it in the page's shape."""

    __slots__ = ("content", "label", "place", "tag")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.content, self.place = tag, label, [], -1


def _label(tag: str, attributes: str) -> str:
    """The tag with its class, id and role words, numbers made one; it tells which elements may be aligned."""
    if not attributes or ("=" not in attributes and "hidden" not in attributes):
        return tag
    found = []
    for m in _NAMED.finditer(attributes):
        value, name = m[2] or m[3] or m[4] or "", m[1].lower()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            found.append("hidden")
        elif name != "aria-hidden":
            found += value.split()
    return " ".join([tag, *sorted({_DIGITS.sub("0", f) for f in found})])


class _Parser:
    """One sweep over a page's tags, lenient: unclosed and stray tags, comments, raw text, broken attributes, missing ends."""

    def __init__(self) -> None:
        self.root = Node("", "")
        self.stack, self.anchors = [self.root], 0

    def cut(self, k: int) -> None:
        """Close the open elements from the k-th on."""
        self.anchors -= sum(e.tag == "a" for e in self.stack[k:])
        del self.stack[k:]

    def close(self, tags: frozenset[str], fence: frozenset[str]) -> bool:
        """Close the nearest open element of ``tags`` that no element of ``fence`` hides."""
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k].tag
            if tag in tags:
                self.cut(k)
                return True
            if tag in fence:
                return False
        return False

    def start(self, tag: str, attributes: str) -> bool:
        """Open an element; true where raw text follows."""
        if tag in ENDS:
            while self.close(*ENDS[tag]) and len(ENDS[tag][0]) > 1:
                pass
        if tag in _NO_P:
            self.close(_P, _FENCE)
        if tag in ("html", "body") and any(e.tag == tag for e in self.stack):
            return False
        node = Node(tag, _label(tag, attributes))
        self.stack[-1].content.append(node)
        if tag in RAW:
            return True
        if tag not in VOID and len(self.stack) < DEPTH:
            self.stack.append(node)
            self.anchors += tag == "a"
        return False

    def read(self, text: str) -> Node:
        at, n = 0, len(text)
        while at < n:
            m = _TOKEN.search(text, at)
            piece = text[at : m.start()] if m else text[at:]
            if piece:
                self.stack[-1].content.append((references.unescape(piece) if "&" in piece else piece, self.anchors > 0))
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self.close(frozenset((tag,)), _NONE if tag in BLOCK else _FENCE)
            elif self.start(tag, m[3]):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(text, at)
                at = stop.end() if stop else n
        return self.root


def parse(text: str) -> Node:
    """The tree of a page; its root has no tag."""
    return _Parser().read(text)


# ---- shapes: [label, children, elements]. Of siblings with one label the first, the middle ones as one, and the last are kept.


def weight(a: list, b: list) -> int:
    """Nodes of the largest matching of two ordered trees (simple tree matching); 0 where the roots' labels differ."""
    if a[0] != b[0]:
        return 0
    return 1 + (_table(a[1], b[1])[-1][-1] if a[1] and b[1] else 0)


def _table(a: list, b: list) -> list[list[int]]:
    best = [[0] * (len(b) + 1)]
    for x in a:
        above, row = best[-1], [0]
        for j, y in enumerate(b):
            w = weight(x, y)
            row.append(max(above[j + 1], row[j], above[j] + w if w else 0))
        best.append(row)
    return best


def align(a: list, b: list) -> list[tuple]:
    """The children of both in one order; matched ones come together, others with None."""
    if len(a) == len(b) and all(x[0] == y[0] and not x[1] and not y[1] for x, y in zip(a, b, strict=True)):
        return list(zip(a, b, strict=True))
    best, i, j, out = _table(a, b), len(a), len(b), []
    while i or j:
        w = weight(a[i - 1], b[j - 1]) if i and j else 0
        if w and best[i][j] == best[i - 1][j - 1] + w:
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif j and best[i][j] == best[i][j - 1]:
            j -= 1
            out.append((None, b[j]))
        else:
            i -= 1
            out.append((a[i], None))
    return out[::-1]


def _joined(a: list, b: list) -> list:
    """One shape for the elements of both."""
    kids = [x if y is None else y if x is None else _joined(x, y) for x, y in align(a[1], b[1])] if a[1] or b[1] else []
    return [a[0], kids, a[2] + b[2]]


def _folded(node: Node) -> list:
    kids: dict[str, list[list]] = {}
    inner = [c for c in node.content if isinstance(c, Node) and c.tag != "br" and (c.content or c.tag not in VOID)]
    by_tag = len(inner) > LABELS and len({c.label for c in inner}) > LABELS
    for c in inner:
        one = _folded(c)
        if by_tag:
            one[0] = c.tag
        kids.setdefault(one[0], []).append(one)
    out = []
    for label, same in kids.items():
        out.append(same[0])
        if len(same) > 2:
            middle = same[1]
            for one in same[2:-1]:
                middle = _joined(middle, one)
            out.append([label + " +", *middle[1:]])
        if len(same) > 1:
            out.append(same[-1])
    return [node.label, out, [node]]


class Shaped:
    """A page with its shape as a string, its places numbered in order, and what its own texts measure at each place."""

    def __init__(self, page: str):
        self.root = parse(page)
        self.chars: list[int] = []
        self.linked: list[int] = []
        self.sums: list[int] = []
        self.shape = json.dumps(self._number(_folded(self.root)), ensure_ascii=False, separators=(",", ":"))

    def _number(self, shape: list) -> list:
        here, chars, linked, total = len(self.chars), 0, 0, 0
        for node in shape[2]:
            node.place = here
            if node.tag not in NEVER:
                for c in node.content:
                    if not isinstance(c, Node):
                        text = " ".join(c[0].split())
                        if text:
                            chars, linked = chars + len(text), linked + (len(text) if c[1] else 0)
                            total = crc32(text.encode("utf-8", "surrogatepass"), total)
        self.chars.append(chars)
        self.linked.append(linked)
        self.sums.append(total)
        return [shape[0], [self._number(kid) for kid in shape[1]]]


# ---- templates: [label, children, pages, chars, linked, sum]; ``sum`` is that of a text which never varied, else null


def _stated(shape: list, stats: Iterator) -> list:
    here = next(stats)
    return [shape[0], [_stated(kid, stats) for kid in shape[1]], *here]


def _merged(a: list, b: list) -> list:
    kids = [x if y is None else y if x is None else _merged(x, y) for x, y in align(a[1], b[1])]
    return [a[0], kids, a[2] + b[2], a[3] + b[3], a[4] + b[4], a[5] if a[5] == b[5] else None]


def _count(tree: list) -> int:
    return 1 + sum(map(_count, tree[1]))


def _without_rare(tree: list, floor: int) -> list:
    return [tree[0], [_without_rare(k, floor) for k in tree[1] if k[2] >= floor], *tree[2:]]


def merge_all(trees: list[list]) -> list:
    """One template of all trees, the most frequent first, so the order of the rows does not matter.

    It has every place of every tree. Only where NODES is set does a template
    beyond it lose the places that the fewest pages have.
    """
    whole = None
    for tree in sorted(trees, key=lambda t: (-t[2], json.dumps(t))):
        whole = tree if whole is None else _merged(whole, tree)
        floor = 1
        while NODES is not None and _count(whole) > NODES:
            floor *= 2
            whole = _without_rare(whole, floor)
    return whole


def _tag(label: str) -> str:
    return label.partition(" ")[0]


def _cued(label: str) -> bool:
    """Whether class, id or role name boilerplate; a name such as ``has-sidebar`` speaks of what is elsewhere."""
    for part in label.split(" ")[1:]:
        words = ["", *(w.lower() for w in _PART.findall(part))]
        if any(w in CUES and before not in _OTHERS for before, w in zip(words, words[1:], strict=False)):
            return True
    return False


def _is_article(label: str) -> bool:
    return _tag(label) == "article" or "articleBody" in label.split(" ")


def _is_main(label: str) -> bool:
    return _tag(label) == "main" or "main" in label.split(" ")[1:]


class Judge:
    """Marks the places of a template (a seventh field): true where the own text is content."""

    def __init__(self, tree: list):
        self.mass: dict[int, tuple[int, int]] = {}
        self.holds: set[int] = set()
        self._weigh(tree)
        self._find_holders(tree)
        self.total = self.mass[id(tree)][0]
        regions = self._regions(tree, _is_article) or self._regions(tree, _is_main) or [self._dominant(tree)]
        taken: set[int] = set()
        # where nothing varies (one page, or copies of one), the texts are content all the same
        if not sum(self._take(r, taken, True) for r in regions):
            for r in regions:
                self._take(r, taken, False)
        self._mark(tree, taken)

    def _weigh(self, node: list) -> tuple[int, int]:
        """Code points below a node that are not linked, and that are; boilerplate tags have none."""
        free, linked = node[3] - node[4], node[4]
        for kid in node[1]:
            more = self._weigh(kid)
            free, linked = free + more[0], linked + more[1]
        self.mass[id(node)] = (0, 0) if _tag(node[0]) in NEVER else (free, linked)
        return self.mass[id(node)]

    def _find_holders(self, node: list) -> bool:
        below = [self._find_holders(k) for k in node[1]]
        if any(below) or _is_main(node[0]) or (_is_article(node[0]) and not _cued(node[0])):
            self.holds.add(id(node))
        return id(node) in self.holds

    def _boilerplate(self, node: list) -> bool:
        tag = _tag(node[0])
        if tag in NEVER:
            return True
        if tag in ("", "html", "body") or id(node) in self.holds:
            return False
        # a wrapper may be named after what stands beside the text: by far the most text is no boilerplate
        return (tag == "header" or _cued(node[0])) and (bool(self.holds) or self.mass[id(node)][0] <= 0.5 * self.total)

    def _regions(self, node: list, wanted) -> list[list]:
        # an article may be a comment
        if self._boilerplate(node) or (_is_article(node[0]) and _cued(node[0])):
            return []
        return [node] if wanted(node[0]) else [r for kid in node[1] for r in self._regions(kid, wanted)]

    def _dominant(self, node: list) -> list:
        """The smallest block that holds most of the running text."""
        while True:
            blocks = [k for k in node[1] if not self._boilerplate(k)]
            mass = node[3] - node[4] + sum(self.mass[id(k)][0] for k in blocks)
            inner = [k for k in blocks if _tag(k[0]) in _REGION and mass and self.mass[id(k)][0] >= DOMINANT * mass]
            # a text's own heading stands beside it
            if not inner or any(_tag(k[0]) in _HEADINGS and k[5] is None for k in node[1]):
                return node
            node = inner[0]

    def _take(self, node: list, taken: set[int], slots_only: bool, region: bool = True) -> int:
        """Take the content below a node; gives its code points."""
        if not region and self._boilerplate(node):
            # the heading of an article stands in its header
            heads = [k for k in node[1] if _tag(node[0]) == "header" and _tag(k[0]) in _HEADINGS]
            return sum(self._take(k, taken, slots_only) for k in heads)
        free, linked = self.mass[id(node)]
        if not region and _tag(node[0]) in ("ul", "ol") and linked and linked >= LINKED * (free + linked):
            return 0
        chars = 0
        # a text that is the same on all pages is the template's
        if not (slots_only and node[5] is not None and node[2] >= SAME_PAGES):
            taken.add(id(node))
            chars = node[3]
        return chars + sum(self._take(kid, taken, slots_only, False) for kid in node[1])

    def _mark(self, node: list, taken: set[int]) -> None:
        node.append(id(node) in taken)
        for kid in node[1]:
            self._mark(kid, taken)


@lru_cache(maxsize=512)
def _judged(template: str) -> list:
    tree = json.loads(template)
    Judge(tree)
    return tree


def _in_places(shape: list, tree: list | None, out: list[bool], within: bool) -> None:
    """Content or not for each place of a page's shape; a place that the template does not know goes with the place around it."""
    content = tree[6] if tree else within and _tag(shape[0]) not in NEVER and _tag(shape[0]) != "header" and not _cued(shape[0])
    out.append(content)
    known = {id(x): y for x, y in align(shape[1], tree[1]) if x is not None} if tree else {}
    for kid in shape[1]:
        _in_places(kid, known.get(id(kid)), out, content)


@lru_cache(maxsize=8192)
def _content(template: str, shape: str) -> list[bool]:
    out: list[bool] = []
    _in_places(json.loads(shape), _judged(template), out, False)
    return out


def _text(root: Node, content: list[bool]) -> str:
    """The content's blocks in page order, joined by one space."""
    parts: list[str] = []

    def walk(node: Node) -> None:
        own = node.place >= 0 and content[node.place]
        for c in node.content:
            if not isinstance(c, Node):
                if own:
                    parts.append(c[0])
                continue
            if c.tag in BLOCK:
                parts.append(" ")
            if c.content and c.tag not in NEVER:
                walk(c)
                if c.tag in BLOCK:
                    parts.append(" ")

    walk(root)
    return " ".join("".join(parts).split())


def _row_template(shape: str, pages: int, chars: list[int], linked: list[int], sums: list[int | None]) -> list:
    return _stated(json.loads(shape), iter([(pages, c, k, s) for c, k, s in zip(chars, linked, sums, strict=True)]))


def main_text(page: str | None, template: str | None) -> str:
    """The main text of one page by its host's template (JSON). A page in which the template finds nothing is judged alone."""
    if not page:
        return ""
    shaped = Shaped(page)
    text = _text(shaped.root, _content(template, shaped.shape)) if template else ""
    if text:
        return text
    alone: list[bool] = []
    shape = json.loads(shaped.shape)
    tree = _row_template(shaped.shape, 1, shaped.chars, shaped.linked, shaped.sums)
    Judge(tree)
    _in_places(shape, tree, alone, False)
    return _text(shaped.root, alone)


# ---- in Spark

_SHAPES = pa.schema([
    ("host", pa.string()), ("shape", pa.string()), ("pages", pa.int64()),
    ("places", pa.list_(pa.struct([("chars", pa.int64()), ("linked", pa.int64()), ("sum", pa.int64()), ("varies", pa.bool_())]))),
])
_SHAPES_SQL = "host string, shape string, pages long, places array<struct<chars:bigint,linked:bigint,sum:bigint,varies:boolean>>"


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages, texts and check sums of every (host, shape) of a task, handed on in parts."""
    held: dict[tuple[str, str], list] = {}

    def rows() -> pa.RecordBatch:
        columns = [[], [], [], []]
        for (host, shape), (pages, chars, linked, sums, varies) in held.items():
            places = [dict(chars=c, linked=k, sum=s, varies=v) for c, k, s, v in zip(chars, linked, sums, varies, strict=True)]
            for column, value in zip(columns, (host, shape, pages, places), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SHAPES, strict=True)], schema=_SHAPES)

    for batch in batches:
        hosts, pages = batch.column("host"), batch.column("html")
        for k in range(batch.num_rows):
            page = pages[k].as_py()
            if not page:
                continue
            one = Shaped(page)
            key = (hosts[k].as_py(), one.shape)
            known = held.get(key)
            if known is None:
                held[key] = [1, one.chars, one.linked, one.sums, [False] * len(one.sums)]
                continue
            known[0] += 1
            known[1] = [a + b for a, b in zip(known[1], one.chars, strict=True)]
            known[2] = [a + b for a, b in zip(known[2], one.linked, strict=True)]
            known[4] = [v or a != b for v, a, b in zip(known[4], known[3], one.sums, strict=True)]
        if len(held) > HELD:
            yield rows()
            held.clear()
    if held:
        yield rows()


def _slice_template(rows: pd.DataFrame) -> pd.DataFrame:
    trees = [_row_template(r.shape, int(r.pages), r.chars.tolist(), r.linked.tolist(), [None if v else int(s) for v, s in zip(r.varies, r.sums, strict=True)])
             for r in rows.itertuples()]
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "template": [json.dumps(merge_all(trees), ensure_ascii=False, separators=(",", ":"))]})


def _host_template(rows: pd.DataFrame) -> pd.DataFrame:
    whole = merge_all([json.loads(t) for t in rows["template"]])
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "template": [json.dumps(whole, ensure_ascii=False, separators=(",", ":"))]})


def host_column(url: Column) -> Column:
    """The host of an address in lower case, without user and port; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template) of pages (host, html): the aligned trees of all pages of each host.

    Pages of one shape are summed first, in tasks and then by place, whatever
    their host; different shapes of a host are aligned in groups of about
    TOGETHER, and the groups' templates with each other. So a hot host costs
    one row for each of its shapes, never one for each of its pages.
    """
    places = pages.mapInArrow(_shapes, _SHAPES_SQL).select("host", "shape", "pages", F.posexplode("places").alias("place", "p"))
    summed = places.groupBy("host", "shape", "place").agg(
        F.sum("pages").alias("pages"), F.sum("p.chars").alias("chars"), F.sum("p.linked").alias("linked"), F.min("p.sum").alias("sum"),
        (F.bool_or("p.varies") | (F.min("p.sum") != F.max("p.sum"))).alias("varies"))
    field = lambda name: F.transform("at", lambda p: p[name]).alias(name)
    shapes = (
        summed.groupBy("host", "shape").agg(F.max("pages").alias("pages"), F.sort_array(F.collect_list(F.struct("place", "chars", "linked", F.col("sum").alias("sums"), "varies"))).alias("at"))
        .select("host", "shape", "pages", field("chars"), field("linked"), field("sums"), field("varies")))
    slices = summed.where("place = 0").groupBy("host").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("slices"))
    sliced = shapes.join(slices, "host").withColumn("slice", F.pmod(F.xxhash64("shape"), F.col("slices").cast("long")))
    partial = sliced.groupBy("host", "slice").applyInPandas(_slice_template, "host string, template string")
    return partial.groupBy("host").applyInPandas(_host_template, "host string, template string")


def text_column(page: Column, template: Column) -> Column:
    """The main text of every page by its host's template; a null template judges the page alone."""

    @F.arrow_udf("string")
    def extract(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, known in batches:
            yield pa.array([main_text(p.as_py(), t.as_py()) for p, t in zip(pages, known, strict=True)], pa.string())

    return extract(page, template)


def extract(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """The pages' columns and their main text, ``main_text``.

    Needs url and html; a column named ``main_text`` is replaced, others pass
    through. A null url has the empty host, whose pages are aligned with each
    other. A null or empty html, and a page without text, give the empty text.
    Repeated rows have equal results. A very long page is read whole, by one
    task. Where a host has one page, or copies of one, nothing can vary and
    all text of its region is content. An empty table gives no rows.
    """
    own = "__host" + "_" * max(map(len, pages.columns))
    known = "__template" + "_" * max(map(len, pages.columns))
    found = scratch.write(templates(pages.select(host_column(F.col("url")).alias("host"), "html")), "templates")
    found = found.withColumnsRenamed({"host": own, "template": known})
    size = found.agg(F.sum(F.octet_length(known) + F.octet_length(own) + 64)).first()[0] or 0
    keyed = pages.drop("main_text").withColumn(own, host_column(F.col("url")))
    met = keyed.join(F.broadcast(found) if size <= BROADCAST_BYTES else found.hint("shuffle_merge"), own, "left")
    return met.withColumn("main_text", text_column(F.col("html"), F.col(known))).drop(own, known)
