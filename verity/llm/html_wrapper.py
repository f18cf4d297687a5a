"""Main text of web pages by wrapper induction: pages of a host are aligned by simple tree matching."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verity.llm.common import cut

#: Distinct pages of a host that are aligned to find its content root, and distinct pages that a host
#: must have for its nodes to be template.
SAMPLE_PAGES, MIN_PAGES = 6, 4
#: Hosts up to which the wrappers are broadcast; beyond it they are joined by host.
BROADCAST_HOSTS = 20_000
#: Alignment looks no deeper, and pairs child lists of a larger product in order, once their equal
#: beginnings and ends are paired. It finds the content root; template nodes are counted at any depth.
ALIGNED_DEPTH, MAX_CELLS = 150, 10_000

#: What marks a place instead of a node, and the share of a host's pages from which it is repeated.
SLOT, SLOT_SHARE = "~", 10

# Fixed values of HTML: elements without an end tag, elements whose content is no markup, elements
# that begin a block, and what the start of an element closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("br option td th tr tbody thead tfoot caption body html".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody")}
SCOPE = frozenset("table ul ol dl select td th article section div body html main aside nav header footer form".split())

# Elements, roles, and words of class and id that are not the article; and words that
# say nothing about what they stand with.
AROUND = frozenset("head nav aside form footer script style noscript template iframe svg canvas button select textarea input object embed audio video dialog menu title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal newsletter subscribe signup sidebar menu navbar nav breadcrumb breadcrumbs footer comment comments disqus reply replies share sharing social related recommended pagination pager skip toolbar widget login masthead".split())
NEUTRAL = frozenset("area bar block body bottom box btn button buttons col container content desktop group head header holder icons inner item items left links list main mobile module outer overlay panel right row section site slot thread title top unit wrap wrapper".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+)|<", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
SPLIT = re.compile(r"[^a-z]+")
DIGITS = re.compile(r"\d+")


class Node:
    """An element. ``around``: its tag, role or attributes say that it is not the article; ``worded``: only
    its class or id does. Where it stands: by the labels above it (``path``), by these with their digits
    (``exact``), and by these and the place among siblings of one label (``place``)."""

    __slots__ = ("around", "children", "exact", "label", "path", "place", "tag", "worded")

    def __init__(self, tag: str, label: str, path: str, around: bool, worded: bool = False, exact: int = 0, place: int = 0):
        self.tag, self.label, self.path, self.around, self.worded, self.exact, self.place = tag, label, path, around, worded, exact, place
        self.children: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def text(self) -> str:
        return " ".join(" ".join(c for c in self.children if isinstance(c, str)).split())


@lru_cache(10_000)
def _names_surroundings(value: str) -> bool:
    """A class or id of which one name is made of listed words alone, and of words that say nothing:
    ``cookie-banner`` or ``comment-list``, but not ``share-price``."""
    names = ([w for w in SPLIT.split(name) if w] for name in value.split())
    return any(not WORDS.isdisjoint(own) and all(w in WORDS or w in NEUTRAL for w in own) for own in names)


def _element(tag: str, raw: str, parent: Node, inside: bool, before: dict[tuple[int, str], int]) -> Node:
    """``before`` counts the children of each element by label."""
    label, digits, around, worded = tag, tag, tag in AROUND or (tag == "header" and not inside), False
    for name, value in ATTR.findall(raw) if raw else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            label += f"[{name}={' '.join(sorted(DIGITS.sub('0', value).split()))}]"
            digits += f"[{name}={' '.join(sorted(value.split()))}]"
            worded |= tag not in ("body", "html", "main") and _names_surroundings(value) and (tag != "article" or "comment" in value or "reply" in value)
        elif name == "role":
            around |= value in ROLES
        elif name == "aria-hidden":
            around |= value == "true"
        elif name == "hidden":
            around = True
    above = int(parent.path.partition("/")[0], 16)
    code = lambda text, before: zlib.crc32(text.encode("utf-8", "surrogatepass"), before)
    same = before.get((id(parent), label), 0)
    before[id(parent), label] = same + 1
    return Node(tag, label, f"{code(label, above):08x}/{tag}", around, worded, code(digits, parent.exact), code(f"{label}#{same}", parent.place))


def parse(page: str) -> Node:
    """The element tree of a page; tags that lack an end are closed where HTML closes them."""
    root = Node("", "", "0", False)
    stack, before = [root], {}
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        if m[4] is not None:
            stack[-1].children.append(html.unescape(m[4]) if "&" in m[4] else m[4])
            continue
        if m[2] is None:
            if m[0] == "<":
                loose = LOOSE.match(page, m.start())
                if not loose:
                    if page[m.start() + 1 : m.start() + 2].isalpha() or page[m.start() + 1 : m.start() + 2] == "/":
                        break  # a tag that never ends
                    stack[-1].children.append("<")
                    continue
                m, at = loose, loose.end()
            else:
                continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES_P or tag in CLOSES:
            ends = CLOSES.get(tag, ("p",))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    del stack[k:]
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                elif stack[k].tag in SCOPE and stack[k].tag not in ends:
                    break
        inside = any(x.tag in ("article", "main") for x in stack) if tag == "header" else False
        node = _element(tag, m[3], stack[-1], inside, before)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            stop = end.start() if end else n
            if tag == "title":
                node.children.append(html.unescape(page[at:stop]))
            at = page.find(">", stop) + 1 if end else n
            if not at:
                break
        elif tag not in VOID and not (m[3].endswith("/") and tag not in BLOCK):
            stack.append(node)
    return root


# ---------------------------------------------------------------- alignment


def _pairs(a: list[Node], b: list[Node], score) -> list[tuple[Node, Node]]:
    """The best pairing of two child lists that keeps their order. Of long lists, equal beginnings and
    ends are paired first; what is then left of lists that are still too long is paired in order."""
    if len(a) * len(b) > MAX_CELLS:
        equal = lambda x, y: x.label == y.label and x.text() == y.text()
        least = min(len(a), len(b))
        head = next((k for k in range(least) if not equal(a[k], b[k])), least)
        tail = next((k for k in range(least - head) if not equal(a[-1 - k], b[-1 - k])), least - head)
        inner = a[head : len(a) - tail], b[head : len(b) - tail]
        if len(inner[0]) * len(inner[1]) > MAX_CELLS:
            middle = [(x, y) for x, y in zip(*inner, strict=False) if x.label == y.label]
        else:
            middle = _pairs(*inner, score)
        return [*zip(a[:head], b[:head], strict=True), *middle, *zip(a[len(a) - tail :], b[len(b) - tail :], strict=True)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + score(x, y))
    out, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
    return out[::-1]


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Node pairs of the greatest simple tree matching, down to ALIGNED_DEPTH; roots and labels must
    agree. A pair counts one, and a little more if the texts agree, so that equal nodes find each other."""
    known: dict[tuple[int, int], float] = {}

    def scored(depth: int):
        def score(x: Node, y: Node) -> float:
            if x.label != y.label:
                return 0
            key = (id(x), id(y))
            if key not in known:
                own, below = 1.25 if x.text() == y.text() else 1.0, scored(depth + 1)
                known[key] = own + (sum(below(p, q) for p, q in _pairs(x.elements(), y.elements(), below)) if depth < ALIGNED_DEPTH else 0)
            return known[key]

        return score

    out, todo = [], [(a, b, 0)]
    while todo:
        x, y, depth = todo.pop()
        out.append((x, y))
        if depth < ALIGNED_DEPTH:
            todo.extend((p, q, depth + 1) for p, q in _pairs(x.elements(), y.elements(), scored(depth + 1)))
    return out


def mark(node_path: str, text: str) -> str:
    return f"{zlib.crc32(text.encode('utf-8', 'surrogatepass')):08x}{len(text)}{node_path}"


def _walk(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(reversed(node.elements()))


def induce(pages: list[str]) -> tuple[str, list[str]]:
    """(content root or '', marks of template nodes) of a host's distinct pages.

    A node is template if it is matched with the same text in every other page and the pages are
    MIN_PAGES at least. The root is the deepest element that holds most of the varying text; where
    that is within an ``article`` or ``main``, it is the outermost ``article`` around it, else the ``main``.
    """
    trees = [parse(p) for p in pages]
    first, rest = trees[0], trees[1:]
    same: Counter[int] = Counter()
    for other in rest:
        for x, y in align(first, other):
            same[id(x)] += bool(x.text()) and x.text() == y.text()
    constant = {id(x) for x in _walk(first) if len(pages) >= MIN_PAGES and same[id(x)] == len(rest)}
    marks = sorted({mark(x.path, x.text()) for x in _walk(first) if id(x) in constant})
    weight: dict[int, int] = {}
    for node in reversed(list(_walk(first))):  # children come before their parents
        own = 0 if id(node) in constant else len(node.text())
        weight[id(node)] = 0 if node.around or node.worded else own + sum(weight[id(c)] for c in node.elements())
    node, way = first, []
    while True:
        inner = [c for c in node.elements() if c.tag in ("html", "body", "main", "article", "section", "div", "td", "table", "tbody", "tr", "center")]
        heavy = max(inner, key=lambda c: weight[id(c)], default=None)
        if heavy is None or not weight[id(heavy)] or weight[id(heavy)] < 0.7 * weight[id(node)]:
            break
        node = heavy
        way.append(node)
    told = [x for x in way if x.tag == "article"] or [x for x in way if x.tag == "main"] or way[-1:]
    return (_named(told[0], trees) if told else ""), marks


def _named(root: Node, trees: list[Node]) -> str:
    """How the root is found again: by its path, if no page has that twice (or it is an article or main);
    else by the path with the digits of its names, if every page has that once; else by its place among
    siblings of one label, if every page has that; else by its path."""
    nodes = [list(_walk(tree)) for tree in trees]
    times = lambda test: [sum(map(test, own)) for own in nodes]
    if root.tag in ("article", "main") or max(times(lambda x: x.path == root.path)) <= 1:
        return root.path
    if set(times(lambda x: x.exact == root.exact)) == {1}:
        return f"exact {root.exact}"
    return f"place {root.place}" if set(times(lambda x: x.place == root.place)) == {1} else root.path


# ---------------------------------------------------------------- extraction


def _blocks(root: Node, template: frozenset[str], within: bool) -> list[str]:
    """The blocks of an element in page order, without template nodes and what stands around. ``within``
    the article a class or id says so only of a place that the host repeats."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line:
            out.append(" ".join("".join(line).split()))
            line.clear()

    todo: list[tuple[Node, Iterator[Node | str]]] = [(root, iter(root.children))]
    while todo:
        node, rest = todo[-1]
        child = next(rest, None)
        if child is None:
            todo.pop()
            if node.tag in BLOCK:
                end()
        elif isinstance(child, str):
            line.append(child)
        elif not child.around and not (child.worded and (not within or SLOT + child.path in template)):
            block = child.tag in BLOCK
            if block:
                end()
            if not (template and child.text() and (block or not node.text()) and mark(child.path, child.text()) in template):
                todo.append((child, iter(child.children)))
    end()
    return [x for x in out if x]


def main_text(page: str | None, root_path: str = "", template: frozenset[str] = frozenset()) -> str:
    """The blocks of the elements at the place of the wrapper's content root; on a page without such, of
    its article (or else main) elements; without such, of the whole page; always without template nodes
    and what stands around."""
    if not page:
        return ""
    tree = parse(page)

    def tops(test) -> list[Node]:
        found, todo = [], [tree]
        while todo:
            node = todo.pop()
            if node is not tree and (node.around or node.worded):
                continue
            if test(node):
                found.append(node)
            else:
                todo.extend(reversed(node.elements()))
        return found

    how, _, value = root_path.rpartition(" ")
    at = {"exact": lambda x: x.exact == int(value), "place": lambda x: x.place == int(value)}.get(how, lambda x: x.path == root_path)
    roots = (tops(at) if root_path else []) or tops(lambda x: x.tag == "article") or tops(lambda x: x.tag == "main")
    return "\n".join(block for root in roots or [tree] for block in _blocks(root, template, bool(roots)))


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def marks_of(page: str) -> set[str]:
    """Marks of the nodes with a text (a word within a sentence is part of it and no node of its own), and
    of the places whose class or id says that they are not the article."""
    nodes = [(x, y) for x in _walk(parse(page)) for y in x.elements()]
    return {mark(y.path, y.text()) for x, y in nodes if y.text() and (y.tag in BLOCK or not x.text())} | {SLOT + y.path for _, y in nodes if y.worded}


def template_marks(keyed: DataFrame) -> DataFrame:
    """(host, template): the nodes, by path and text, of most of the distinct pages of a host, and the
    places named as surroundings of one in SLOT_SHARE, counted over all pages (host, page, h). Spark
    merges before it shuffles."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [sorted(marks_of(p)) for p in part.column(2).to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array([m for x in found for m in x], pa.string())], names=["host", "h", "mark"])

    sizes = keyed.groupBy("host", "h").agg(F.lit(1)).groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= MIN_PAGES)
    nodes = keyed.select("host", "h", "page").mapInArrow(over, "host string, h long, mark string")
    counted = cut(nodes.distinct().groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * 2 > MIN_PAGES), "html-marks")
    most = counted.join(sizes, "host").where((F.col("n") * 2 > F.col("pages")) | (F.col("mark").startswith(SLOT) & (F.col("n") * SLOT_SHARE >= F.col("pages"))))
    return most.groupBy("host").agg(F.sort_array(F.collect_list("mark")).alias("template"))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, root, template), one row per host: the template nodes from all pages, the content root
    from the SAMPLE_PAGES distinct pages of least hash. Each task sends the least hashes that it has of
    a host, so a host with most of the pages sends a few rows per task."""
    keyed = pages.select(F.coalesce(F.lower(F.regexp_extract(url_col, HOST, 1)), F.lit("")).alias("host"), F.col(html_col).alias("page")).where("page is not null and page <> ''")
    hashed = keyed.withColumn("h", F.xxhash64("page"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pd.DataFrame({"host": batch.column(0).to_pylist(), "h": batch.column(1).to_pylist()}).drop_duplicates().sort_values("h").groupby("host").head(SAMPLE_PAGES)
            yield pa.RecordBatch.from_arrays([pa.array(own["host"], pa.string()), pa.array(own["h"], pa.int64())], names=["host", "h"])

    place = F.row_number().over(Window.partitionBy("host").orderBy("h"))
    chosen = hashed.select("host", "h").mapInArrow(least, "host string, h long").distinct().withColumn("place", place).where(F.col("place") <= SAMPLE_PAGES)
    chosen = cut(chosen, "html-chosen")
    side = F.broadcast(chosen) if chosen.count() <= SAMPLE_PAGES * BROADCAST_HOSTS else chosen
    some = hashed.join(side, ["host", "h"]).groupBy("host", "place").agg(F.min("page").alias("page"))

    def per_host(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "root": [induce(rows.sort_values("place")["page"].tolist())[0]]})

    roots = some.groupBy("host").applyInPandas(per_host, "host string, root string")
    return roots.join(template_marks(hashed), "host", "left")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: the id, ``url``, ``text`` and ``n_chars`` (code points).

    Null or empty html gives an empty text. Pages with a null or odd url share the host ''. Hosts of
    fewer than MIN_PAGES distinct pages have no template nodes. Pages that break off are read as far
    as they go. Other columns are not looked at; repeated rows repeat; an empty table gives an empty
    result.
    """
    found = cut(wrappers(pages, url_col, html_col), "html-wrappers")
    side = F.broadcast(found) if found.count() <= BROADCAST_HOSTS else found
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.coalesce(F.lower(F.regexp_extract(url_col, HOST, 1)), F.lit("")).alias("host"))
    joined = rows.join(side, "host", "left").select("page_id", "url", "html", "root", "template")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple, frozenset[str]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = []
                for page, root, template in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    key = tuple(template or ())
                    if key not in sets:
                        if len(sets) > 10_000:
                            sets.clear()
                        sets[key] = frozenset(key)
                    texts.append(main_text(page, root or "", sets[key]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    out = joined.mapInArrow(over, f"page_id {kind}, url string, text string, n_chars long")
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
