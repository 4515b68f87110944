"""Main text of web pages by wrapper induction.

Pages of one host share a wrapper. The first page of each layout (the set of its upper elements) is a reference; other pages
are aligned with the reference of their layout by simple tree matching, and the first ones of a layout with that of another.
Nodes of references that keep their text from page to page are template, nodes whose text varies are slots for content. A
node is known by the kinds on its path and its text, so what several references tell about it is added up over the host, and
each page of the host loses its template nodes, inside an article that markup names as well as outside.

A host with many pages is cut into parts by a hash of its pages, so that a host with a third of all pages is no single task;
each part has references of its own.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlake import session

SALTS = 32
#: Hosts are cut into parts of at least so many pages, and into so many parts altogether at most (beside one for each host).
PART, PARTS = 64, 2048
#: A node of the references is template if this share of at least so many aligned pages has the same text there.
SAME, LEAST_PAGES = 0.8, 3
#: Pages that share this much of a named article are copies of one article, which say nothing about template inside it.
COPY = 0.5
#: Parsed references that a task holds; after that it begins anew. Levels of elements that make up a layout.
HELD, LEVELS = 64, 4

BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template svg math object xmp noembed noframes".split())
#: Elements that are never main text, and words of class, id and role that say the same.
DROP_TAGS = set("nav header footer aside form head menu dialog select button option search".split())
DROP_WORDS = set(
    "ad ads advert adverts advertisement advertising adslot sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar aside cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe signup login share sharing social related recommended comment comments disqus reply replies form search "
    "complementary contentinfo dialog alert".split()
)
MAIN_WORDS = set("articlebody post-content entry-content article-body article-content main-content".split())
#: A start tag closes these open elements first, up to the element named last.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


class Node:
    """An element that makes blocks: its kind, whether markup drops or names it, and its texts and elements in order."""

    __slots__ = ("items", "kind", "drop", "main")

    def __init__(self, kind: str, drop: bool = False, main: bool = False) -> None:
        self.kind, self.drop, self.main = kind, drop, main
        self.items: list[str | Node] = []

    @property
    def children(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]

    def text(self) -> str:
        """Its own text, without that of its elements."""
        return _SPACE.sub(" ", " ".join(x for x in self.items if isinstance(x, str))).strip()


def _named(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """Kind of an element, whether its markup says that it is no main text, or that it is."""
    drop, main, shown = tag in DROP_TAGS, tag in ("article", "main"), ""
    if "=" in attrs:
        for name, value in _ATTR.findall(attrs):
            value = value.strip("\"'").lower()
            words = set(_SPLIT.split(value))
            if name.lower() in ("class", "id", "role"):
                drop = drop or bool(words & DROP_WORDS)
                main = main or bool(MAIN_WORDS & set(value.split())) or (name.lower() == "role" and value in ("main", "article"))
                shown += f" {value}" if name.lower() != "id" else ""
            elif name.lower() == "itemprop":
                main = main or "articlebody" in words
            elif name.lower() == "aria-hidden":
                drop = drop or value == "true"
    return tag + shown, drop and tag not in ("html", "body", "article", "main"), main


def parse(page: str) -> Node:
    """Tree of the elements that make blocks; inline markup is dissolved, references are decoded, unclosed tags are closed."""
    root = Node("#")
    stack: list[tuple[str, Node]] = [("#", root)]
    at, end = 0, len(page)
    while at < end:
        tag = _TAG.search(page, at)
        upto = tag.start() if tag else end
        if upto > at:
            stack[-1][1].items.append(entities.unescape(page[at:upto]))
        if not tag:
            break
        at = tag.end()
        closing, name, attrs = tag.group(1), (tag.group(2) or "").lower(), tag.group(3) or ""
        if not name:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name == "br":
            stack[-1][1].items.append(" ")
            continue
        if name in BLOCKS:
            if name != "body":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCKS:
                        break
            if name in CLOSES:
                closes, within = CLOSES[name]
                cut = None
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in within:
                        break
                    if stack[k][0] in closes:
                        cut = k
                if cut:
                    del stack[cut:]
        kind, drop, main = _named(name, attrs)
        if name in VOID and name != "hr":
            continue
        if name in BLOCKS or drop:
            node = Node(kind, drop, main)
            stack[-1][1].items.append(node)
            if name not in VOID:
                stack.append((name, node))
        elif not attrs.rstrip().endswith("/"):
            stack.append((name, stack[-1][1]))
    return root


class Page:
    """A tree with its layout and, for each node with a text that markup does not drop, (key, text, whether in a named article)."""

    def __init__(self, page: str) -> None:
        self.root = parse(page)
        self.nodes: dict[int, tuple[int, str, bool]] = {}
        paths: set[str] = set()
        todo = [(self.root, "", 0, False)]
        while todo:
            node, path, level, inside = todo.pop()
            if level <= LEVELS:
                paths.add(path)
            if node.drop:
                continue
            inside = inside or node.main
            if text := node.text():
                key = xxhash.xxh3_64_intdigest(f"{path}\0{text}".encode("utf-8", "surrogatepass")) - (1 << 63)
                self.nodes[id(node)] = key, text, inside
            todo.extend((x, f"{path}>{x.kind}", level + 1, inside) for x in node.children)
        self.layout = frozenset(paths)
        self.article = sum(len(text) for _, text, inside in self.nodes.values() if inside)


def _kinds(root: Node, numbers: dict[tuple, int]) -> dict[int, int]:
    """A number for each node (by its id) that equals another node's if both subtrees have the same kinds."""
    out: dict[int, int] = {}
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, done = todo.pop()
        if done:
            shape = (node.kind, *(out[id(x)] for x in node.children))
            out[id(node)] = numbers.setdefault(shape, len(numbers))
        else:
            todo.append((node, True))
            todo.extend((x, False) for x in node.children)
    return out


class _Sizes:
    """The size of the largest match of two subtrees, once for each pair of shapes (a kind and its children's shapes)."""

    def __init__(self, numbers: dict[tuple, int]) -> None:
        self.shapes = list(numbers)
        self.known: dict[tuple[int, int], int] = {}
        self.count: list[int] = []
        for shape in self.shapes:
            self.count.append(1 + sum(self.count[c] for c in shape[1:]))

    def of(self, x: int, y: int) -> int:
        todo = [(x, y)]
        while todo:
            p, q = todo[-1]
            if (p, q) in self.known:
                todo.pop()
                continue
            a, b = self.shapes[p], self.shapes[q]
            if a[0] != b[0]:
                self.known[p, q] = 0
            elif p == q:
                self.known[p, q] = self.count[p]
            else:
                start, end_a, end_b = trimmed(a[1:], b[1:])
                xs, ys = a[1 + start : 1 + end_a], b[1 + start : 1 + end_b]
                open_ = [(i, j) for i in set(xs) for j in set(ys) if (i, j) not in self.known]
                if open_:
                    todo.extend(open_)
                    continue
                same = sum(self.count[c] for c in (*a[1 : 1 + start], *a[1 + end_a :]))
                self.known[p, q] = 1 + same + int(self.row(xs, ys)[-1])
            todo.pop()
        return self.known[x, y]

    def row(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> np.ndarray:
        """The last row of the table of matches of two lists; two rows are held."""
        row = np.zeros(len(ys) + 1, np.int64)
        weights: dict[int, np.ndarray] = {}
        for x in xs:
            if x not in weights:
                weights[x] = np.array([self.known[x, y] for y in ys], np.int64)
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights[x]))
        return row

    def pairs(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of a largest match of two lists, by halves: memory in proportion to one list."""
        for i in set(xs):
            for j in set(ys):
                self.of(i, j)
        out, todo = [], [(0, len(xs), 0, len(ys))]
        while todo:
            a0, a1, b0, b1 = todo.pop()
            start, end_a, end_b = trimmed(xs[a0:a1], ys[b0:b1])
            out += [(a0 + k, b0 + k) for k in range(start)] + [(a0 + end_a + k, b0 + end_b + k) for k in range(a1 - a0 - end_a)]
            a0, a1, b0, b1 = a0 + start, a0 + end_a, b0 + start, b0 + end_b
            if a1 <= a0 or b1 <= b0:
                continue
            if a1 - a0 == 1:
                best = max(range(b0, b1), key=lambda j, a0=a0: self.known[xs[a0], ys[j]])
                if self.known[xs[a0], ys[best]]:
                    out.append((a0, best))
                continue
            middle = (a0 + a1) // 2
            ahead = self.row(xs[a0:middle], ys[b0:b1])
            back = self.row(xs[middle:a1][::-1], ys[b0:b1][::-1])[::-1]
            cut = b0 + int((ahead + back).argmax())
            todo += [(a0, middle, b0, cut), (middle, a1, cut, b1)]
        return out


def trimmed(xs: tuple[int, ...], ys: tuple[int, ...]) -> tuple[int, int, int]:
    """How far two lists are the same from the front, and where each stops before what is the same at the end. Same subtrees
    at the ends are part of some largest match, as neither can be matched better."""
    least = min(len(xs), len(ys))
    start = 0
    while start < least and xs[start] == ys[start]:
        start += 1
    back = 0
    while back < least - start and xs[-1 - back] == ys[-1 - back]:
        back += 1
    return start, len(xs) - back, len(ys) - back


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: the largest set of pairs of equal kinds that keeps parents and the order of children.

    Pages may be thousands of elements deep or wide: nothing is recursive, and sizes are kept by shape, not by node.
    """
    numbers: dict[tuple, int] = {}
    left, right = _kinds(a, numbers), _kinds(b, numbers)
    sizes = _Sizes(numbers)
    pairs, todo = [], [(a, b)] if a.kind == b.kind else []
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        xs, ys = x.children, y.children
        # Children that agree from the front, and are the same to the end, need no table.
        if len(xs) == len(ys) and all(p.kind == q.kind for p, q in zip(xs, ys)):
            todo.extend(zip(xs, ys))
        elif xs and ys:
            met = sizes.pairs(tuple(left[id(c)] for c in xs), tuple(right[id(c)] for c in ys))
            todo.extend((xs[i], ys[j]) for i, j in met)
    return pairs


def main_text(root: Node, template: set[int]) -> str:
    """Blocks of the article, or else of the whole page, that are not template (ids of nodes), in page order.

    An article of template nodes alone is one that the host repeats; it stays.
    """

    def blocks(inside: bool, known: set[int]) -> list[str]:
        out: list[str] = []
        # Each open element with its place among its items, whether its text counts, and the run of text so far.
        todo: list[tuple[Node, int, bool, list[str]]] = [(root, 0, inside, [])] if not root.drop else []
        while todo:
            node, at, inside, run = todo.pop()
            inside = inside or node.main
            keep = inside and id(node) not in known
            while at < len(node.items) and isinstance(node.items[at], str):
                run.append(node.items[at])
                at += 1
            text = _SPACE.sub(" ", "".join(run)).strip()
            if text and keep:
                out.append(text)
            if at < len(node.items):
                todo.append((node, at + 1, inside, []))
                if not node.items[at].drop:
                    todo.append((node.items[at], 0, inside, []))
        return out

    named, seen = False, [root]
    while seen and not named:
        node = seen.pop()
        if not node.drop:
            named = node.main
            seen.extend(node.children)
    out = blocks(not named, template)
    if named and template and not out:
        out = blocks(False, set())
    return "\n".join(out)


def host(url: Column) -> Column:
    """Host of an address without user and port, in lower case; empty for null and for what is no address."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def _parts(pages: DataFrame) -> DataFrame:
    """Pages with the part of their host; only hosts with more than a part, ``PARTS`` at most, are in the joined table."""
    sizes = session.materialize(pages.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "hosts")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = sizes.filter(F.col("n") > max(PART, total / PARTS)).select("host", F.ceil(F.col("n") / max(PART, total / PARTS)).alias("parts"))
    known = pages.join(F.broadcast(large), "host", "left")
    return known.withColumn("part", F.pmod(F.xxhash64("html"), F.coalesce("parts", F.lit(1)))).drop("parts")


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, node, met, same) from pages in the order of their hosts and parts."""
    references: dict[frozenset, Page] = {}
    now, last = None, None
    for batch in batches:
        met: Counter = Counter()
        same: Counter = Counter()
        for name, part, html in zip(batch["host"], batch["part"], batch["html"]):
            if now != (name, part) or len(references) >= HELD:
                references, now, last = {}, (name, part), None
            # A page is no evidence about itself, and its copies come next to it.
            if html == last:
                continue
            last = html
            page = Page(html)
            if not page.nodes:
                continue
            ref = references.get(page.layout) or next(iter(references.values()), None)
            references.setdefault(page.layout, page)
            if ref is None:
                continue
            aligned = align(ref.root, page.root)
            pairs = [(ref.nodes[id(x)], page.nodes.get(id(y))) for x, y in aligned if id(x) in ref.nodes]
            alike = sum(len(x[1]) for x, y in pairs if x[2] and y and x[1] == y[1])
            copy = alike > COPY * max(ref.article, page.article)
            if ref.layout == page.layout:
                # A node that pages of the same layout may lack is content; another layout need not have it.
                found = {id(x) for x, _ in aligned}
                pairs += [(node, None) for x, node in ref.nodes.items() if x not in found]
            for (key, text, inside), y in pairs:
                if not (copy and inside):
                    met[name, key] += 1
                    same[name, key] += y is not None and text == y[1]
        yield pd.DataFrame([(h, k, n, same[h, k]) for (h, k), n in met.items()], columns=["host", "node", "met", "same"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, template): the keys of the template nodes of each host that has any."""
    full = _parts(pages.filter("html is not null and html <> ''").select("host", "html"))
    runs = full.repartition("host", "part").sortWithinPartitions("host", "part", F.xxhash64("html"), "html")
    counts = runs.mapInPandas(_compare, "host string, node long, met long, same long")
    counts = counts.groupBy("host", "node").agg(F.sum("met").alias("met"), F.sum("same").alias("same"))
    constant = counts.filter((F.col("met") >= LEAST_PAGES) & (F.col("same") >= SAME * F.col("met")))
    return session.materialize(constant.groupBy("host").agg(F.collect_list("node").alias("template")), "wrappers")


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = []
        for html, template in zip(batch["html"], batch["template"]):
            if not html:
                texts.append("")
                continue
            page = Page(html)
            places = set() if template is None else set(template)
            texts.append(main_text(page.root, {n for n, (key, _, _) in page.nodes.items() if key in places}))
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts})


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text), a row for each row of ``pages`` (page_id, url, html).

    Null and empty pages, and pages without an article or a varying node, have the text ''. Pages without a url share the
    empty host. A node is template from ``LEAST_PAGES`` comparisons on: hosts with fewer than four different pages have no
    template, so markup alone decides there. Repeated rows are rows like others; an empty table gives an empty table. Other
    columns are not read.
    """
    salt = F.pmod(F.xxhash64(F.col("page_id"), F.length("html")), F.lit(SALTS)).cast("int")
    keyed = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"), salt.alias("salt"))
    # A hot host is spread over the salts; its template is a list of numbers.
    known = wrappers(keyed).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    kind = pages.schema["page_id"].dataType.simpleString()
    joined = keyed.join(known, ["host", "salt"], "left").select("page_id", "url", "html", "template")
    return joined.mapInPandas(_extract, f"page_id {kind}, url string, text string")
