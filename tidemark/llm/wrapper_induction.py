"""Main text of web pages by wrapper induction over the pages of a host.

Each page becomes a tree of its block elements, in which runs of siblings of one shape are folded.
The trees of a host are aligned by simple tree matching (labels must agree, children align in order
by dynamic programming) and merged into one template. For every node the template keeps how many
pages have it, how much text, and whether that text is the same on all of them. Constant nodes are
the host's furniture; varying slots are content. The main slot is found by walking down from the
root to where the varying text is, past nodes whose element or class names a menu, header, footer,
sidebar, notice, advert, form or comment section.

Pages of a host whose text outside furniture is the same count once: their outlines (labels, CRCs and
lengths, no text) are shuffled by host and a digest of that text. Partitions of these build partial
templates first; they merge per host in two levels, so a hot host is no large group. A template is as large as a host's layout, not its
pages. Templates go back to the pages by a broadcast when all of them together are under
`broadcast_bytes`, else by a shuffled join, whose skew Spark splits.

Edge cases: null or empty html gives empty text; pages without a host share one template; a host's
only page, or under five different ones, have too little to compare with, so only the names of elements
count; markup cut off at
the end is read as far as it goes; elements nested deeper than 200 count as part of the 200th; child
lists whose alignment table would pass a million cells are aligned by the same table, block by block. A host may have several layouts, each with its
main slot; a page with text in none of the slots keeps all blocks outside the furniture.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import math
import re
import zlib
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, written
from .workers import lean, lean_group

TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "xmp", "select", "option", "button"}
VOID = {"area", "base", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "output", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
FURNITURE_TAGS = {"nav", "footer", "aside", "form", "head", "menu", "dialog"}
FURNITURE = re.compile(r"(?:^|[-_ .#])(nav|navbar|navigation|menu|footer|sidebar|side|ad|ads|advert|adverts|advertisement|banner|promo|sponsor|sponsored|cookie|cookies|notice|consent|popup|modal|share|sharing|social|comment|comments|disqus|replies|related|recommended|breadcrumb|breadcrumbs|newsletter|subscribe|signup|login|search|toolbar|widget|pagination|skip)s?(?:$|[-_ .#])", re.I)
MAIN_TAGS = ("article", "main")
PROSE = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre")
DEEPEST = 200


def parse(page: str) -> list:
    """The page's tree; a node is [label, children, texts]; text runs are children labelled '#'."""
    root = ["html", [], None]
    stack, run, at, skip, n = [root], [], 0, None, len(page)

    def flush() -> None:
        if run:
            text = " ".join(html_lib.unescape("".join(run)).split())
            run.clear()
            if text:
                stack[-1][1].append(["#", [], [text]])

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            run.append(page[at:])
            break
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if tag == "br":
            run.append(" ")
        elif tag in INLINE:
            if not m.group(1) and m.group(3) and FURNITURE.search(_names(m.group(3))):
                at = _past(page, at, tag)
        elif m.group(1):
            if tag in ("html", "body"):
                continue
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][3] == tag:
                    del stack[i:]
                    break
        elif tag in RAW:
            flush()
            skip = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at) if not m.group(3).endswith("/") else None
            if not m.group(3).endswith("/"):
                at = skip.end() if skip else n
        elif tag in VOID:
            flush()
        elif tag not in ("html", "body"):
            flush()
            shut = CLOSES.get(tag)
            while len(stack) > 1 and (stack[-1][3] == "p" or shut and stack[-1][3] in shut):
                stack.pop()
            if len(stack) < DEEPEST:
                names = _names(m.group(3)) if m.group(3) else ""
                node = [tag + names, [], None, tag]
                stack[-1][1].append(node)
                stack.append(node)
    flush()
    return root


def _names(attributes: str) -> str:
    """Classes, role and id, without what may differ by page: numbered names, and ids of several words."""
    out = ""
    for k, a, b, c in NAMED.findall(attributes):
        is_id = k.lower() == "id"
        kept = [re.sub(r"\d+", "0", x) for x in (a or b or c).split() if FURNITURE.search(x) or (x.isalpha() if is_id else not re.search(r"\d", x))]
        if kept:
            out += (" #" if is_id else " .") + "-".join(kept)
    return out


def _past(page: str, at: int, tag: str) -> int:
    """The place after the end tag that belongs to a start tag before `at`; elements of that name in between are counted."""
    open_ = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        open_ += -1 if m.group(1) else 1
        if not open_:
            return m.end()
    return at


def fold(node: list) -> tuple:
    """(label, children, texts) with runs of equal shapes folded; texts are listed in page order."""
    kids: list = []
    for c in node[1]:
        f = (c[0], (), c[2]) if c[0] == "#" else fold(c)
        if kids and shape(kids[-1]) == shape(f):
            kids[-1] = _joined(kids[-1], f)
        else:
            kids.append(f)
    return (node[0], tuple(kids), [])


def shape(node: tuple) -> tuple:
    return (node[0], tuple(shape(c) for c in node[1]))


def _joined(a: tuple, b: tuple) -> tuple:
    return (a[0], tuple(_joined(x, y) for x, y in zip(a[1], b[1], strict=True)), a[2] + b[2])


class Node:
    """A template node: pages that have it, the CRC of its text if constant else None, characters of text."""

    __slots__ = ("chars", "kids", "label", "n", "same")

    def __init__(self, label: str, n: int, same: int | None, chars: int, kids: list["Node"]):
        self.label, self.n, self.same, self.chars, self.kids = label, n, same, chars, kids

    @staticmethod
    def of(page: tuple) -> "Node":
        text = "\n".join(page[2])
        return Node(page[0], 1, zlib.crc32(text.encode("utf-8", "surrogatepass")), len(text), [Node.of(c) for c in page[1]])

    def pack(self) -> list:
        return [self.label, self.n, self.same, self.chars, [k.pack() for k in self.kids]]

    @staticmethod
    def unpack(x: list) -> "Node":
        return Node(*x[:4], [Node.unpack(k) for k in x[4]])


def _label(x) -> str:
    return x.label if isinstance(x, Node) else x[0]


def _kids(x):
    return x.kids if isinstance(x, Node) else x[1]


def match(a, b, memo: dict) -> int:
    """Simple tree matching: the size of the largest order-keeping matching of two trees."""
    if _label(a) != _label(b):
        return 0
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = 1 + sum(w for _, _, w in aligned(_kids(a), _kids(b), memo))
    return memo[key]


def aligned(xs, ys, memo: dict) -> list[tuple[int, int, int]]:
    """Matched child pairs (i, j, weight), in order, of the largest total weight."""
    n, m = len(xs), len(ys)
    if n * m > 1_000_000:
        return _aligned_in_blocks(xs, ys)
    w = [[match(x, y, memo) for y in ys] for x in xs]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = max(below[j], row[j + 1], below[j + 1] + w[i][j] if w[i][j] else 0)
    out, i, j = [], 0, 0
    while i < n and j < m:
        if w[i][j] and best[i][j] == best[i + 1][j + 1] + w[i][j]:
            out.append((i, j, w[i][j]))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


class _Weights:
    """Rows of the weights of xs against ys, a row at a time; children of one shape weigh the same, so shapes are matched once."""

    def __init__(self, xs, ys):
        self.xs, self.ys, self.numbers = xs, ys, {}
        self.x, y = ([self.number(t) for t in side] for side in (xs, ys))
        self.kinds, first, self.y = np.unique(np.array(y), return_index=True, return_inverse=True)
        self.by_label: dict[str, list[int]] = {}
        for k, at in enumerate(first):
            self.by_label.setdefault(_label(ys[at]), []).append(k)
        self.first, self.kept = first, OrderedDict()

    def number(self, tree) -> int:
        """Of the tree's shape: labels and their order, no texts."""
        key = (_label(tree), *[self.number(t) for t in _kids(tree)])
        return self.numbers.setdefault(key, len(self.numbers))

    def __getitem__(self, i: int) -> np.ndarray:
        kind = self.x[i]
        if kind not in self.kept:
            row, memo = np.zeros(len(self.kinds), np.int64), {}
            for k in self.by_label.get(_label(self.xs[i]), ()):
                row[k] = match(self.xs[i], self.ys[self.first[k]], memo)
            self.kept[kind] = row
            if len(self.kept) * len(row) > 1_000_000 and len(self.kept) > 1:
                self.kept.popitem(last=False)
        return self.kept[kind][self.y]


def _aligned_in_blocks(xs, ys) -> list[tuple[int, int, int]]:
    """The same pairs as the whole table gives: every block's first row is kept, and blocks are made again as the path comes to them."""
    n, m = len(xs), len(ys)
    w, size = _Weights(xs, ys), math.isqrt(n) + 1

    def above(i: int, below: np.ndarray) -> np.ndarray:
        """Row i of the table from row i + 1."""
        at = w[i]
        row = below.copy()
        row[:-1] = np.maximum(row[:-1], np.where(at > 0, below[1:] + at, 0))
        return np.maximum.accumulate(row[::-1])[::-1]

    row, kept = np.zeros(m + 1, np.int64), {n: np.zeros(m + 1, np.int64)}
    for i in range(n - 1, -1, -1):
        row = above(i, row)
        if i % size == 0:
            kept[i] = row
    out, i, j = [], 0, 0
    while i < n and j < m:
        start, end = i - i % size, min(n, i - i % size + size)
        best = {end: kept[end]}
        for k in range(end - 1, start - 1, -1):
            best[k] = above(k, best[k + 1])
        while i < end and j < m:
            at = w[i]
            while j < m:
                if at[j] and best[i][j] == best[i + 1][j + 1] + at[j]:
                    out.append((i, j, int(at[j])))
                    i, j = i + 1, j + 1
                    break
                if best[i][j] == best[i + 1][j]:
                    i += 1
                    break
                j += 1
    return out


def merge(a: Node, b: Node, memo: dict | None = None) -> Node:
    """b's tree merged into a's: matched nodes add up, the others stay in order."""
    memo = {} if memo is None else memo
    pairs = aligned(a.kids, b.kids, memo)
    kids, i, j = [], 0, 0
    for x, y, _ in [*pairs, (len(a.kids), len(b.kids), 0)]:
        kids += a.kids[i:x] + b.kids[j:y]
        if x < len(a.kids) and y < len(b.kids):
            kids.append(merge(a.kids[x], b.kids[y], memo))
        i, j = x + 1, y + 1
    return Node(a.label, a.n + b.n, a.same if a.same == b.same else None, a.chars + b.chars, kids)


def is_furniture(label: str, inside: bool) -> bool:
    """By element or names; a header inside the main slot belongs to it."""
    tag, _, names = label.partition(" ")
    return tag in FURNITURE_TAGS or (tag == "header" and not inside) or bool(names and FURNITURE.search(names))


def varying(node: Node, pages: int, inside: bool = False, past: frozenset = frozenset()) -> int:
    """Characters of text in the varying slots below, furniture and the nodes of `past` (by id) left out."""
    if is_furniture(node.label, inside) or id(node) in past:
        return 0
    own = node.chars if node.label == "#" and not is_constant(node, pages) else 0
    return own + sum(varying(k, pages, inside, past) for k in node.kids)


def is_constant(node: Node, pages: int) -> bool:
    """The same text on most of a host's pages, of which there are enough to tell."""
    return node.same is not None and node.n >= 5 and 2 * node.n >= pages


def main_slots(root: Node, most: int = 16) -> list[list[int]]:
    """Paths to the main slots of a host's layouts, that of most text first."""
    paths: list[list[int]] = []
    past: set[int] = set()
    while len(paths) < most:
        path = main_slot(root, frozenset(past))
        if not path or path in paths:
            break
        paths.append(path)
        node = root
        for step in path:
            node = node.kids[step]
        past.add(id(node))
    return paths


def main_slot(root: Node, past: frozenset = frozenset()) -> list[int]:
    """The path of child numbers from the root to the main slot, outside nodes of `past`; elements named for it count if half the pages have them."""
    node, path = root, []
    while True:
        weights = [varying(k, root.n, False, past) for k in node.kids]
        total = sum(weights)
        if not total or any(k.label == "#" and w for k, w in zip(node.kids, weights, strict=True)):
            return path
        named = [i for i, k in enumerate(node.kids) if k.label.split(" ")[0] in MAIN_TAGS and weights[i] and 2 * k.n >= node.n]
        best = max(named or range(len(weights)), key=weights.__getitem__)
        beside = [k.label.split(" ")[0] for i, k in enumerate(node.kids) if i != best and weights[i]]
        # Where nothing can be compared all text counts; else headings and paragraphs beside the best child do.
        if not named and (weights[best] < 0.8 * total or beside and (root.n == 1 or any(x in PROSE for x in beside))):
            return path
        if node.kids[best].label.split(" ")[0] in (*PROSE, "ul", "ol", "table"):
            return path
        node = node.kids[best]
        path.append(best)
        if named:
            return path


def content(template: Node, paths: list[list[int]], raw: list) -> str:
    """The page's text in the first main slot where it has any, else in all that isn't furniture: aligned node by node, blocks in page order."""
    picked: list = []
    memo: dict = {}

    def collect(kids: list, inside: bool = True, article: bool = False) -> None:
        """article: in an element named for the main text, where what all pages have is text too."""
        for tk, child in kids:
            if child[0] == "#":
                if article or not (tk and is_constant(tk, template.n)):
                    picked.extend(child[2])
            elif not is_furniture(child[0], inside):
                main = child[0].split(" ")[0] in MAIN_TAGS
                collect(pair(tk, child), inside or main, article or main)

    def pair(t: Node | None, node: list) -> list:
        """The raw children of a node, each with the template node of the folded run it is in."""
        f = fold(node)
        to = {j: t.kids[i] for i, j, _ in aligned(t.kids, f[1], memo)} if t else {}
        out, j, shapes = [], -1, [shape(c) for c in f[1]]
        hold.append(f)
        for c in node[1]:
            s = ("#", ()) if c[0] == "#" else shape(fold(c))
            if j < 0 or s != shapes[j]:
                j += 1
            out.append((to.get(j), c))
        return out

    hold: list = []  # folded nodes stay alive, since memo goes by id
    for path in paths:
        at = [(template, raw)]
        for step in path:
            at = [(t.kids[step], c) for t, node in at for tk, c in pair(t, node) if tk is t.kids[step]]
        for t, node in at:
            collect(pair(t, node), True, node[0].split(" ")[0] in MAIN_TAGS)
        if picked:
            break
    else:
        collect(pair(template, raw), False)
    return "\n\n".join(picked)


def digest(page: tuple) -> str:
    """Of a folded page's text outside furniture."""
    texts: list = []

    def walk(node: tuple) -> None:
        for c in node[1]:
            if c[0] == "#":
                texts.extend(c[2])
            elif not is_furniture(c[0], False):
                walk(c)

    walk(page)
    return hashlib.md5("\n".join(texts).encode("utf-8", "surrogatepass")).hexdigest()


def _outlines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to (host, digest, outline), each digest of a host once a batch."""
    for b in batches:
        out: dict[tuple, str] = {}
        for host, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            page = fold(parse(x.as_py() or ""))
            key, outline = (host, digest(page)), json.dumps(Node.of(page).pack())
            out[key] = min(out.get(key, outline), outline)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()), pa.array(list(out.values()), pa.string())], names=["host", "digest", "outline"])


def _templates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, outline) to a template per host."""
    hosts: dict[str, Node] = {}
    for b in batches:
        for host, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            new = Node.unpack(json.loads(x))
            hosts[host] = merge(hosts[host], new) if host in hosts else new
    part = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays([pa.array(list(hosts), pa.string()), pa.array([json.dumps(t.pack()) for t in hosts.values()], pa.string()), pa.array([part] * len(hosts), pa.int32())], names=["host", "template", "part"])


def _merge_group(t: pa.Table) -> pa.Table:
    """Partial templates of one host, smallest first by text, so that the order of arrival is nothing."""
    out = None
    for x in sorted(t["template"].to_pylist(), key=lambda s: (len(s), s)):
        new = Node.unpack(json.loads(x))
        out = new if out is None else merge(out, new)
    return pa.table({"host": pa.array([t["host"][0].as_py()], pa.string()), "template": pa.array([json.dumps(out.pack())], pa.string())})


def extract(pages: DataFrame, host: Column, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 8 << 20) -> DataFrame:
    """id, url, text, n_chars of each page."""
    prepare(pages.sparkSession)
    base = pages.select(F.col(id_col), F.col(url_col), F.coalesce(host, F.lit("")).alias("_host"), F.col(html_col).alias("_html"))
    outlines = base.select("_host", "_html").mapInArrow(lean("html", _outlines), "host string, digest string, outline string").groupBy("host", "digest").agg(F.min("outline").alias("outline"))
    partial = outlines.sortWithinPartitions("host", "digest").select("host", "outline").mapInArrow(lean("html", _templates), "host string, template string, part int")
    level = partial.groupBy("host", F.pmod("part", F.lit(32)).alias("bucket")).applyInArrow(lean_group("html", _merge_group), "host string, template string")
    templates = written(level.groupBy("host").applyInArrow(lean_group("html", _merge_group), "host string, template string"), "html")
    size = templates.agg(F.coalesce(F.sum(F.octet_length("template") + F.octet_length("host")), F.lit(0)).alias("b")).first()["b"]
    side = templates.select(F.col("host").alias("_host"), F.col("template").alias("_template"))
    joined = base.join(F.broadcast(side) if size <= broadcast_bytes else side, "_host", "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[str, tuple[Node, list[list[int]]]] = OrderedDict()
        for b in batches:
            texts = []
            for page, wrapper in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                if wrapper not in known:
                    t = Node.unpack(json.loads(wrapper))
                    known[wrapper] = (t, main_slots(t))
                    if len(known) > 256:
                        known.popitem(last=False)
                raw = parse(page.as_py() or "")
                texts.append(content(*known[wrapper], raw))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return joined.select(id_col, url_col, "_html", "_template").mapInArrow(lean("html", run), f"`{id_col}` {kinds[id_col]}, `{url_col}` string, text string, n_chars long")
