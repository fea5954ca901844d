"""Main text of web pages by wrapper induction.

Pages become trees of their block elements; runs of equal siblings count as one node. All
pages of a host with the same layout (top containers) are aligned with one of them by simple tree matching. What is the
same text at an aligned node on nearly all pages of the host, over several different article bodies, is
template, so copies of one article under several urls don't make its text template. The content slot is all
content elements, or all text if another node holds more of the varying text. Each page gives
the text of its slot, without template nodes and without menus,
headers, footers, side bars, notices, adverts, forms, scripts, styles and reader comments.

A host's statistics are sums and extremes, combined per task before the shuffle, so a host
with a third of all pages is no hot group. The wrappers (one page per host and its figures) are
broadcast only if their measured size is within a limit, else joined by host.

Defined results: null and empty html have an empty text; a null url is the host ``""``; a page
that can't be aligned with its host's wrapper is judged by its own elements; template nodes are kept on a page
that would have no text without them, and on a host whose text nearly all is the same; nesting
has no limit; lists of more than ``MAX_CHILDREN`` different siblings are aligned in order
instead of by the best match; an empty table gives an empty one; further columns are kept.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewave.llm.chunks import texts_of
from tidewave.llm.memory import give_back
from tidewave.operators.sizing import cut_lineage

# Elements by their role in a page.
INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i ins del kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template svg xmp noembed noframes".split())
BOILERPLATE = set("head nav footer aside form script style noscript template iframe svg button select textarea dialog menu title object canvas".split())
CONTENT = ("article", "main")
CONTAINERS = {"html", "body", "div", "section", "article", "main", "center"}
CLOSES_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "table", "dl", "select", "div", "section", "article", "body"}
BOILERPLATE_NAMES = set(
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar side-bar aside widget footer site-footer header site-header masthead topbar cookie cookies consent gdpr notice notification alert "
    "popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended comment comments "
    "comment-list reader-comments disqus replies reply respond pagination pager toolbar skip-link".split())
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search dialog alert form menu menubar".split())

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))", re.S)
NAMES = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
MAX_CHILDREN = 200
MIN_PAGES = 3
TEMPLATE_SHARE = 0.9
MIN_CHANGING = 0.2
HOST = -1  # the node that counts the pages of a host
BROADCAST_BYTES = 16 << 20
STATS = "host string, node int, body long, n long, low long, high long, size long"


class Page:
    """Block tree of a page: tags, labels and parents of its nodes, and text pieces in page order."""

    def __init__(self, source: str):
        self.tag, self.label, self.parent, self.skip = ["#root"], ["#root"], [-1], [False]
        self.content = [False]
        self.pieces: list[tuple[int, str]] = []
        self.children: list[list[int]] = [[]]
        self.read(source)

    def open(self, tag: str, attributes: str, parent: int) -> int:
        names, role, classes = [], "", ""
        for kind, *values in NAMES.findall(attributes) if attributes else ():
            value = (values[0] or values[1] or values[2]).lower()
            if kind.lower() == "role":
                role = value
            else:
                names += value.split()
                if kind.lower() == "class":
                    classes = "." + ".".join(sorted(value.split()))
        content = tag in CONTENT or role == "main"
        boiler = tag in BOILERPLATE or role in BOILERPLATE_ROLES or any(n in BOILERPLATE_NAMES for n in names)
        if tag == "header" and not self.content[parent]:
            boiler = True
        self.tag.append(tag)
        self.label.append(tag + re.sub(r"\d+", "", classes))
        self.parent.append(parent)
        self.skip.append(self.skip[parent] or boiler)
        self.content.append(self.content[parent] or content)
        self.children.append([])
        self.children[parent].append(len(self.tag) - 1)
        return len(self.tag) - 1

    def read(self, source: str) -> None:
        stack, text, at, n = [0], [], 0, len(source)
        opened: Counter[str] = Counter()  # tags on the stack

        def close(depth: int) -> None:
            while len(stack) > depth:
                opened[self.tag[stack.pop()]] -= 1

        def flush() -> None:
            if text:
                piece = " ".join(entities.unescape("".join(text)).split())
                text.clear()
                if piece:
                    self.pieces.append((stack[-1], piece))

        while at < n:
            found = TAG.search(source, at)
            if not found:
                text.append(source[at:])
                break
            text.append(source[at:found.start()])
            at = found.end()
            closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not tag:
                continue
            tag = tag.lower()
            if tag == "br":
                text.append(" ")
                continue
            if not closing and tag in RAW:
                if not attributes.rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(source, at)
                    at = end.end() if end else n
                continue
            if tag in INLINE:
                continue
            flush()
            if closing:
                if opened[tag]:
                    while self.tag[stack[-1]] != tag:
                        close(len(stack) - 1)
                    close(len(stack) - 1)
                continue
            if tag in CLOSES_P and self.tag[stack[-1]] == "p":
                close(len(stack) - 1)
            ends = SIBLINGS.get(tag)
            if ends and any(opened[e] for e in ends):
                for depth in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[depth]] in ends:
                        close(depth)
                        break
                    if self.tag[stack[depth]] in SCOPES:
                        break
            if tag in VOID or attributes.rstrip().endswith("/"):
                continue
            stack.append(self.open(tag, attributes, stack[-1]))
            opened[tag] += 1
        flush()


class Shape:
    """A page's tree with runs of equal siblings as one node: labels, children, and member nodes."""

    def __init__(self, page: Page):
        self.labels, self.children, self.members = [page.label[0]], [[]], [[0]]
        todo = [0]
        while todo:
            me = todo.pop()
            runs: list[list[int]] = []
            for m in self.members[me]:
                for c in page.children[m]:
                    if runs and page.label[runs[-1][0]] == page.label[c]:
                        runs[-1].append(c)
                    else:
                        runs.append([c])
            for run in runs:
                todo.append(len(self.labels))
                self.children[me].append(len(self.labels))
                self.labels.append(page.label[run[0]])
                self.children.append([])
                self.members.append(run)
        # A child comes after its parent, so backwards each has the keys of its children.
        keys = [b""] * len(self.labels)
        for k in range(len(keys) - 1, -1, -1):
            own = self.labels[k].encode("utf-8", "replace") + b"\0" + b"".join(keys[c] for c in self.children[k])
            keys[k] = hashlib.blake2b(own, digest_size=16).digest()
        self.key = keys[0]


def match_trees(a: Shape, b: Shape) -> dict[int, int]:
    """Simple tree matching: the largest order-keeping match of equal labels, as node of a -> node of b."""
    sizes: dict[tuple[int, int], int] = {}

    def table(x: int, y: int) -> list[list[int]]:
        xs, ys = a.children[x], b.children[y]
        rows = [[0] * (len(ys) + 1)]
        for i, cx in enumerate(xs, 1):
            row, above = [0], rows[-1]
            for j, cy in enumerate(ys, 1):
                row.append(max(row[-1], above[j], above[j - 1] + size(cx, cy)))
            rows.append(row)
        return rows

    def long(x: int, y: int) -> bool:
        return len(a.children[x]) > MAX_CHILDREN or len(b.children[y]) > MAX_CHILDREN

    def in_order(x: int, y: int) -> list[tuple[int, int]]:
        pairs, ys = [], iter(b.children[y])
        for cx in a.children[x]:
            cy = next(ys, None)
            if cy is None:
                break
            if a.labels[cx] == b.labels[cy]:
                pairs.append((cx, cy))
        return pairs

    def size(x: int, y: int) -> int:
        return sizes[x, y] if a.labels[x] == b.labels[y] else 0

    def below(x: int, y: int) -> list[tuple[int, int]]:
        if long(x, y):
            return in_order(x, y)
        return [(cx, cy) for cx in a.children[x] for cy in b.children[y] if a.labels[cx] == b.labels[cy]]

    # Each pair has one pair above it and comes after it, so backwards the pairs below are known.
    pairs = [(0, 0)]
    for x, y in pairs:
        pairs += below(x, y)
    for x, y in reversed(pairs):
        sizes[x, y] = 1 + (sum(size(*p) for p in in_order(x, y)) if long(x, y) else table(x, y)[-1][-1])

    matched: dict[int, int] = {}
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        matched[x] = y
        if long(x, y):
            todo += in_order(x, y)
            continue
        rows, i, j = table(x, y), len(a.children[x]), len(b.children[y])
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((a.children[x][i], b.children[y][j]))
    return matched


class Aligner:
    """Alignments by shape, remembered: pages of a host mostly have few shapes."""

    def __init__(self) -> None:
        self.known: dict[tuple[bytes, bytes], dict[int, int]] = {}

    def align(self, wrapper: Shape, page: Shape) -> dict[int, int]:
        key = (wrapper.key, page.key)
        if key not in self.known:
            if len(self.known) > 2000:
                self.known.clear()
            self.known[key] = match_trees(wrapper, page)
        return self.known[key]


def own_texts(page: Page) -> dict[int, str]:
    found: dict[int, list[str]] = {}
    for node, piece in page.pieces:
        found.setdefault(node, []).append(piece)
    return {k: " ".join(v) for k, v in found.items()}


def hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def slot_of(page: Page, shape: Shape, varying: dict[int, int], known: Iterable[int] = ()) -> list[int]:
    """The nodes of the shape that hold the article: its outermost content elements and the ``known`` nodes with text,
    or the root, which is all text but boilerplate and template, if another node has more. ``varying``: size of the
    changing text of each node."""
    n = len(shape.labels)
    mass, inside, chosen = [0] * n, [False] * n, set(known)
    for k in range(n - 1, -1, -1):
        if not page.skip[shape.members[k][0]]:
            mass[k] = varying.get(k, 0) + sum(mass[c] for c in shape.children[k])
    slots = []
    for k in range(n):
        if not inside[k] and mass[k] and (k in chosen or any(page.content[m] for m in shape.members[k])):
            slots.append(k)
            inside[k] = True
        for c in shape.children[k]:
            inside[c] = inside[k]
    around = set()
    for k in range(n - 1, -1, -1):
        if k in slots or any(c in around for c in shape.children[k]):
            around.add(k)
    other = max((varying.get(k, 0) if k in around else mass[k] for k in range(n) if not inside[k]), default=0)
    return slots if slots and sum(mass[k] for k in slots) >= other else [0]


def text_within(page: Page, roots: list[int], template: set[int]) -> str:
    inside = set(roots)
    for node in range(len(page.tag)):
        if page.parent[node] in inside:
            inside.add(node)
    return " ".join(piece for node, piece in page.pieces if node in inside and not page.skip[node] and node not in template)


def sizes_of(page: Page, shape: Shape, template: set[int]) -> dict[int, int]:
    own = own_texts(page)
    return {k: sum(len(own[m]) for m in members if m in own and m not in template) for k, members in enumerate(shape.members)}


def layout_of(source: str) -> int:
    """Hash of the containers that a page has side by side at the top, without boilerplate."""
    page, at, path = Page(source), 0, []
    while True:
        inner = [c for c in page.children[at] if page.tag[c] in CONTAINERS and not page.skip[c]]
        labels = sorted({page.label[c] for c in inner})
        path.append(",".join(labels))
        if len(inner) != 1 or page.content[inner[0]]:
            return hashed("/".join(path))
        at = inner[0]


def body_of(page: Page) -> int:
    """Hash of the article's text: within the content elements, or of all text outside boilerplate if they have none."""
    own = [(node, piece) for node, piece in page.pieces if not page.skip[node]]
    return hashed(" ".join([piece for node, piece in own if page.content[node]] or [piece for _, piece in own]))


class Wrapper:
    """One host's page with what the others have at its nodes."""

    def __init__(self, source: str, stats: list[dict]):
        self.page = Page(source)
        self.shape = Shape(self.page)
        pages = max((s["n"] for s in stats if s["node"] == HOST), default=0)
        stats = [s for s in stats if s["node"] != HOST]
        self.constant = {s["node"] for s in stats if s["n"] >= max(MIN_PAGES, TEMPLATE_SHARE * pages)
                         and s["bodies"] >= MIN_PAGES and s["low"] == s["high"]}
        kept = [s for s in stats if not self.page.skip[self.shape.members[s["node"]][0]]]
        changing = sum(s["size"] for s in kept if s["node"] not in self.constant)
        if changing < MIN_CHANGING * sum(s["size"] for s in kept) and not any(self.page.content):
            self.constant = set()
        self.slot = slot_of(self.page, self.shape, {s["node"]: s["size"] for s in stats if s["node"] not in self.constant})

    def text_of(self, page: Page, shape: Shape, aligner: Aligner) -> str:
        aligned = aligner.align(self.shape, shape)
        template = {m for k in self.constant if k in aligned for m in shape.members[aligned[k]]}
        known = [aligned[k] for k in self.slot if k and k in aligned]
        slots = slot_of(page, shape, sizes_of(page, shape, template), known)
        roots = [m for k in slots for m in shape.members[k]]
        return text_within(page, roots, template) or text_within(page, roots, set()) or text_within(page, [0], set())


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def with_layouts(pages: DataFrame) -> DataFrame:
    """``_host`` with the layout of the page, so that each layout of a host has its own wrapper."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("_host")
            sources = texts_of(batch.column(batch.schema.names.index("_html")))
            keys = [f"{h} {layout_of(s)}" for h, s in zip(texts_of(batch.column(at)), sources)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)
        give_back()

    return pages.mapInArrow(mark, pages.schema)


def with_wrappers(pages: DataFrame, wrappers: DataFrame, limit: int) -> DataFrame:
    size = wrappers.agg(F.sum(F.octet_length("_sample"))).first()[0] or 0
    return pages.join(F.broadcast(wrappers) if size <= limit else wrappers, "_host")


def extract(
    pages: DataFrame, url: str = "url", html: str = "html", order: str = "page_id", output: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Add the main text of each page; the html is dropped."""
    kept = [c for c in pages.columns if c not in (html, output)]
    source = with_layouts(pages.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(html), F.lit("")).alias("_html"), host_of(F.col(url)).alias("_host")))
    chosen = F.struct(F.octet_length("_html") == 0, F.xxhash64(order, "_html"), F.col("_html"))
    samples = cut_lineage(source.groupBy("_host").agg(F.min(chosen)["_html"].alias("_sample")))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, known = Aligner(), {}
        for batch in batches:
            # Of each node up to MIN_PAGES bodies get a row of their own, so that several are told from few.
            found: dict[tuple[str, int], dict[int, list[int]]] = {}
            for host, source, sample in zip(*(texts_of(batch.column(i)) for i in range(3))):
                if host not in known:
                    if len(known) > 500:
                        known.clear()
                    known[host] = Wrapper(sample, [])
                wrapper, page = known[host], Page(source)
                if not page.pieces:
                    continue
                shape, own, body = Shape(page), own_texts(page), body_of(page)
                texts = {k: " ".join(own[m] for m in shape.members[at] if m in own) for k, at in aligner.align(wrapper.shape, shape).items()}
                for k, text in [(HOST, ""), *texts.items()]:
                    if text or k == HOST:
                        h = hashed(text)
                        bodies = found.setdefault((host, k), {})
                        s = bodies.get(body) or (bodies.setdefault(body, [0, h, h, 0]) if len(bodies) < MIN_PAGES else next(iter(bodies.values())))
                        s[0], s[1], s[2], s[3] = s[0] + 1, min(s[1], h), max(s[2], h), s[3] + len(text)
            rows = [(*k, body, *s) for k, bodies in found.items() for body, s in bodies.items()]
            if rows:
                schema = pa.schema([("host", pa.string()), ("node", pa.int32()), *((c, pa.int64()) for c in ("body", "n", "low", "high", "size"))])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        give_back()

    stats = (
        with_wrappers(source.select("_host", "_html"), samples, broadcast_bytes).select("_host", "_html", "_sample")
        .mapInArrow(measure, STATS)
        .groupBy("host", "node", "body").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("size").alias("size"))
        .groupBy("host", "node").agg(
            F.count(F.lit(1)).alias("bodies"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("size").alias("size"))
        .groupBy("host").agg(F.collect_list(F.struct("node", "bodies", "n", "low", "high", "size")).alias("_stats"))
    )
    wrappers = cut_lineage(samples.join(stats, samples["_host"] == stats["host"], "left").drop("host"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, known = Aligner(), {}
        for batch in batches:
            names = batch.schema.names
            host, source, sample = (texts_of(batch.column(names.index(c))) for c in ("_host", "_html", "_sample"))
            stats, texts = batch.column(names.index("_stats")), []
            for i, (h, s, w) in enumerate(zip(host, source, sample)):
                if h not in known:
                    if len(known) > 500:
                        known.clear()
                    known[h] = Wrapper(w, stats[i].as_py() or [])
                page = Page(s)
                texts.append(known[h].text_of(page, Shape(page), aligner))
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), pa.array(texts, pa.string())], names=[*kept, output])
        give_back()

    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField(output, T.StringType())])
    return with_wrappers(source, wrappers, broadcast_bytes).mapInArrow(take, schema)
