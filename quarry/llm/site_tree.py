"""Main text of web pages by site style trees (operator 4).

Pages of one host are merged into a style tree over their whole visible DOM: a node
stands for all elements with the same path of tags, classes and ids. Over the host's
pages a node has a presentation importance, the entropy of its child sequences, and a
content importance, one minus the mean entropy of the texts in its branch over the
pages (base: the number of pages, so a text on one page gives 1 and the same
text on all gives 0). Their mix is the node's importance, and from each page go the
branches of low importance.

A host of few pages says nothing about its branches, and menus or comments may differ on
every page. So what an element says of itself is a prior: navigation, header, footer,
sidebar and form elements, lists of links, and elements all of whose words in a class or id
token are such words (``cookie-notice``, ``sidebarLeft``; not ``has-sidebar`` or
``related-work``). The prior never takes a branch that holds an ``article`` or
``main`` element, and names and forms none with more than half of the page's text. A
page with ``article`` or ``main`` elements gives what stands in them.

Pages of equal main text count once in a tree, so copies of a page do not make its text
look like a template, and a branch that holds half of the text left by the prior always
stays. Trees are sums: a host may hold any share of the pages. Nodes to be removed are
broadcast up to ``MAX_BROADCAST_NODES``; beyond that they are joined by node.

Defined cases: null and empty html have empty text; a null url is a host of its
own; unclosed and crossing tags are closed as browsers do for paragraphs, list
items and table cells; repeated rows give repeated results; an empty table
gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import prepare, stash

GAMMA = 0.9                    # weight of presentation against content, per kind of child sequence
LOW = 0.15                     # importance under which a branch goes
MIN_PAGES = 5                  # different pages that a node needs to be judged
BULK = 0.5                     # share of a page's text that is never removed as a template
MENU_LINKS, MENU_SHARE = 3, 0.6
MAX_BROADCAST_NODES = 2_000_000

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section
    summary table tbody td tfoot th thead tr ul caption""".split())
CLOSES_P = BLOCK - {"body", "html", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select", "datalist"})}
# Elements without text of the page, and what an element's name, role, class or id says about it.
UNSEEN_TAGS = frozenset("""head script style title noscript template button select option optgroup input textarea iframe
    object embed svg canvas audio video map datalist xmp noembed noframes""".split())
GONE_TAGS = frozenset("nav footer aside menu dialog search".split())
GONE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
GONE_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar
    navigation menu breadcrumb breadcrumbs masthead sidebar aside widget related recommended comment comments disqus respond
    reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login
    share sharing social toolbar pagination pager copyright disclaimer""".split())
NEUTRAL_WORDS = frozenset("""left right top bottom upper lower main primary secondary site page global inner outer box block
    container wrapper wrap area list bar section panel group item items row column title heading button buttons link links
    text content mobile desktop small large fixed sticky footer header form id thread tree policy""".split())
EDGE_WORDS = frozenset("header footer".split())        # noise, unless they are an article's own

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>
    |<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""", re.S | re.X)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Node:
    __slots__ = ("tag", "name", "unseen", "gone", "named", "own", "parts", "parent", "size", "holds")

    def __init__(self, tag: str, attributes: str, parent: "Node | None"):
        self.tag, self.parent, self.parts = tag, parent, []
        self.own = tag in ("article", "main") or (parent is not None and parent.own)
        self.size, self.holds = 0, False            # characters of the branch; whether it holds an article
        self.name, tokens = tag, []
        hidden = role = False
        if attributes and not attributes.isspace():
            for key, a, b, c in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), a or b or c
                if key in ("class", "id"):
                    self.name += f" {key}=" + re.sub(r"\d+", "0", value)
                    tokens += value.split()
                elif key == "role":
                    self.name += f" role={value}"
                    role |= value.lower() in GONE_ROLES
                elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                    hidden = True
                elif key == "style" and "display:none" in value.replace(" ", "").lower():
                    hidden = True
        self.unseen = hidden or tag in UNSEEN_TAGS
        self.gone = role or tag in GONE_TAGS or (tag == "header" and not self.own)
        self.named = tag == "form" or (tag not in ("html", "body") and any(says_noise(t, self.own) for t in tokens))


@lru_cache(1 << 14)
def says_noise(token: str, own: bool) -> bool:
    """Whether all words of a class or id token are words of noise or neutral ones, and one of them noise."""
    words = {w.lower() for w in NAME_WORD.findall(token)}
    noise = words & GONE_WORDS
    if noise:
        return words <= GONE_WORDS | NEUTRAL_WORDS
    return not own and bool(words & EDGE_WORDS) and words <= EDGE_WORDS | NEUTRAL_WORDS - {"content", "main", "text", "title"}


def measure(root: Node) -> None:
    """Sizes of the branches, without unseen elements, and which hold an article."""
    done, stack = [], [root]
    while stack:
        top = stack.pop()
        done.append(top)
        stack += [p for p in top.parts if isinstance(p, Node) and not p.unseen]
    for top in reversed(done):
        top.size = sum(len(p.strip()) if isinstance(p, str) else p.size for p in top.parts)
        top.holds = any(isinstance(p, Node) and not p.unseen and (p.holds or p.tag in ("article", "main")) for p in top.parts)


def removed(root: Node, linked: bool):
    """Whether the prior takes an element out of the page of ``root`` (measured)."""

    def test(node: Node) -> bool:
        if node.unseen:
            return True
        if node.holds:
            return False
        if node.gone or (node.named and node.size <= BULK * root.size):
            return True
        return linked and is_menu(node)
    return test


def parse(page: str) -> Node:
    """Element tree; ``parts`` holds texts (references decoded) and nodes in order."""
    root = top = Node("#root", "", None)
    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            top.parts.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            top.parts.append(entities.unescape(page[at:m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                top.parts.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            node = top
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                top = node.parent
            continue
        if tag in CLOSES_P:
            top = close(top, {"p"}, {"table", "td", "th", "li", "div", "article", "main", "section", "body"})
        elif tag in SAME:
            top = close(top, *SAME[tag])
        node = Node(tag, m[3], top)
        top.parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not m[3].endswith("/"):
            top = node
    return root


def close(top: Node, ends: set, stops: set) -> Node:
    """The open element to go on from, once open elements of ``ends`` (nearer than ``stops``) have ended."""
    node, out = top, top
    while node is not None and node.tag not in stops:
        if node.tag in ends:
            out = node.parent
        node = node.parent
    return out


def key_of(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def squeezed(text: str) -> str:
    return " ".join(text.split())


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def blocks(node: Node, gone) -> Iterator[tuple[str, tuple[Node, ...]]]:
    """(text, elements around it) of the text blocks under ``node`` without the branches that ``gone`` takes."""
    held: list[str] = []
    around: list[tuple[Node, ...]] = [()]

    def flush():
        text = squeezed("".join(held))
        held.clear()
        if text:
            yield text, around[0]

    # An explicit stack: pages may nest deeper than Python's calls.
    stack = [(node, iter(node.parts), (node,))]
    while stack:
        top, parts, path = stack[-1]
        for part in parts:
            if isinstance(part, str):
                if not held or not "".join(held).strip():
                    around[0] = path
                held.append(part)
            elif part.tag == "br":
                held.append(" ")
            elif not gone(part):
                if part.tag in BLOCK:
                    yield from flush()
                stack.append((part, iter(part.parts), (*path, part)))
                break
            elif part.tag in BLOCK:
                yield from flush()
        else:
            stack.pop()
            if top.tag in BLOCK or not stack:
                yield from flush()


def is_menu(node: Node) -> bool:
    """Lists and boxes whose text mostly stands in several links."""
    if node.tag not in ("ul", "ol", "div", "section", "table", "dl"):
        return False
    links = linked = total = 0
    stack = [(node, False)]
    while stack:
        top, inside = stack.pop()
        for part in top.parts:
            if isinstance(part, str):
                n = len(part.strip())
                total += n
                linked += n * inside
            else:
                links += part.tag == "a"
                stack.append((part, inside or part.tag == "a"))
    return links >= MENU_LINKS and linked > MENU_SHARE * total


def has_links(page: str) -> bool:
    return page.count("<a") + page.count("<A") >= MENU_LINKS


def roots(root: Node, gone) -> list[Node]:
    """Where the text is: outermost articles, else mains, else the whole page."""
    for tag in ("article", "main"):
        found, stack = [], [root]
        while stack:
            top = stack.pop()
            for part in reversed(top.parts):
                if isinstance(part, Node) and not gone(part):
                    if part.tag == tag:
                        found.append(part)
                    else:
                        stack.append(part)
        if found:
            return order(root, found)
    return [root]


def order(root: Node, found: list[Node]) -> list[Node]:
    """``found`` in page order."""
    wanted, out, stack = {id(n) for n in found}, [], [root]
    while stack:
        top = stack.pop()
        if id(top) in wanted:
            out.append(top)
            continue
        stack.extend(p for p in reversed(top.parts) if isinstance(p, Node))
    return out


def candidate_blocks(root: Node, linked: bool) -> list[tuple[str, tuple[Node, ...]]]:
    """Blocks of a page that the prior leaves."""
    gone = removed(root, linked)
    return [b for top in roots(root, gone) for b in blocks(top, gone)]


def paths_of(host: str, around: tuple[Node, ...], known: dict) -> list[int]:
    """Tree keys of the elements around a block, outermost first."""
    node, chain = around[0].parent, []
    while node is not None:
        chain.append(node.name)
        node = node.parent
    path, out = "".join(f"/{name}" for name in reversed(chain)), []
    for element in around:
        path = f"{path}/{element.name}"
        if path not in known:
            known[path] = key_of(host, path)
        out.append(known[path])
    return out


def tree_rows(host: str, page: str) -> list[tuple[int, int, int, int]]:
    """(node, kind, feature, page): kind 0 the node's child sequences, kind 1 the texts in its branch."""
    root = parse(page)
    measure(root)
    whole = key_of(*(text for text, _ in candidate_blocks(root, has_links(page))))
    texts, styles, known = set(), {}, {}
    for text, around in blocks(root, lambda node: node.unseen):
        feature = key_of(text.lower())
        for key, element in zip(paths_of(host, around, known), around):
            texts.add((key, feature))
            if key not in styles:
                kinds = [p.tag for p in element.parts if isinstance(p, Node)]
                styles[key] = key_of(*(t for i, t in enumerate(kinds) if i == 0 or t != kinds[i - 1]))
    return [(key, 0, style, whole) for key, style in styles.items()] + [(key, 1, text, whole) for key, text in texts]


def importances(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(node, m, importance) of every tree node; m is the number of its pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [r for url, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if page
                        for r in tree_rows(host_of(url), page)]
                cols = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                                                  pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                                                 names=["node", "kind", "feature", "page"])

    rows = pages.select(url_col, html_col).mapInArrow(run, "node bigint, kind int, feature bigint, page bigint").distinct()
    counts = rows.groupBy("node", "kind", "feature").agg(F.count(F.lit(1)).alias("n"))
    style, text = F.col("kind") == 0, F.col("kind") == 1
    sums = counts.groupBy("node").agg(
        F.sum(F.when(style, F.col("n"))).alias("m"), F.count(F.when(style, 1)).alias("styles"),
        F.sum(F.when(style, F.col("n") * F.log("n"))).alias("s"),
        F.sum(F.when(text, F.log("n"))).alias("t"), F.count(F.when(text, 1)).alias("texts"))
    log_m = F.log("m")
    presentation = (log_m - F.col("s") / F.col("m")) / log_m                # -sum p log p, base m
    content = 1 - F.col("t") / F.col("texts") / log_m
    share = F.pow(F.lit(GAMMA), F.col("styles"))
    mixed = (1 - share) * presentation + share * content
    return sums.filter("texts > 0").select("node", "m", F.when(F.col("m") > 1, mixed).otherwise(1.0).alias("importance"))


def low_nodes(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """Keys of the tree nodes whose importance is low."""
    return importances(pages, url_col, html_col).filter(
        (F.col("m") >= MIN_PAGES) & (F.col("importance") < LOW)).select("node")


def main_text(url: str | None, page: str | None, low) -> str:
    """Text of one page; ``low`` says whether a tree node is of low importance."""
    if not page:
        return ""
    root = parse(page)
    measure(root)
    found = candidate_blocks(root, has_links(page))
    host, known = host_of(url), {}
    total = sum(len(t) for t, _ in found)
    branch: dict[int, int] = {}
    keys = [paths_of(host, around, known) for _, around in found]
    for (text, _), path in zip(found, keys):
        for key in set(path):
            branch[key] = branch.get(key, 0) + len(text)
    gone = {key for key, size in branch.items() if size < BULK * total and low(key)}
    return "\n".join(text for (text, _), path in zip(found, keys) if gone.isdisjoint(path))


TEXT_SCHEMA = "page_id bigint, url string, text string"


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    spark = pages.sparkSession
    prepare(spark)
    low = stash(low_nodes(pages, url_col, html_col), "site-low-nodes")
    base = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).alias("html"))
    if low.count() <= MAX_BROADCAST_NODES:
        shared = spark.sparkContext.broadcast(low.toArrow().column(0).to_numpy())
        found = base.mapInArrow(reader(lambda _: shared), TEXT_SCHEMA)
    else:
        found = joined(base, low)
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def reader(broadcast_of):
    """Arrow function over (page_id, url, html[, low]): nodes from the broadcast, or from the row's own list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = broadcast_of(None)
        fixed = frozenset(shared.value.tolist()) if shared is not None else None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                own = part.column(3).to_pylist() if fixed is None else [None] * part.num_rows
                texts = [main_text(u, h, (fixed if fixed is not None else frozenset(x or ())).__contains__)
                         for u, h, x in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), own)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())],
                                                 names=["page_id", "url", "text"])
    return run


def joined(base: DataFrame, low: DataFrame) -> DataFrame:
    """The way for more low nodes than a broadcast may hold: every page gets its own list of them by a join."""
    key = F.xxhash64("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, n) for k, url, page in zip(*(c.to_pylist() for c in batch.columns)) if page
                    for n in {n for n, _, _, _ in tree_rows(host_of(url), page)}]
            cols = list(zip(*rows)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["row", "node"])

    nodes = base.select(key.alias("row"), "url", "html").mapInArrow(run, "row bigint, node bigint").distinct()
    lists = nodes.join(low, "node").groupBy("row").agg(F.collect_list("node").alias("low"))
    wide = base.withColumn("row", key).join(lists, "row", "left").select("page_id", "url", "html", "low")
    return wide.mapInArrow(reader(lambda _: None), TEXT_SCHEMA)
