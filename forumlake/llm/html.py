"""Main text of web pages: boosted trees judge the nodes, one decoding makes them agree.

A page becomes a tree of block elements; text that stands directly in an element is a leaf
of its own. Gradient-boosted trees give each node the odds of being main text from its
place, size, density, siblings and attribute tokens. The decoding then chooses for every
node all, nothing or a mixture, so that nothing below a node contradicts it.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake.llm.common import ship_package
from forumlake.session import durable

#: Bound of the training sample, in pages, and size of the model.
TRAIN_PAGES = 1_000
TREES, DEPTH = 12, 4

# Elements of HTML by the way they are treated.
RAW = {"script", "style", "textarea", "title"}
HIDDEN = {"noscript", "template", "iframe", "svg", "select", "button", "object"}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
          "tt", "u", "var"}
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
             "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_P_OPEN = INLINE | EMPTY
HOLDERS = {"ul", "ol", "table", "dl", "body", "html", "article", "main", "section", "div"}
# Elements and attribute tokens that seldom are main text. The trees are told of them; see forbidden().
NEVER = {"nav", "footer", "aside", "form", "menu", "dialog"}
NEVER_TOKENS = {"ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
                "cookie", "cookies", "footer", "menu", "nav", "navbar", "navigation", "newsletter", "notice",
                "popup", "promo", "related", "share", "sharing", "sidebar", "social", "sponsored", "subscribe",
                "widget"}
TAGS = ("p", "h", "li", "ul", "div", "article", "section", "main", "nav", "footer", "header", "aside", "body",
        "td", "table", "form", "blockquote", "pre", "text")
MAIN = {"article", "main"}
TOKEN_BUCKETS = 8
#: A name of which all elements together hold more of a page's text forbids none of them.
MOST_FORBIDDEN = 0.5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s>/]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)"""
    r"|<[a-zA-Z/!?][^>]*(?:>|\Z)", re.S | re.I)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for tag in RAW}
# A slash at the end of an unquoted value belongs to the value.
UNQUOTED_END = re.compile(r"""=\s*[^\s"']+/\Z""")
CLASSES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Node:
    __slots__ = ("tag", "tokens", "names", "parent", "depth", "parts", "linked", "children", "size", "links", "tags",
                 "last", "inside", "holds")

    def __init__(self, tag: str, tokens: tuple, parent: Node | None, names: tuple = ()):
        self.tag, self.tokens, self.parent, self.names = tag, tokens, parent, names
        # Whether it is in an article, and whether it holds one, or is one or the body.
        self.inside = parent is not None and (parent.inside or parent.tag in MAIN)
        self.holds = tag in MAIN or tag in ("body", "html", "root")
        self.depth = parent.depth + 1 if parent else 0
        self.parts: list[str] = []
        self.children: list[Node] = []
        self.linked = self.size = self.links = self.tags = self.last = 0

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def parse(page: str) -> list[Node]:
    """The nodes of a page in page order, the root first; leaves have the tag ``text``.

    Comments, scripts and other raw elements are left out, and buttons, drawings and other
    hidden elements with all in them, if their own end tag or a slash closes them. One that
    is never closed is a node like others, so what stands behind it is not lost; so is a
    title or text area. A paragraph, list item or cell ends where the next one or an outer
    element does; a tag that the page's end cuts off is not text.
    """
    root = Node("root", (), None)
    nodes, stack, links, at = [root], [root], 0, 0
    leaf: Node | None = None
    hidden: dict[int, tuple] = {}  # where an open hidden element began, and the leaf and links around it
    endless: set[str] = set()  # raw elements without an end tag in the rest of the page

    def add_text(raw: str) -> None:
        nonlocal leaf
        if leaf is None:
            if not raw.strip():
                return
            leaf = Node("text", (), stack[-1])
            stack[-1].children.append(leaf)
            nodes.append(leaf)
        leaf.parts.append(raw)
        if links:
            leaf.linked += len(raw)

    while found := TOKEN.search(page, at):
        if found.start() > at:
            add_text(page[at : found.start()])
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag, closing = tag.lower(), found["close"]
        empty = not closing and found["attrs"].endswith("/") and not UNQUOTED_END.search(found["attrs"])
        if tag in RAW and not closing:
            if empty:
                continue
            end = None if tag in endless else RAW_END[tag].search(page, at)
            if end or tag in ("script", "style"):
                at = end.end() if end else len(page)
                continue
            endless.add(tag)
        if tag in HIDDEN:
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        first, leaf, links = hidden[id(stack[i])]
                        del nodes[first:], stack[i:]
                        stack[-1].children.pop()
                        break
            elif not empty:
                node = Node(tag, (), stack[-1])
                hidden[id(node)] = len(nodes), leaf, links
                leaf, links = None, 0
                stack[-1].children.append(node)
                nodes.append(node)
                stack.append(node)
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if closing else 1
            continue
        if tag == "br":
            add_text(" ")
            continue
        leaf, links = None, 0
        if tag in EMPTY:
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        ends = CLOSED_BY.get(tag, set()) | {"p"}
        while stack[-1].tag in ends:
            stack.pop()
        if tag in CLOSED_BY:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in HOLDERS or stack[i].tag in HIDDEN:
                    break
                if stack[i].tag in ends:
                    del stack[i:]
                    break
        tokens = names = ()
        if found["attrs"] and "=" in found["attrs"]:
            names = tuple((a or b or c).lower().strip() for a, b, c in CLASSES.findall(found["attrs"]))
            tokens = tuple(t for t in re.split(r"[^a-z0-9]+", " ".join(names)) if t)
        node = Node(tag, tokens, stack[-1], names)
        stack[-1].children.append(node)
        nodes.append(node)
        stack.append(node)
    if at < len(page):
        add_text(page[at:])
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if node.tag == "text":
            node.size, node.links = sum(map(len, node.parts)), node.linked
        else:
            for child in node.children:
                node.holds = node.holds or child.holds
                node.size += child.size
                node.links += child.links
                node.tags += child.tags + (child.tag != "text")
    return nodes


def named(node: Node) -> list[str]:
    """The names that say as a whole that a node is not main text: its element, class, id or role."""
    own = [n for n in node.names if n in NEVER_TOKENS]
    return [*own, node.tag] if node.tag in NEVER or node.tag == "header" and not node.inside else own


def forbidden(nodes: list[Node]) -> list[bool]:
    """Whether a node is never main text, whatever the trees say.

    It is so by a whole name only, never if the node holds an article or the body, and not if the
    page has more text under that name than elsewhere. All else is left to the trees.
    """
    whole: dict[str, int] = {}
    for node in nodes:
        for name in named(node):
            whole[name] = whole.get(name, 0) + node.size
    most = MOST_FORBIDDEN * nodes[0].size
    return [not node.holds and any(whole[name] <= most for name in named(node)) for node in nodes]


_TOKEN_AT = {t: i for i, t in enumerate(sorted(NEVER_TOKENS))}
FEATURES = 2 * len(TAGS) + TOKEN_BUCKETS + 13 + len(_TOKEN_AT) + 4
_TAG_AT = {t: i for i, t in enumerate(TAGS)}


def kind_of(tag: str) -> int:
    if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
        tag = "h"
    return _TAG_AT.get(tag, -1)


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node: its element and its parent's, attribute tokens, depth, size, densities,
    how it stands among its siblings, and to articles and to what seldom is main text above it."""
    out = np.zeros((len(nodes), FEATURES), "float32")
    base = 2 * len(TAGS) + TOKEN_BUCKETS
    whole = max(1, nodes[0].size)
    index = {id(n): i for i, n in enumerate(nodes)}
    own = base + 13 + len(_TOKEN_AT)
    for i, node in enumerate(nodes):
        row, parent = out[i], node.parent
        if parent:
            row[own] = out[index[id(parent)], own]
        marks = [_TOKEN_AT[t] for t in node.tokens if t in _TOKEN_AT]
        for k in marks:
            row[base + 13 + k] = 1
        if named(node) and not node.holds:  # told to all below: the share of the text outside of the nearest such node
            row[own] = 1 - node.size / whole
        row[own + 1] = len(marks)
        row[own + 2] = node.inside
        row[own + 3] = node.holds
        if (k := kind_of(node.tag)) >= 0:
            row[k] = 1
        if parent and (k := kind_of(parent.tag)) >= 0:
            row[len(TAGS) + k] = 1
        for token in node.tokens:
            row[2 * len(TAGS) + zlib.crc32(token.encode()) % TOKEN_BUCKETS] = 1
        row[base] = node.depth
        row[base + 1] = math.log1p(node.size)
        row[base + 2] = node.size / whole
        row[base + 3] = node.links / node.size if node.size else 0
        row[base + 4] = math.log1p(node.size / (node.tags + 1))
        row[base + 5] = len(node.children)
        row[base + 6] = node.tags
        if node.tag == "text":
            text = node.parts[0] if len(node.parts) == 1 else "".join(node.parts)
            row[base + 7] = math.log1p(text.count(" "))
            row[base + 8] = (text.count(".") + text.count(",")) / (len(text) + 1)
        if parent:
            row[base + 9] = node.size / parent.size if parent.size else 0
            row[base + 10] = len(parent.children)
            row[base + 12] = parent.links / parent.size if parent.size else 0
    for node in nodes:
        n = len(node.children)
        for place, child in enumerate(node.children):
            out[index[id(child)], base + 11] = place / n
    return out


class Tree(NamedTuple):
    feature: np.ndarray  # -1 in leaves
    at_most: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray


class Model(NamedTuple):
    trees: list[Tree]
    mixed: float  # log probability of a mixture for a node with children

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for tree in self.trees:
            at = np.zeros(len(rows), "int32")
            for _ in range(DEPTH):
                feature = tree.feature[at]
                goes_left = rows[every, feature] <= tree.at_most[at]
                at = np.where(feature < 0, at, np.where(goes_left, tree.left[at], tree.right[at]))
            total += tree.value[at]
        return 2 * total


def decode(nodes: list[Node], odds: np.ndarray, mixed: float) -> list[bool]:
    """Whether each node is kept, by the likeliest labels that do not contradict each other.

    A node is main text with all below it, or nothing below it is, or, with children, it is a
    mixture and each child is free. Forbidden nodes take their subtree along.
    """
    keep = -np.logaddexp(0, -odds)
    drop = -np.logaddexp(0, odds)
    n = len(nodes)
    at = {id(node): i for i, node in enumerate(nodes)}
    part = np.full(n, -np.inf)
    never = forbidden(nodes)
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        if node.children:
            own = [at[id(c)] for c in node.children]
            part[i] = mixed + sum(max(keep[c], drop[c], part[c]) for c in own)
            keep[i] += sum(keep[c] for c in own)
            drop[i] += sum(drop[c] for c in own)
        if never[i]:
            keep[i] = part[i] = -np.inf
    kept = [False] * n
    state = ["m"] * n  # of the parent: a(ll), n(othing) or m(ixture)
    for i, node in enumerate(nodes):
        above = state[at[id(node.parent)]] if node.parent else "m"
        if above != "m":
            state[i] = above
        else:
            state[i] = max((part[i], "m"), (keep[i], "a"), (drop[i], "n"))[1]
            if not node.children and state[i] == "m":
                state[i] = "n"
        kept[i] = state[i] == "a"
    return kept


def main_texts(pages: list[str], model: Model) -> list[str]:
    """The main text of each page: kept leaves in page order, one line each."""
    parsed = [parse(page) for page in pages]
    if not parsed:
        return []
    odds = model.log_odds(np.concatenate([features(nodes) for nodes in parsed]))
    out, at = [], 0
    for nodes in parsed:
        kept = decode(nodes, odds[at : at + len(nodes)], model.mixed)
        at += len(nodes)
        lines = [node.text() for node, stays in zip(nodes, kept, strict=True) if stays and node.tag == "text"]
        out.append("\n".join(line for line in lines if line))
    return out


def labelled_nodes(page: str, article: str) -> list[tuple[list[float], float]]:
    """Features and labels of a page's nodes whose text is known to be of the article or not.

    A leaf of 20 or more characters is main text if the article has it. A shorter one
    that the article has too could be chance and is left out, as are mixtures.
    """
    nodes = parse(page)
    known = " ".join(article.split())
    yes, no = {}, {}
    for node in reversed(nodes):
        if node.tag == "text":
            text = node.text()
            found = text in known
            yes[id(node)] = len(text) if found and len(text) >= 20 else 0
            no[id(node)] = 0 if found else len(text)
        else:
            yes[id(node)] = sum(yes[id(c)] for c in node.children)
            no[id(node)] = sum(no[id(c)] for c in node.children)
    rows = features(nodes)
    out = []
    for i, node in enumerate(nodes):
        a, b = yes[id(node)], no[id(node)]
        if a + b and min(a, b) <= 0.02 * (a + b):
            out.append((rows[i].tolist(), float(a > b)))
    return out


def train(pages: DataFrame, html_col: str, article_col: str, order: Column) -> Model:
    """Trees fitted on the first ``TRAIN_PAGES`` rows by ``order`` that have a page and its article.

    The rows are chosen and their nodes labelled in Spark; Spark ML fits the trees, of
    which only the nodes reach the driver. Without usable rows there are no trees, and
    only what is never main text is left out.
    """
    ship_package(pages.sparkSession)
    rows = pages.where(F.col(html_col).isNotNull() & F.col(article_col).isNotNull())
    rows = rows.orderBy(order).limit(TRAIN_PAGES).select(
        F.col(html_col).alias("page"), F.col(article_col).alias("article"))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [x for p, a in zip(batch["page"], batch["article"], strict=True) for x in labelled_nodes(p, a)]
            yield pd.DataFrame(found, columns=["row", "label"])

    known = durable(rows.mapInPandas(label, "row array<double>, label double"))
    if known.select("label").distinct().count() < 2:
        return Model([], -1.0)
    vectors = known.select(array_to_vector("row").alias("features"), "label")
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=1, subsamplingRate=1.0).fit(vectors)
    trees = [flat(t._call_java("rootNode"), w) for t, w in zip(fitted.trees, fitted.treeWeights, strict=True)]
    return Model(trees, -1.0)


def flat(root, weight: float) -> Tree:
    rows: list[list] = []

    def add(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, 0, 0, node.prediction() * weight])
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            rows[at][:2] = [split.featureIndex(), split.threshold()]
            rows[at][2], rows[at][3] = add(node.leftChild()), add(node.rightChild())
        return at

    add(root)
    columns = list(zip(*rows, strict=True))
    return Tree(*(np.array(c, t) for c, t in zip(columns, ("int32", "float64", "int32", "int32", "float64"), strict=True)))


def extract_text(
    df: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """page_id, url, text and n_chars of each page, from its whole html.

    White space inside a block is one space, blocks are lines. A null or empty page, or one
    without main text, has the empty text. Repeated rows each get their own result, an
    empty table none; columns other than the three named are not read.
    """
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list[str] = []
            for at in range(0, len(batch), 200):
                out.extend(main_texts(list(batch[at : at + 200]), shared.value))
            yield pd.Series(out, dtype=object)

    found = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                      text(F.coalesce(F.col(html_col), F.lit(""))).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
