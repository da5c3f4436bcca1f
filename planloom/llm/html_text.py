"""Operator 4, HTML extraction by composite text density.

A page becomes a small tree of block and inline nodes. Each node's density is its characters per tag, lowered where much of
the text is link text; the sum of the children's densities scores a subtree. The subtree with the largest sum is the
candidate, and the smallest density on the path from the body down to it is the threshold above which other subtrees are
content as well.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without content, elements that break a line of text, and what a start tag closes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
         "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav",
         "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
        "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
#: Elements that hold no text of the article.
DROPPED = {"head", "script", "style", "noscript", "template", "nav", "aside", "footer", "form", "button", "select", "textarea", "iframe", "object", "svg",
           "canvas", "audio", "video", "dialog", "menu", "title"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "menu", "menubar", "toolbar", "form"}
#: Words of class and id that mark menus, headers, footers, sidebars, notices, adverts and comments.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies",
         "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar",
         "aside", "footer", "header", "masthead", "comment", "comments", "disqus", "respond", "share", "sharing", "social", "related", "recommended",
         "newsletter", "subscribe", "subscription", "signup", "login", "pagination", "pager", "widget", "toolbar", "skip", "hidden"}
NEVER_DROPPED = {"html", "body", "article", "main"}
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def is_boilerplate(tag: str, attrs: list, in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attrs or tag in NEVER_DROPPED:
        return False
    named = {k: v or "" for k, v in attrs}
    if "hidden" in named or named.get("aria-hidden") == "true" or named.get("role", "").lower() in ROLES:
        return True
    marks = f"{named.get('class', '')} {named.get('id', '')}"
    words = {w for w in WORD.findall(CAMEL.sub(" ", marks).lower())}
    return bool(words & MARKS) and not (in_article and words & {"header"} and not words & (MARKS - {"header"}))


class Tree(HTMLParser):
    """Builds the tree; end tags that HTML lets out are supplied, stray ones are ignored, an unfinished page is closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.open = ["html"]
        self.dropping = 0  # depth of open elements below a dropped one
        self.dropped: list[str] = []

    def handle_starttag(self, tag, attrs):
        if self.dropped:
            if tag not in VOID:
                if tag in ("article", "main", "body") and self.dropped[0] in ("head", "title", "noscript"):
                    self.dropped.clear()
                else:
                    if tag in SAME and self.dropped[-1] in SAME[tag] or tag in BLOCK and self.dropped[-1] == "p":
                        self.dropped.pop()
                    self.dropped.append(tag)
                    return
            else:
                return
        if tag in ("html", "body"):
            if tag == "body" and "body" not in self.open:
                self.push("body")
            return
        if tag in BLOCK:
            self.close_within("p", {"td", "th", "li", "div", "article", "section", "main", "body", "html", "blockquote", "dd", "table", "form", "fieldset"})
        if tag in SAME:
            for other in SAME[tag]:
                self.close_within(other, SCOPE.get(tag, {"table"}) | {"body", "html"})
        if is_boilerplate(tag, attrs, "article" in self.open or "main" in self.open):
            if tag not in VOID:
                self.dropped.append(tag)
            return
        if tag in VOID:
            if tag in ("br", "hr"):
                self.at.children.append(Node(tag, self.at))
            return
        self.push(tag)

    def push(self, tag):
        node = Node(tag, self.at)
        self.at.children.append(node)
        self.at = node
        self.open.append(tag)

    def close_within(self, tag, limits):
        """Closes an open ``tag`` unless one of ``limits`` was opened after it."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k] == tag:
                for _ in range(len(self.open) - k):
                    self.open.pop()
                    self.at = self.at.parent
                return
            if self.open[k] in limits:
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.dropped:
            if tag in self.dropped:
                while self.dropped.pop() != tag:
                    pass
            elif tag in ("body", "html", "article", "main") and tag in self.open:
                self.dropped.clear()  # an unclosed dropped element ends with what holds it
                self.handle_endtag(tag)
            return
        if tag in ("body", "html") or tag in VOID:
            return
        self.close_within(tag, set() if tag not in ("p", "li", "b", "i", "em", "strong", "a", "span", "font", "u", "small") else {"table", "article", "body"})

    def handle_data(self, data):
        if not self.dropped:
            self.at.children.append(data)


def bottom_up(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node))
    return out[::-1]


def measure(nodes: list[Node], body: Node) -> None:
    """Characters, tags, link characters and link tags of every node, then its composite density and its density sum.

    The published base of the logarithm, ln(... + e), is 1 for a page without links; 1 is added to keep it above that.
    """
    for node in nodes:
        for c in node.children:
            if isinstance(c, str):
                node.chars += len("".join(c.split()))
            else:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        plain, tags, links = node.chars - node.link_chars, max(1, node.tags), max(1, node.link_chars)
        if node.chars:
            base = 1 + math.log(node.chars / max(1, plain) * node.link_chars + share * node.chars + math.e)
            node.density = node.chars / tags * math.log(max(math.e, node.chars / links * tags / max(1, node.link_tags)), base)
        node.total = sum(c.density for c in node.children if isinstance(c, Node))


def content(root: Node) -> list[Node]:
    """The content subtrees, in page order."""
    nodes = bottom_up(root)
    body = next((c for c in root.children if isinstance(c, Node) and c.tag == "body"), root)
    measure(nodes, body)
    best: dict[int, Node] = {}  # of each subtree the node with the largest sum; equal sums go to the outer node
    for node in nodes:
        best[id(node)] = max([node, *(best[id(c)] for c in node.children if isinstance(c, Node))], key=lambda x: x.total)
    top = best[id(body)]
    threshold, node = top.density, top
    while node is not body and node.parent is not None:
        node = node.parent
        threshold = min(threshold, node.density)
    whole: dict[int, Node | None] = {}  # an article is whole: the outermost one that a node is in
    for node in reversed(nodes):
        whole[id(node)] = whole.get(id(node.parent)) or (node if node.tag in ("article", "main") else None)
    marked, stack = set(), [body]
    while stack:
        node = stack.pop()
        if node.density >= threshold and node.chars:
            found = best[id(node)] if best[id(node)].total > 0 else node
            marked.add(id(whole[id(found)] or found))
            if id(node) not in marked:  # as published: on into the children, but not below what is under the threshold
                stack.extend(c for c in node.children if isinstance(c, Node))
    picked, stack = [], [body]
    while stack:
        node = stack.pop()
        if id(node) in marked:
            picked.append(node)
        else:
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return picked


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below ``node``; white space within a block is one space."""
    out: list[list[str]] = [[]]
    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        elif x.tag == "br":
            out[-1].append(" ")
        else:
            if x.tag in BLOCK:
                out.append([])
                stack.append(None)
            stack.extend(reversed(x.children))
    return [t for t in (" ".join("".join(b).split()) for b in out) if t]


def main_text(html: str) -> str:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return "\n\n".join(t for node in content(tree.root) for t in blocks(node))


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` without ``html``, with ``text`` (the main text, empty if there is none) and ``n_chars`` (its code points).

    Null html counts as empty. Rows are kept as they are, repeated ones too; other columns named text and n_chars are
    replaced. Pages are parsed one at a time, whole, so memory follows the largest page.
    """
    kept = [c for c in df.columns if c not in (html, "text", "n_chars")]
    schema = df.select(*kept).withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column("_extract_html").to_pylist()]
            columns = [batch.column(c) for c in kept] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "text", "n_chars"])

    return df.select(*kept, F.col(html).alias("_extract_html")).mapInArrow(parse, schema)
