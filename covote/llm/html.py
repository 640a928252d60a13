"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. A block's features are its number of words and its
link density, those of the blocks before and after it, and what encloses it. The tree is grown from
the small labelled table below; blocks it calls content are joined in page order.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_START = r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)"
# A tag goes to the first > outside of quotes, or if quotes do not close, to the first > of all. Nothing is tried twice.
TOKEN = re.compile(_START + r"""(?:((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|([^>]*+)>)""", re.S)
UNQUOTED = re.compile(_START + r"()([^>]*+)>", re.S)
BROKEN = 8  # tags with open quotes, each of which is a look at the rest of the page; beyond that quotes mean nothing in a page
ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")

# Element names by what they do to text.
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head", "title", "textarea", "select", "button", "option"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
         "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main",
         "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CONTAINER = {"article", "aside", "body", "details", "dialog", "div", "fieldset", "figure", "footer", "form", "header", "main", "menu",
             "nav", "ol", "section", "table", "ul"}
MAIN = {"article", "main"}
CHROME = {"nav", "footer", "aside", "form", "menu", "dialog"}
CHROME_NAMES = {"ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
                "cookie", "cookies", "disqus", "footer", "form", "gdpr", "header", "legal", "login", "menu", "modal", "nav",
                "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promoted", "related", "replies",
                "reply", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe",
                "tags", "toolbar", "warning", "widget"}
MAIN_NAMES = {"article", "content", "entry", "main", "post", "story"}

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "in_chrome", "heading")
# The labelled table: the features in this order, then 1 for content. Pages hold menus, headers, notices,
# adverts, comments and footers around an article whose paragraphs may be short.
TABLE = np.array([
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0), (3, 1.0, 2, 1.0, 12, 0.0, 0, 1, 0, 0),
    (8, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0, 0), (14, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0, 0), (40, 0.0, 9, 0.0, 60, 0.0, 0, 1, 0, 0),
    (60, 0.1, 90, 0.0, 50, 0.0, 0, 1, 0, 0), (25, 0.0, 120, 0.0, 4, 0.5, 0, 1, 0, 0), (6, 0.3, 80, 0.0, 0, 0.0, 0, 1, 0, 0),
    (30, 0.0, 40, 0.0, 30, 0.0, 1, 1, 0, 0), (5, 0.0, 90, 0.0, 40, 0.0, 1, 1, 1, 0), (12, 0.0, 80, 0.0, 90, 0.0, 1, 1, 0, 0),
    (3, 1.0, 80, 0.0, 70, 0.0, 1, 1, 0, 0), (4, 0.0, 0, 0.0, 3, 1.0, 0, 1, 1, 0), (90, 0.0, 3, 1.0, 30, 0.0, 0, 1, 0, 0),
    (9, 0.0, 8, 0.0, 30, 0.0, 1, 0, 1, 1), (1, 0.0, 9, 0.0, 60, 0.0, 1, 0, 1, 1), (30, 0.0, 9, 0.0, 60, 0.0, 1, 0, 0, 1),
    (1, 0.0, 60, 0.0, 1, 0.0, 1, 0, 0, 1), (2, 0.0, 1, 0.0, 8, 0.2, 1, 0, 0, 1), (150, 0.0, 60, 0.0, 90, 0.0, 1, 0, 0, 1),
    (20, 0.2, 90, 0.0, 3, 0.0, 1, 0, 0, 1), (6, 0.0, 40, 0.0, 7, 0.1, 1, 0, 0, 1), (40, 0.5, 80, 0.0, 70, 0.0, 1, 0, 0, 1),
    (2, 1.0, 80, 0.0, 70, 0.0, 1, 0, 0, 1), (3, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1), (7, 0.0, 1, 1.0, 7, 0.0, 1, 0, 1, 1),
    (80, 0.0, 9, 0.0, 60, 0.0, 0, 0, 0, 1), (35, 0.0, 30, 0.0, 40, 0.0, 0, 0, 0, 1), (20, 0.0, 60, 0.0, 30, 0.0, 0, 0, 0, 1),
    (18, 0.1, 40, 0.0, 90, 0.0, 0, 0, 0, 1), (6, 0.0, 50, 0.0, 60, 0.0, 0, 0, 1, 1), (5, 0.0, 2, 1.0, 80, 0.0, 0, 0, 1, 1),
    (15, 0.0, 70, 0.0, 3, 0.3, 0, 0, 0, 1), (4, 0.0, 70, 0.0, 80, 0.0, 0, 0, 0, 1),
    (2, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0), (4, 0.8, 30, 0.0, 2, 1.0, 0, 0, 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0),
    (5, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0), (8, 0.6, 3, 0.9, 2, 1.0, 0, 0, 0, 0), (20, 0.9, 5, 0.9, 5, 0.9, 0, 0, 0, 0),
    (2, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0), (6, 0.4, 70, 0.0, 0, 0.0, 0, 0, 0, 0),
    (1, 0.0, 30, 0.0, 3, 1.0, 1, 0, 0, 1), (2, 0.0, 50, 0.0, 4, 0.8, 1, 0, 0, 1), (3, 0.0, 9, 0.0, 2, 1.0, 1, 0, 0, 1),
    (4, 0.0, 70, 0.0, 1, 1.0, 1, 0, 0, 1), (5, 0.0, 20, 0.0, 2, 1.0, 1, 0, 1, 1), (3, 0.5, 20, 0.0, 2, 1.0, 1, 0, 0, 1),
    (30, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0, 1), (4, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0, 1), (9, 0.0, 0, 0.0, 3, 1.0, 1, 0, 1, 1),
    (50, 0.0, 60, 0.0, 2, 1.0, 1, 0, 0, 1), (6, 0.0, 30, 0.0, 2, 1.0, 1, 0, 0, 1), (12, 1.0, 30, 0.0, 2, 1.0, 1, 0, 0, 1),
    (70, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 1), (45, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (60, 0.0, 60, 0.0, 2, 1.0, 0, 0, 0, 1),
    (25, 0.0, 4, 0.0, 2, 1.0, 0, 0, 0, 1), (12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (16, 0.1, 50, 0.0, 1, 1.0, 0, 0, 0, 1),
    (7, 0.0, 1, 1.0, 60, 0.0, 0, 0, 1, 1), (11, 0.0, 2, 1.0, 40, 0.0, 0, 0, 0, 1), (3, 0.0, 60, 0.0, 2, 1.0, 0, 0, 0, 0),
    (30, 0.0, 50, 0.0, 30, 0.0, 0, 1, 0, 0), (80, 0.0, 50, 0.0, 0, 0.0, 0, 1, 0, 0), (40, 0.0, 0, 0.0, 50, 0.0, 0, 1, 0, 0),
    (9, 0.7, 9, 0.7, 9, 0.7, 0, 0, 0, 0), (30, 0.8, 60, 0.0, 60, 0.0, 0, 0, 0, 0), (14, 0.9, 50, 0.0, 2, 1.0, 0, 0, 0, 0),
])


@dataclass(frozen=True)
class Node:
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None
    content: bool = False


def grow(table: np.ndarray, least: int = 2, depth: int = 6) -> Node:
    """A binary tree by the best Gini gain; ties go to the first feature and the lowest cut."""
    y = table[:, -1]
    leaf = Node(content=bool(y.mean() >= 0.5))
    if depth == 0 or y.min() == y.max() or len(y) < 2 * least:
        return leaf
    best, chosen = 1e-9, None
    whole = len(y) * y.mean() * (1 - y.mean())
    for f in range(table.shape[1] - 1):
        values = np.unique(table[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = table[:, f] <= cut
            if least <= low.sum() <= len(y) - least:
                parts = [y[low], y[~low]]
                gain = whole - sum(len(p) * p.mean() * (1 - p.mean()) for p in parts)
                if gain > best + 1e-12:
                    best, chosen = gain, (f, float(cut), low)
    if chosen is None:
        return leaf
    f, cut, low = chosen
    return Node(f, cut, grow(table[low], least, depth - 1), grow(table[~low], least, depth - 1))


def decide(tree: Node, features: tuple) -> bool:
    while tree.feature >= 0:
        tree = tree.low if features[tree.feature] <= tree.cut else tree.high
    return tree.content


@dataclass
class Block:
    text: str
    words: int
    links: float
    in_main: int
    in_chrome: int
    heading: int


def _names(attributes: str) -> set[str]:
    return {p.lower() for m in ATTRIBUTE.finditer(attributes) for p in NAME_PART.findall(m[1] or m[2] or m[3] or "")}


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; broken markup is read as far as it goes."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    link_depth = heading = 0
    stack: list[tuple[str, int, int]] = []  # container, is main, is chrome

    def text(s: str) -> None:
        nonlocal linked
        if s:
            s = html.unescape(s)
            parts.append(s)
            if link_depth:
                linked += len(s.split())

    def close() -> None:
        nonlocal parts, linked
        found = "".join(parts).split() if parts else ()
        if found:
            out.append(
                Block(" ".join(found), len(found), linked / len(found), int(any(c[1] for c in stack)), int(any(c[2] for c in stack)), int(heading > 0))
            )
        parts, linked = [], 0

    # behind the last > no tag ends, and a comment or declaration goes on to the end
    last = page.rfind(">") + 1
    at, end = 0, min((k for k in (page.find("<!", last), page.find("<?", last)) if k >= 0), default=len(page))
    token, broken = TOKEN, 0
    while at < end:
        m = token.search(page, at, last) if at < last else None
        if m is None:
            text(page[at:end])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break
            continue
        if m[4] is not None and token is TOKEN:
            broken += 1
            token = UNQUOTED if broken >= BROKEN else TOKEN
        closing, attributes = bool(m[1]), m[3] or m[4] or ""
        alone = attributes.endswith("/")
        if name in RAW and not closing and not alone:
            over = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = over.end() if over else end
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            link_depth = max(0, link_depth + (-1 if closing else 1))
        if name in BLOCK:
            close()
            link_depth = 0
            if len(name) == 2 and name[0] == "h" and name[1].isdigit():
                heading = 0 if closing else 1
        if name in CONTAINER or name in SILENT:
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            elif not alone:
                names = _names(attributes) if m[3] else set()
                inside = any(c[1] for c in stack)
                chrome = name in CHROME or name in SILENT or (name == "header" and not inside)
                chrome = chrome or (name != "body" and not names.isdisjoint(CHROME_NAMES) and not (name in MAIN and not inside))
                stack.append((name, int(name in MAIN or (name in ("div", "section") and not names.isdisjoint(MAIN_NAMES))), int(chrome)))
    close()
    return out


def features(found: list[Block]) -> list[tuple]:
    none = Block("", 0, 0.0, 0, 0, 0)
    padded = [none, *found, none]
    return [
        (b.words, b.links, p.words, p.links, n.words, n.links, b.in_main, b.in_chrome, b.heading)
        for p, b, n in zip(padded, padded[1:], padded[2:], strict=False)
    ]


def main_text(page: str | None, tree: Node) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, f in zip(found, features(found), strict=True) if decide(tree, f))


def extracted(pages: DataFrame, table: np.ndarray = TABLE) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row: the main text, empty for null or blank pages.

    Character references are decoded, white space within a block is one blank, blocks are joined by a
    line feed. Pages are read whole; ids and urls may be null or repeated; other columns are not read.
    """
    tree = grow(table)

    @F.pandas_udf("string")
    def extracting(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            yield pd.Series([main_text(p, tree) for p in some], dtype=object)

    found = pages.select("page_id", "url", extracting(F.col("html").cast("string")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
