"""Main text of web pages by tree scoring.

Every page is parsed into a tree of block containers. A paragraph scores by length and commas, its parent gets the
points and its grandparent half of them; a container's points are discounted by its link density. The best container
and those siblings that score close to it, or are prose, headings, lists, quotes or tables of their own, are kept; beside an article, articles
that score close to it. A form is furniture unless its paragraphs hold more prose than the rest of the page. Pages are independent of each other,
so the work is one map over Arrow batches without a shuffle.

Null or empty html gives the empty text. Repeated rows give repeated results; other columns pass through untouched.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
                   "sub sup time tt u var wbr".split())
#: Elements whose content is never article text.
SKIPPED = frozenset("nav header footer aside script style noscript template iframe object svg math button select textarea input dialog menu "
                    "head title canvas audio video".split())
#: Words of class, id and role values that mark page furniture, adverts, notices and comments.
FURNITURE = frozenset("ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion sidebar side menu nav navbar navigation "
                      "breadcrumb breadcrumbs header masthead footer foot cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
                      "subscription signup login comment comments disqus respond reply replies share sharing social related recommended widget toolbar "
                      "pagination pager hidden contentinfo complementary search".split())
#: A name with one of these words speaks of furniture somewhere else, or of a state.
MODIFIERS = frozenset("has have no not non with without is show hide overflow open opened closed active fixed sticky enabled disabled visible layout".split())
SIBLINGS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure figcaption".split())
#: Why a block is left out: by its tag, or by its class, id, role or style, which prose may overrule.
SOFT, HARD = 1, 2
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
                     "section table ul".split())
#: Elements that hold text themselves: their names mark furniture only where at least half of the words do.
TEXTUAL = frozenset("p li dd dt blockquote pre td th h1 h2 h3 h4 h5 h6 figcaption".split())
PARAGRAPHS = frozenset("p blockquote pre article main".split())
SPACE = re.compile(r"[\s\xa0]+")
NAME_PART = re.compile(r"[a-z]+")


class Node:
    """An element that is not inline: its text runs and child blocks in page order."""

    __slots__ = ("tag", "parent", "items", "link", "score", "skip", "own")

    def __init__(self, tag: str, parent: Node | None, skip: int = 0, own: int = 0):
        self.tag, self.parent, self.items, self.link, self.score, self.skip, self.own = tag, parent, [], 0, 0.0, skip, own


class Tree(HTMLParser):
    """Builds the tree; tolerant of unclosed and stray tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root", None)
        self.links = 0
        self.muted: list[str] = []
        self.open: Counter[str] = Counter()

    def handle_starttag(self, tag, attrs):
        if self.muted:
            if tag not in VOID:
                self.muted.append(tag)
            return
        if tag == "br" or tag == "hr":
            self.at.items.append(" ")
            return
        if tag in VOID:
            return
        if tag == "form" and self.open["form"]:
            return  # forms do not nest
        bad = HARD if tag in SKIPPED else max(SOFT if tag == "form" else 0, self.furniture(tag, attrs))
        if tag in INLINE:
            if bad:
                self.muted.append(tag)
            elif tag == "a":
                self.links += 1
            return
        if tag in CLOSES_P:
            self.close_block("p", ("div", "article", "section", "td", "li", "body", "main", "blockquote"))
            self.links = 0
        if tag == "li":
            self.close_block("li", ("ul", "ol", "menu"))
        elif tag in ("td", "th"):
            self.close_block("td", ("tr", "table")), self.close_block("th", ("tr", "table"))
        elif tag == "tr":
            self.close_block("tr", ("table", "tbody", "thead", "tfoot"))
        elif tag in ("dt", "dd"):
            self.close_block("dt", ("dl",)), self.close_block("dd", ("dl",))
        node = Node(tag, self.at, max(bad, self.at.skip), bad)
        self.at.items.append(node)
        self.at = node
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.muted:
            if tag in self.muted:
                while self.muted.pop() != tag:
                    pass
                return
            if tag in INLINE or not self.open[tag]:
                return
            self.muted.clear()  # an unclosed inline element ends with the block around it
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag not in INLINE and tag not in VOID:
            self.close_block(tag, ())

    def close_block(self, tag: str, stops: tuple[str, ...]) -> None:
        if not self.open[tag]:
            return
        node = self.at
        while node.tag != tag:
            if node.tag in stops:
                return
            node = node.parent
        while self.at is not node.parent:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_data(self, data):
        if self.muted or self.at.skip == HARD:
            return
        self.at.items.append(data)
        if self.links:
            self.at.link += len(data)

    @staticmethod
    def furniture(tag: str, attrs) -> int:
        if tag in ("html", "body", "article", "main"):
            return 0
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return HARD
            if name in ("class", "id", "role") and value and any(marks(token, tag in TEXTUAL) for token in value.split()):
                return SOFT
            if name == "style" and value and re.search(r"display\s*:\s*none", value, re.I):
                return HARD
        return 0


def marks(token: str, textual: bool = False) -> bool:
    """Whether one class, id or role names page furniture; modifier forms (has-sidebar, no-comments, overflow-hidden, hidden-xs) do not, nor do names
    of paragraphs and the like in which most words say something else (comment-on-law)."""
    words = NAME_PART.findall(token.lower())
    if not MODIFIERS.isdisjoint(words) or len(words) > 1 and "hidden" in words:
        return False
    named = sum(w in FURNITURE for w in words)
    return named > 0 and not (textual and 2 * named < len(words))


def walk(root: Node) -> list[Node]:
    """Nodes in page order, without recursion."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.skip:
            continue
        out.append(node)
        stack.extend(x for x in reversed(node.items) if not isinstance(x, str))
    return out


def own_text(node: Node) -> str:
    return SPACE.sub(" ", "".join(x for x in node.items if isinstance(x, str))).strip()


def blocks(node: Node) -> list[str]:
    """Texts of the blocks under a node in page order; a run between two child blocks is a block."""
    out, run = [], []
    stack = [iter(node.items)]

    def flush():
        text = SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    while stack:
        item = next(stack[-1], None)
        if item is None:
            flush()
            stack.pop()
        elif isinstance(item, str):
            run.append(item)
        elif not item.skip:
            flush()
            stack.append(iter(item.items))
    flush()
    return out


def prose(node: Node) -> int:
    """Characters outside links under a node, without blocks left out for a reason of their own."""
    total, stack = 0, [node]
    while stack:
        at = stack.pop()
        total += max(0, len(own_text(at)) - at.link)
        stack.extend(x for x in at.items if not isinstance(x, str) and not x.own)
    return total


def paragraphs(form: Node) -> int:
    """Prose of the paragraphs in a form: labels and captions of its fields do not make it the content of a page."""
    total, stack = 0, [form]
    while stack:
        for x in stack.pop().items:
            if not isinstance(x, str) and not x.own:
                if x.tag in PARAGRAPHS:
                    total += prose(x)
                else:
                    stack.append(x)
    return total


def overruled(root: Node) -> Node:
    """The root to read from: blocks left out by their names come back where they hold more prose than all that is left.

    A page whose article or main has text already stays as it is. An article or main inside such a block is read alone.
    """
    inside, soft, stack = [], [], [root]
    while stack:
        node = stack.pop()
        if node.own == SOFT:
            soft.append(node)
        if node.tag in ("article", "main"):
            inside.append(node)
        stack.extend(x for x in node.items if not isinstance(x, str) and x.skip != HARD)
    if not soft or any(not x.skip and prose(x) for x in inside):
        return root
    sizes = [(paragraphs(x) if x.tag == "form" else prose(x), x.tag in ("article", "main"), x) for x in soft + [x for x in inside if x.skip]]
    # of blocks with the same prose, an article or main stands for the block around it
    size, whole, best = max(sizes, key=lambda s: s[:2])
    if size <= prose(root):
        return root
    up = best
    while up is not None and not whole:
        up.skip, up = 0, up.parent
    stack = [best]
    while stack:
        node = stack.pop()
        node.skip = 0
        stack.extend(x for x in node.items if not isinstance(x, str) and not x.own)
    return best if whole else root


def main_text(page: str | None) -> str:
    """The article text of one page."""
    if not page:
        return ""
    tree = Tree()
    tree.feed(page)
    HTMLParser.close(tree)
    root = overruled(tree.root)
    nodes = walk(root)
    length, link = {}, {}
    for node in reversed(nodes):
        own = own_text(node)
        kids = [x for x in node.items if not isinstance(x, str) and not x.skip]
        length[node] = len(own) + sum(length[k] for k in kids)
        link[node] = min(length[node], node.link + sum(link[k] for k in kids))
        if own and node.parent is not None:
            points = 1 + own.count(",") + own.count("،") + own.count("、") + min(len(own) / 100, 3)
            points *= 1 - min(1, node.link / len(own))
            up = node.parent if node.tag in ("p", "pre", "td", "li", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt") else node
            up.score += points
            if up.parent is not None:
                up.parent.score += points / 2
    for node in nodes:
        node.score *= 1 - (link[node] / length[node] if length[node] else 0)
    if not any(length.values()):
        return ""
    best = max(nodes, key=lambda n: n.score)
    # a section of an article is not the whole of it: the enclosing article or main element stands for the container
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    best = up or best
    if best.parent is None or best.tag in ("html", "body", "main"):
        kept = [best]
    elif best.tag == "article":
        # articles side by side are parts of one page as far as they score; cards of links lose their points
        limit = max(10.0, 0.2 * best.score)
        kept = [x for x in best.parent.items if not isinstance(x, str) and not x.skip and (x is best or x.tag == "article" and x.score >= limit)]
    else:
        limit = max(10.0, 0.2 * best.score)
        kept = []
        for x in best.parent.items:
            if isinstance(x, str) or x.skip:
                continue
            prose = x.tag in SIBLINGS and length[x] and link[x] / length[x] < 0.25
            if x is best or x.score >= limit or prose:
                kept.append(x)
    return " ".join(t for node in kept for t in blocks(node))


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add column ``out`` with the main text."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    return pages.withColumn(out, run(F.col(html)))
