"""Main text of web pages by tree scoring.

A page becomes a tree (unclosed paragraphs, list items and cells end where the next block begins). Parts that are never
article text go: scripts, styles, forms, navigation, page headers and footers, asides, hidden parts, and elements whose role
says menu, banner, dialog and the like. An element whose class or id says advert, notice, sidebar, comments and so on goes
too (an <article> only if it is named a comment and lies in another one), unless it holds most of the page's paragraph points, or an <article> or <main> that is not so named, and there is no other
<article> or <main> with text. Names that tell a state (has-sidebar, comments-open) don't count. Each remaining paragraph gives points for
its length and commas to its nearest LEVELS ancestors: all to the parent, half to the next, a third of a half to the one above, and so on;
a container's points are then discounted by the share of its text that lies in links. (The constants, a point and one for each
comma and each 100 characters up to three, 25 characters at least, are those published with the Readability reader-mode script.) The container with most points is
the article, or the <article>/<main> element around it if there is one. Siblings with a fair share of the points are kept too: of an
<article> its sibling articles, without such an element all siblings, and long sibling paragraphs with few links. A page on which nothing scores gives
its <article>, <main> or <body>.

Null and empty pages give an empty text. Text is never cut: white space in a block becomes one space, blocks are joined
in page order by one space. Time and memory grow in proportion to a page's length, however deep its elements nest (about 1 kB an
element). Of containers with equal points the first in a depth-first walk from the end is taken. Repeated rows give equal rows; an
empty table gives an empty result. All other input columns pass through, except `text` and
`n_chars`, which are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import widened

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
GONE = frozenset(
    "aside button canvas dialog fieldset footer form frame frameset head iframe input map menu nav noscript object optgroup option script select style svg template textarea title".split()
)
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("article aside body blockquote div dl fieldset footer form header html main nav ol section table tbody td th ul".split())
PARAGRAPH = frozenset("p pre blockquote td dd li div section article main body".split())
ROOTS = frozenset("html body article main".split())
UNWANTED_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
UNWANTED = frozenset(
    """ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline-ad comment comments
    commentlist consent cookie cookies dialog disclaimer disqus dropdown footer form gdpr header infobar login masthead menu
    menus message modal nav navbar navigation newsletter notice notification notifications outbrain pager pagination paywall
    popup privacy promo promoted promotion recommended related reply replies respond responses search share sharing shoutbox
    sidebar sidebars signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar tracking
    warning widget widgets""".split()
)
COMMENT = frozenset("comment comments commentlist disqus replies reply respond responses".split())
#: Ancestors that a paragraph gives points to.
LEVELS = 12
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Names that tell a state of the element, not what it is.
STATE = re.compile(r"(has|is|no|not|with|without|show|hide)[-_].*|.*[-_](open|closed|enabled|disabled|on|off|allowed)", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    __slots__ = ("tag", "parent", "children", "skip", "suspect", "comment", "points", "size", "linked")

    def __init__(self, tag: str, parent: "Node | None", skip: bool):
        self.tag, self.parent, self.skip, self.suspect, self.comment = tag, parent, skip, False, False
        self.children: list[Node | str] = []
        self.points, self.size, self.linked = 0.0, 0, 0


def unwanted(tag: str, attributes: list[tuple[str, str | None]], within_article: bool) -> bool:
    if tag in GONE or tag == "header" and not within_article:
        return True
    a = {k: v or "" for k, v in attributes}
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or HIDDEN.search(a.get("style", "").lower()):
        return True
    if tag in ROOTS:
        return False
    return a.get("role", "").lower() in UNWANTED_ROLE


def named_unwanted(attributes: list[tuple[str, str | None]], unwanted: frozenset[str] = UNWANTED) -> bool:
    """Whether the class or id says that this is no article text. Only what the element holds decides whether it goes."""
    names = " ".join(v or "" for k, v in attributes if k in ("class", "id")).split()
    return any(x.lower() in unwanted for name in names if not STATE.fullmatch(name) for x in PART.findall(name))


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, False)
        self.body = self.root
        self.articles = 0
        self.open: Counter[str] = Counter()
        self.suspects = False

    def climb(self, tags: set[str] | frozenset[str], scope: frozenset[str]) -> Node | None:
        """The nearest open element among tags, if no element of scope lies between."""
        if not any(self.open[t] for t in tags):
            return None
        node = self.at
        while node is not self.root:
            if node.tag in tags:
                return node
            if node.tag in scope:
                return None
            node = node.parent
        return None

    def close_to(self, node: Node) -> None:
        while self.at is not node.parent:
            self.articles -= self.at.tag == "article"
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if tag == "body" and self.at.tag == "head":
            self.close_to(self.at)
        if tag not in INLINE and (open_p := self.climb({"p"}, SCOPE)) is not None and tag not in VOID:
            self.close_to(open_p)
        if tag in ENDED_BY and (open_one := self.climb(ENDED_BY[tag], SCOPE - ENDED_BY[tag])) is not None:
            self.close_to(open_one)
        node = Node(tag, self.at, self.at.skip or unwanted(tag, attrs, self.articles > 0))
        if not node.skip and tag not in ("html", "body") and named_unwanted(attrs):
            node.suspect = self.suspects = True
            node.comment = tag == "article" and named_unwanted(attrs, COMMENT)
        self.at.children.append(node)
        if tag == "body" and self.body is self.root:
            self.body = node
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1
            self.articles += tag == "article"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in SCOPE and self.at.tag == tag and tag not in {"p"}:
            self.close_to(self.at)

    def handle_endtag(self, tag: str) -> None:
        stop = frozenset() if tag in SCOPE or tag == "head" else SCOPE
        if (node := self.climb({tag}, stop)) is not None:
            self.close_to(node)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def text_of(top: Node) -> str:
    """The text below top, with a space at the edges of blocks."""
    pieces: list[str] = []
    stack: list[Node | str] = [top]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            pieces.append(item)
        elif not item.skip:
            edge = [] if item.tag in INLINE else [" "]
            stack += [*edge, *reversed(item.children), *edge]
    return " ".join("".join(pieces).split())


def measure(order: list[Node]) -> None:
    """Give every node of a tree (parents first) its characters that are not white space, and those that lie in links."""
    for node in reversed(order):
        own = sum(len("".join(x.split())) for x in node.children if isinstance(x, str))
        node.size += own
        if node.tag == "a":
            node.linked = node.size
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.linked += node.linked


def link_density(node: Node) -> float:
    return node.linked / max(1, node.size)


def own_text(node: Node) -> str:
    """The text of node and its inline children, without that of blocks in it."""
    pieces, stack = [], [*reversed(node.children)]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            pieces.append(item)
        elif not item.skip and item.tag in INLINE:
            stack += reversed(item.children)
    return " ".join("".join(pieces).split())


def paragraph_points(node: Node) -> float:
    """The points that the node's own text gives: 0 if it is no paragraph."""
    if node.tag in PARAGRAPH and len(text := own_text(node)) >= 25:
        return 1 + text.count(",") + min(len(text) / 100, 3.0)
    return 0.0


def drop_suspects(root: Node) -> None:
    """Skip the elements below root that are named as unwanted and don't hold the article."""
    order: list[tuple[Node, bool]] = []
    stack = [(root, False)]
    while stack:
        node, below = stack.pop()
        if node.skip:
            continue
        # An <article> or <main> is not dropped for its own name, unless it is a comment within another.
        below = below or node.suspect and node.tag not in ROOTS
        order.append((node, below))
        stack += [(x, below) for x in node.children if isinstance(x, Node)]
    points: dict[Node, float] = {}
    texts: dict[Node, bool] = {}
    clean: dict[Node, bool] = {}
    holds: set[Node] = set()
    for node, below in reversed(order):
        points[node] = points.get(node, 0.0) + paragraph_points(node)
        said = any(isinstance(x, str) and bool(x.strip()) for x in node.children)
        texts[node] = texts.get(node, False) or said
        clean[node] = clean.get(node, False) or said and not below
        if node.tag in ("article", "main") and not node.suspect and texts[node]:
            holds.add(node)
        if node.parent is not None:
            points[node.parent] = points.get(node.parent, 0.0) + points[node]
            texts[node.parent] = texts.get(node.parent, False) or texts[node]
            clean[node.parent] = clean.get(node.parent, False) or clean[node]
            if node in holds:
                holds.add(node.parent)
    rivals = {node for node, _ in order if node.tag in ("article", "main") and not node.suspect and clean[node]}
    around: dict[Node | None, int] = {None: 0}  # rivals around a node, and itself
    for node, _ in order:
        above = around.get(node.parent, 0)
        around[node] = above + (node in rivals)
        if node.comment:
            node.skip = above > 0
        elif node.suspect and node.tag not in ROOTS:
            node.skip = above < len(rivals) or not (node in holds or 2 * points[node] > points[root])


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    if tree.suspects:
        drop_suspects(tree.root)
    order: list[Node] = []
    stack: list[Node] = [tree.root]
    while stack:
        node = stack.pop()
        if not node.skip:
            order.append(node)
            stack += [x for x in node.children if isinstance(x, Node)]
    measure(order)
    scored: list[Node] = []
    for node in order:
        if points := paragraph_points(node):
            above = node.parent if node.tag in ("p", "pre", "blockquote", "td", "dd", "li") else node
            for level in range(LEVELS):
                if above is None:
                    break
                if not above.points:
                    scored.append(above)
                above.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                above = above.parent
    if not scored:
        return text_of(max((x for x in order if x.tag in ("article", "main")), key=lambda x: x.size, default=tree.body))
    for node in scored:
        node.points *= 1 - link_density(node)
    best = max(scored, key=lambda x: x.points)
    around, node = None, best
    while node is not None:
        if node.tag == "article" or node.tag == "main" and around is None:
            around = node
        node = node.parent
    if best.parent is None or around is not None and (around.tag == "main" or around.parent is None):
        return text_of(around or best)
    top = around or best
    least = max(10.0, top.points * 0.2) if around is None else top.points * 0.2
    kept = []
    for x in top.parent.children:
        if x is top:
            kept.append(text_of(x))
        elif isinstance(x, Node) and not x.skip and (around is None or x.tag == "article" and not x.suspect):
            if x.points >= least or around is None and x.tag == "p" and link_density(x) < 0.25 and len(text_of(x)) > 80:
                kept.append(text_of(x))
    return " ".join(x for x in kept if x)


def extract(pages: DataFrame) -> DataFrame:
    """pages (a column html) with text and n_chars (code points), without html."""
    rest = pages.drop("text", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                others = [k for k in part.schema.names if k != "html"]
                columns = [*(part.column(k) for k in others), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*others, "text", "n_chars"])

    return rest.mapInArrow(run, widened(rest.drop("html"), "text string, n_chars long"))
