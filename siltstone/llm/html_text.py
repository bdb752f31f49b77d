"""Main text of web pages by composite text density.

A tolerant one-pass parser builds the element tree. Every element gets its composite text
density: characters per tag, adjusted by how much of it is link text, relative to the page.
Text of page furniture (elements such as nav or footer, and classes that name furniture)
counts as link text, so that its density is nothing. The element whose children's densities
sum highest is the content; the least density on its path to the body is the threshold that
subtrees beside that path have to come near to belong to it. Inside the content only furniture
goes; nothing else is dropped, whatever its density.

Scale: one pass, a page at a time, no shuffle; the parser is linear in the page.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import cluster

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption legend".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset("nav footer aside form menu dialog".split())
#: Never part of the text, wherever they stand.
UNSEEN = frozenset("head button select".split())
#: Elements a start tag closes when they are open: tag to those and to where the search stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
CLOSES_P = BLOCK - {"option", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "legend", "body", "html"}
#: What a class or id names: the last part of it that is no mere container or place.
_FURNITURE_NAME = frozenset(
    "ad ads advert adverts advertisement advertisements sponsor sponsored banner promo promotion cookie cookies consent notice popup modal overlay sidebar widget menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments disqus replies respond share sharing social related recommended recommendations newsletter subscribe signup login search pagination pager skip".split()
)
_CONTAINER_NAME = frozenset("list box wrapper wrap container area section block inner outer holder bar left right top bottom buttons links items form main content".split())
#: A block beside the content needs this share of its characters, and of the threshold (a heading lowers its density).
LEAST_SHARE, LEAST_DENSITY = 0.2, 0.6
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "marked", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, marked: bool = False):
        self.tag, self.parent, self.dropped, self.marked = tag, parent, dropped, marked
        self.children: list = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _tag_end(page: str, at: int) -> int:
    """Index after the tag that starts at ``at``; quoted values may hold ``>``. -1: the page ends in it."""
    end = page.find(">", at)
    if end < 0:
        return -1
    quote = page.find('"', at, end)
    single = page.find("'", at, end)
    if quote < 0 and single < 0:
        return end + 1
    i, n = at, len(page)
    m = _QUOTED.match(page, i, n)
    return m.end() if m else end + 1


_QUOTED = re.compile(r"<(?:[^>\"'=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+>")


class _Open:
    """The open elements; for each tag and for blocks the depths at which they are open."""

    def __init__(self, root: Node):
        self.path, self.depths, self.blocks, self.inside = [root], {}, [0], 0

    def push(self, node: Node) -> None:
        depth = len(self.path)
        self.path.append(node)
        self.depths.setdefault(node.tag, []).append(depth)
        if node.tag in BLOCK:
            self.blocks.append(depth)
        self.inside += node.tag in ("article", "main")

    def close(self, depth: int) -> None:
        """Close the element at ``depth`` and all in it."""
        while len(self.path) > depth:
            node = self.path.pop()
            self.depths[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()
            self.inside -= node.tag in ("article", "main")

    def last(self, tag: str) -> int:
        """The depth of the innermost open ``tag``; 0: none."""
        found = self.depths.get(tag)
        return found[-1] if found else 0

    def outermost(self, tags: set[str], below: int) -> int:
        """The depth of the outermost of ``tags`` that is open inside depth ``below``; 0: none."""
        out = 0
        for tag in tags:
            found = self.depths.get(tag, [])
            k = bisect.bisect_right(found, below)
            if k < len(found) and (not out or found[k] < out):
                out = found[k]
        return out


def parse(page: str) -> Node:
    """The tree below the document; text children are strings, already decoded."""
    root = Node("#root", None)
    opened, at, n = _Open(root), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        node = opened.path[-1]
        if lt < 0:
            node.children.append(html.unescape(page[at:]))
            break
        nxt = page[lt + 1 : lt + 2]
        if not (nxt.isascii() and nxt.isalpha() or nxt in ("/", "!", "?")) or not nxt:
            nl = page.find("<", lt + 1)
            nl = n if nl < 0 else nl
            node.children.append(html.unescape(page[at:nl]))
            at = nl
            continue
        if lt > at:
            node.children.append(html.unescape(page[at:lt]))
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if nxt in "!?":
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(page, lt + 1)
        end = _tag_end(page, lt)
        if end < 0:
            break
        at = end
        if not m:
            continue
        tag = m[1].lower()
        if nxt == "/":
            depth = opened.last(tag)
            # An inline end tag does not reach out of a block.
            if depth and (tag in BLOCK or depth > opened.blocks[-1]):
                opened.close(depth)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                node.children.append(" ")
            node.tags += 1
            continue
        if tag in RAW:
            close = _RAW_END[tag].search(page, at)
            end = page.find(">", close.start()) if close else -1
            at = n if end < 0 else end + 1
            continue
        if tag in CLOSES_P and opened.path[opened.blocks[-1]].tag == "p":
            opened.close(opened.blocks[-1])
        if tag in CLOSES:
            kinds, stops = CLOSES[tag]
            depth = opened.outermost(kinds, max(opened.last(s) for s in stops))
            if depth:
                opened.close(depth)
        attrs = page[m.end() : at - 1]
        child = Node(tag, opened.path[-1], tag in UNSEEN or bool(attrs and _HIDDEN.search(attrs)), _is_furniture(tag, attrs, opened.inside > 0))
        opened.path[-1].children.append(child)
        if not attrs.endswith("/") or tag in BLOCK or tag == "a":
            opened.push(child)
    return root


def _names_furniture(name: str) -> bool:
    """``site-footer`` and ``comment-list`` do, ``notice-board`` does not: its last part says what a thing is."""
    parts = [p for p in re.split(r"[-_]+", name.lower()) if p]
    while len(parts) > 1 and (parts[-1] in _CONTAINER_NAME or parts[-1].isdigit()):
        parts.pop()
    return bool(parts) and parts[-1] in _FURNITURE_NAME


def _is_furniture(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in FURNITURE:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    if tag == "header":  # a page's own, not an article's
        return not in_article
    return bool(attrs) and any(_names_furniture(name) for found in _ATTR.findall(attrs) for name in "".join(found).split())


def _seen(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node) and not c.dropped]


def _count(root: Node) -> list[Node]:
    """Characters and tags of all seen elements, children before parents in the result; furniture counts as links."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(_seen(node))
    order.reverse()
    holds = set()  # a form or a box around the whole page is no furniture
    for node in order:
        if node.tag in ("article", "main", "h1", "body") or id(node) in holds:
            holds.add(id(node.parent))
    for node in order:
        if id(node) in holds and node.tag not in ("nav", "footer", "aside", "header", "menu"):
            node.marked = False
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(_SPACE.sub(" ", c).strip())
            elif not c.dropped:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags
        if node.tag == "a" or node.marked:
            node.link_chars, node.link_tags = node.chars, node.tags + 1
    return order


def density(chars: int, tags: int, link_chars: int, link_tags: int, page_ratio: float) -> float:
    """Composite text density; ``page_ratio`` is the share of link text in the body."""
    plain = chars - link_chars
    if chars < 2 or plain <= 0:
        return 0.0
    tags = max(1, tags)
    base = math.log(chars / plain * link_chars + page_ratio * chars + math.e)
    return max(0.0, chars / tags * math.log(max(1.0, chars / max(1, link_chars) * tags / max(1, link_tags))) / base)


def _densities(order: list[Node], body: Node) -> None:
    page_ratio = body.link_chars / body.chars if body.chars else 0.0
    for node in order:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, page_ratio)
        # Inline elements are part of their block: only blocks are summed, so only what holds blocks can be chosen.
        node.total = sum(x.density for x in _seen(node) if x.tag in BLOCK)


def _best(body: Node) -> Node:
    """The element of the highest density sum. Where none comes to half of the body's, as on pages of a few words: the densest article, or the body."""
    best = article = None
    stack = _seen(body)
    while stack:
        node = stack.pop()
        if not node.marked:
            if best is None or node.total > best.total:
                best = node
            if node.tag in ("article", "main") and (article is None or node.total > article.total):
                article = node
            stack.extend(reversed(_seen(node)))
    if best is not None and best.total > 0 and 2 * best.total >= body.total:
        return best
    return article if article is not None and article.chars else body


def _content(body: Node) -> tuple[list[Node], set[int]]:
    """The subtrees that are the content, in page order; ids of the furniture in them."""
    best = _best(body)
    inside = best
    while inside is not body and inside.tag not in ("article", "main"):
        inside = inside.parent
    if inside is not body:  # an article is all of its parts, and what is beside it is none
        best = inside
    chosen = [best]
    if best is not body and inside is body:
        path, threshold = best, math.inf
        while path is not body:
            threshold = min(threshold, path.density)
            before, after, passed = [], [], False
            for x in _seen(path.parent):
                if x is path:
                    passed = True
                elif x.tag in BLOCK and not x.marked and x.density >= LEAST_DENSITY * threshold and x.chars >= LEAST_SHARE * best.chars:
                    (after if passed else before).append(x)
            heading = _heading_before(path)
            if heading is not None and heading not in before:
                before.append(heading)
            chosen = [*before, *chosen, *after]
            path = path.parent
    cut, stack = set(), list(chosen)
    while stack:
        for x in _seen(stack.pop()):
            if x.marked:
                cut.add(id(x))
            else:
                stack.append(x)
    return chosen, cut


def _heading_before(node: Node) -> Node | None:
    """The heading right before an element, which belongs to it."""
    around = [c for c in node.parent.children if isinstance(c, Node) and not c.dropped or isinstance(c, str) and c.strip()]
    k = around.index(node)
    return around[k - 1] if k and isinstance(around[k - 1], Node) and around[k - 1].tag in HEADING else None


def extract(page: str | None) -> str:
    """Main text of a page, one block a line; empty for null, empty or text-free pages."""
    if not page:
        return ""
    root = parse(page)
    order = _count(root)
    body = next((x for x in reversed(order) if x.tag == "body"), root)
    if body is not root and not body.chars:
        body = root
    _densities(order, body)
    chosen, cut = _content(body)
    blocks: list[str] = []
    line: list[str] = []

    def close():
        text = _SPACE.sub(" ", "".join(line)).strip()
        if text:
            blocks.append(text)
        line.clear()

    stack: list = [x for c in reversed(chosen) for x in (None, c, None)]
    while stack:
        node = stack.pop()
        if node is None:
            close()
        elif isinstance(node, str):
            line.append(node)
        elif not node.dropped and id(node) not in cut:
            if node.tag in BLOCK:
                close()
                stack.append(None)
            stack.extend(reversed(node.children))
    close()
    return "\n".join(blocks)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """Main text of ``pages(page_id, url, html)``: page_id, url, text, n_chars.

    Defined cases: a null or empty page, and one without text, gives an empty text. Null and
    repeated ids and urls pass through. Other columns are ignored. Markup may be broken or
    cut off anywhere; what follows an unfinished tag at the end is no text.
    """
    cluster.tune(pages.sparkSession)
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(_run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the main text of every page."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
