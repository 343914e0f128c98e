"""Operator 1: main text of a page by composite text density.

Every node of the page's tree gets a density: its text characters per tag, adjusted for
the share that lies in links. The formula has no value where the whole body has no link;
there the density is the plain one, characters per tag. A node's sum is that of the
densities of its children, its direct text being one of them, and the subtree with the
largest sum is the article. The least density on the path from the body to it is the
threshold; link-heavy parts inside the article below it are dropped. Menus, forms,
adverts and the like are cut off before, by element and by class name.
"""

from __future__ import annotations

import html as markup
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<[!?][^>]*(?:>|$)", re.S
)
NAMED = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br img".split()
)
#: Elements whose text never belongs to an article.
FOREIGN = RAW | frozenset("head nav header footer aside form button select option menu dialog object canvas video audio".split())
#: Class, id and role words of parts that do not belong to an article.
FOREIGN_NAMES = frozenset(
    """ad ads advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu
    breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo comment comments reply
    replies disqus cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription
    share sharing social related recommended recommendations pagination pager toolbar login signup search skip
    hidden""".split()
)
#: Start tags that end an open paragraph, and kinds that end an open one of their own kind.
ENDS_P = frozenset(
    """address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p
    pre section table ul""".split()
)
SELF_ENDING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table body html div article section".split())


class Node:
    __slots__ = ("tag", "parent", "children", "foreign", "chars", "link_chars", "tags", "link_tags", "density", "total", "own")

    def __init__(self, tag: str, parent: Node | None, foreign: bool) -> None:
        self.tag, self.parent, self.foreign = tag, parent, foreign
        self.children: list[Node | str] = []
        self.chars = self.link_chars = self.tags = self.link_tags = self.own = 0
        self.density = self.total = 0.0


#: Names that inside an article belong to it: its own head holds its title.
HEADS = frozenset(("header", "masthead", "banner"))


def foreign_name(attributes: str, inside: bool) -> bool:
    for match in NAMED.finditer(attributes):
        value = match.group(1) or match.group(2) or match.group(3) or ""
        words = re.split(r"[\s_\-]+", value.lower())
        if any(word in FOREIGN_NAMES and not (inside and word in HEADS) for word in words):
            return True
    return "hidden" in attributes and re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes) is not None


def parse(page: str) -> Node:
    """The tree of a page; unclosed and misplaced tags are mended as browsers do, in short."""
    root = Node("html", None, False)
    stack, at = [root], 0
    # Open elements by name, so that no tag searches the stack for what is not there.
    opened: Counter[str] = Counter()
    lower = None

    def end_from(depth: int) -> None:
        opened.subtract(node.tag for node in stack[depth:])
        del stack[depth:]

    while True:
        match = TOKEN.search(page, at)
        text = page[at : match.start()] if match else page[at:]
        if text:
            stack[-1].children.append(text)
        if not match:
            return root
        at = match.end()
        name = match.group(2)
        if not name:
            continue
        name = name.lower()
        if match.group(1):
            if opened[name] > 0:
                depth = len(stack) - 1
                while stack[depth].tag != name:
                    depth -= 1
                end_from(depth)
            continue
        if name in ("html", "body"):
            continue
        if name in ENDS_P and opened["p"] > 0:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    end_from(depth)
                    break
                if stack[depth].tag not in INLINE:
                    break
        if any(opened[kind] > 0 for kind in SELF_ENDING.get(name, ())):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in SELF_ENDING[name]:
                    end_from(depth)
                    break
                if stack[depth].tag in SCOPES:
                    break
        parent = stack[-1]
        attributes = match.group(3) or ""
        foreign = parent.foreign or name in FOREIGN
        if not parent.foreign and (attributes or name == "header"):
            inside = opened["article"] > 0 or opened["main"] > 0
            foreign = name in FOREIGN and not (inside and name == "header") or foreign_name(attributes, inside)
        node = Node(name, parent, foreign)
        parent.children.append(node)
        if name in RAW and not attributes.rstrip().endswith("/"):
            if lower is None:
                lower = page.lower()
            end = lower.find(f"</{name}", at)
            if end < 0:
                end = len(page)
            close = page.find(">", end)
            at = close + 1 if close >= 0 else len(page)
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(node)
            opened[name] += 1


def body_figures(root: Node) -> tuple[int, int]:
    """Characters of the whole body and those of its links, menus and other foreign parts included."""
    chars = links = 0
    todo = [(root, False)]
    while todo:
        node, linked = todo.pop()
        linked = linked or node.tag == "a"
        for child in node.children:
            if child.__class__ is str:
                size = len(child.strip())
                chars += size
                links += size if linked else 0
            elif child.tag != "head":
                todo.append((child, linked))
    return chars, links


def measure(root: Node) -> list[Node]:
    """All nodes, parents first, with their characters, tags, densities and sums."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and not c.foreign]
    for node in reversed(nodes):
        own = sum(len(c.strip()) for c in node.children if c.__class__ is str)
        node.own, node.chars = own, node.chars + own
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags
    body_chars, body_links = body_figures(root)
    share = body_links / max(body_chars, 1)

    def density(chars: int, link_chars: int, tags: int, link_tags: int) -> float:
        tags = max(tags, 1)
        if not body_links:
            return chars / tags
        value = chars / max(link_chars, 1) * tags / max(link_tags, 1)
        if value <= 1:
            return 0.0
        base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
        return chars / tags * math.log(value) / math.log(base)

    for node in reversed(nodes):
        node.density = density(node.chars, node.link_chars, node.tags, node.link_tags)
        node.total += density(node.own, 0, 0, 0)
        if node.parent is not None:
            node.parent.total += node.density
    return nodes


def article(nodes: list[Node]) -> tuple[Node, float]:
    """The container with the largest sum, and the least density between it and the body."""
    holders = [
        n
        for n in nodes
        if n.tag not in INLINE and any(isinstance(c, Node) and not c.foreign and c.tag not in INLINE for c in n.children)
    ]
    best = max(holders, key=lambda n: n.total, default=nodes[0])
    threshold, node = best.density, best.parent
    while node is not None:
        threshold, node = min(threshold, node.density), node.parent
    return best, threshold


def blocks(node: Node, threshold: float) -> list[str]:
    """Texts of the blocks below ``node`` in page order."""
    out: list[str] = []
    parts: list[str] = []

    def end() -> None:
        text = SPACE.sub(" ", markup.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = [node]
    while todo:
        item = todo.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            parts.append(item)
        elif item.foreign:
            continue
        elif item.tag in ("br", "img", "wbr"):
            parts.append(" " if item.tag == "br" else "")
        else:
            linked = item.link_chars * 2 > item.chars and item.density < threshold and item.tag not in INLINE
            if linked and item is not node:
                continue
            if item.tag not in INLINE:
                end()
                todo.append(None)
            todo += reversed(item.children)
    end()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes = measure(parse(page))
    if not nodes[0].chars:
        return ""
    best, threshold = article(nodes)
    return "\n\n".join(blocks(best, threshold))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; a null or textless page has an empty text.

    Rows are independent: repeated rows give repeated rows, an empty table gives none, and
    other columns are not read. A page is parsed as a whole, in time linear
    in its length unless a tag holds a quote that is never closed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
