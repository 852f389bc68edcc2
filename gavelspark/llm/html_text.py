"""Main text of web pages by composite text density.

Every node of a page's tree has a density: its characters for each tag, adjusted for links. A
node's density sum adds the densities of its children. The node with the largest sum holds the
main text; the least density on its path to the body is the threshold that other parts have to
reach to be text as well.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[\"'=])*+)>",
    re.S,
)
UNENDED = re.compile(r"<!--.*|<!\[CDATA\[.*", re.S)
ATTRIBUTE = re.compile(
    r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?", re.S
)
SPACE = re.compile(r"\s+")
TOKEN = re.compile(r"[a-z0-9]+")

# Fixed values of HTML: elements without content, with raw content, and those that end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "html body address article aside blockquote br caption center dd details dialog dir div dl dt"
    " fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main"
    " menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr"
    " ul".split()
)
#: What a start tag ends when it stands open, up to the nearest of the given containers.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select",)),
}
#: Never main text, by element, by role, and by a word of class or id.
NO_TEXT_TAGS = frozenset(
    "head script style noscript template iframe object embed svg canvas audio video map nav footer"
    " aside button input select textarea menu dialog search".split()
)
NO_TEXT_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar"
    " toolbar".split()
)
NO_TEXT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb"
    " breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer"
    " gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices"
    " overlay pagination pager popup promo promoted related reply replies respond share sharing"
    " sidebar sidebars skip social sponsor sponsored subscribe subscription toolbar topbar widget"
    " widgets".split()
)
#: What readers and advertisers write, of the words above.
OTHERS_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense comment comments commentlist cookie"
    " cookies consent gdpr disqus promo promoted replies reply respond sponsor sponsored".split()
)
#: What readers write, where a whole name says so: its words, and those that may stand with them.
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
COMMENT_PARTS = frozenset("area block body box container list reader readers section thread user users wrapper".split())
READERS = "#readers"
#: Elements that only hold others: one of little but links is a menu wherever it stands.
HOLDERS = frozenset("center details dir div dl fieldset menu ol section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: A part named by such a word goes if it holds no more of the body's text, or more of its own in links.
PART = 0.5
#: Whatever their class says, these are looked into.
KEPT = frozenset(("html", "body", "article", "main"))
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(eq=False)
class Node:
    tag: str
    parent: Node | None = None
    no_text: bool = False
    named: frozenset[str] = frozenset()
    children: list[Node | str] = field(default_factory=list)
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    density_sum: float = 0.0


def attributes(source: str) -> dict[str, str]:
    return {
        m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "")
        for m in ATTRIBUTE.finditer(source)
    }


def without_text(tag: str, source: str, framed: bool) -> bool:
    """Whether an element is a menu, header, footer, sidebar, notice, advert, form or comment;
    ``framed`` if it stands inside an article or main element."""
    if tag in NO_TEXT_TAGS:
        return True
    if tag == "header" and not framed:  # a heading's own header, inside an article, is text
        return True
    if not source.strip():
        return False
    found = attributes(source)
    if "hidden" in found or HIDDEN_STYLE.search(found.get("style", "")):
        return True
    if tag in KEPT:
        return False
    if found.get("role", "").lower() in NO_TEXT_ROLES or found.get("aria-hidden") == "true":
        return True
    return False


def doubts(tag: str, source: str) -> frozenset[str]:
    """Words of class, id, role and tag that speak against an element; its density decides."""
    if tag in KEPT:
        return frozenset()
    found = attributes(source) if source.strip() else {}
    named = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}")
    words = NO_TEXT_WORDS.intersection(TOKEN.findall(named.lower()))
    for name in named.lower().split():
        tokens = set(TOKEN.findall(name))
        if tokens & COMMENT_WORDS and tokens <= COMMENT_WORDS | COMMENT_PARTS:
            words |= {READERS}
    return words | {"form"} if tag == "form" or found.get("role", "").lower() == "form" else words


def parse(source: str) -> Node:
    """The page's tree. Ends that are left out are put in where HTML demands them."""
    root = Node("#root")
    path = [root]  # the open elements
    depths: dict[str, list[int]] = {}  # where elements of a name stand in it
    blocks_at: list[int] = []
    position, n = 0, len(source)
    last_end = source.rfind(">")

    def leave(depth: int) -> None:
        while len(path) > depth:
            tag = path.pop().tag
            depths[tag].pop()
            if tag in BLOCK:
                blocks_at.pop()

    def enter(node: Node) -> None:
        depths.setdefault(node.tag, []).append(len(path))
        if node.tag in BLOCK:
            blocks_at.append(len(path))
        path.append(node)

    def deepest(tag: str) -> int:
        found = depths.get(tag)
        return found[-1] if found else 0

    def close(tag: str, stop: tuple[str, ...] = ()) -> None:
        """Ends the element ``tag`` if it stands open inside the nearest container."""
        depth = deepest(tag)
        if depth and depth > max(map(deepest, stop), default=0):
            leave(depth)

    while position < n:
        # behind the last ">" only comments and sections that stay open can be markup
        m = (MARKUP if position <= last_end else UNENDED).search(source, position)
        text = source[position : m.start() if m else n]
        if text:
            path[-1].children.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        position = m.end()
        if m.re is UNENDED or not m[2]:
            if m[0].startswith("<![CDATA["):
                path[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            depth = deepest(tag)
            # an inline end tag does not close the block it stands in
            if depth and (tag in BLOCK or not blocks_at or blocks_at[-1] < depth):
                leave(depth)
            continue
        if tag in BLOCK and tag != "br":
            close("p", ("article", "section", "div", "td", "th", "li", "blockquote", "body"))
        if tag in ENDS:
            for open_tag in ENDS[tag][0]:
                close(open_tag, ENDS[tag][1])
        framed = bool(depths.get("article") or depths.get("main"))
        node = Node(tag, path[-1], without_text(tag, m[3], framed), doubts(tag, m[3]))
        path[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(source, position)
            position = end.end() if end else n
        elif tag not in VOID and (tag in BLOCK or not m[3].rstrip().endswith("/")):
            enter(node)  # a slash does not end an HTML element
    return root


def in_order(root: Node) -> list[Node]:
    """Nodes with text-bearing content, parents first; no recursion, pages nest deeply."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node) and not c.no_text)
    return found


def drop_doubtful(body: Node) -> None:
    """Takes out what a word speaks against and the density does too: link-heavy parts and those
    with a small share of the text, but nothing that holds the densest subtree. Headings and
    paragraphs, and a header inside an article or with a main heading, only go as adverts or
    for their links."""
    nodes = in_order(body)
    if not any(node.named for node in nodes):
        return
    measure(nodes, body)
    total = body.chars
    inside, main_heading, framing = set(), set(), set()
    for node in nodes:  # parents first
        if node.parent is not None and (node.parent.tag in ("article", "main") or node.parent in inside):
            inside.add(node)
    for node in reversed(nodes):
        if node.tag == "h1" or node in main_heading:
            main_heading.update((node, node.parent))
        if (node.tag in ("article", "main") and node.chars) or node in framing:
            framing.add(node.parent)  # holds an article

    def agreed(node: Node) -> bool:
        links = node.link_chars > PART * node.chars
        if READERS in node.named and node not in framing:
            return node.chars < total
        if node.tag in HEADINGS and not node.named & OTHERS_WORDS:
            return links
        if node.named <= {"header", "masthead"}:
            if node in inside or node in main_heading:
                return links
        if node.named & OTHERS_WORDS and framing:  # beside an article, however short that is
            return node not in framing or links
        return links or node.chars <= PART * total

    doubtful = [node for node in nodes if node.named and node is not body and agreed(node)]
    for node in doubtful:
        node.no_text = bool(node.named & OTHERS_WORDS)
    nodes = in_order(body)
    clear(nodes)
    measure(nodes, body)
    best = max(nodes, key=lambda node: node.density_sum)
    kept = {best, *ancestors(best)}
    for node in doubtful:
        node.no_text = node.no_text or node not in kept
    clear(nodes)


def clear(nodes: list[Node]) -> None:
    for node in nodes:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = node.density_sum = 0.0


def measure(nodes: list[Node], body: Node) -> None:
    """Characters, tags and densities of all nodes, from the leaves up."""
    for node in reversed(nodes):
        for child in node.children:
            if isinstance(child, str):
                node.chars += len(SPACE.sub(" ", child).strip())
            elif not child.no_text:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, 1
    share = body.link_chars / max(body.chars, 1)
    for node in nodes:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in nodes:
        for child in node.children:
            if isinstance(child, str):
                node.density_sum += density(len(SPACE.sub(" ", child).strip()), 1, 0, 0, share)
            elif not child.no_text:
                node.density_sum += child.density


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters for each tag, lessened by links and by the page's share of link text. A count
    of zero that would divide counts as one."""
    if not chars:
        return 0.0
    base = math.log(chars * link_chars / max(chars - link_chars, 1) + share * chars + math.e)
    plain = max(chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1), 1.0)
    return chars / max(tags, 1) * math.log(plain) / base


def main_parts(body: Node, nodes: list[Node]) -> list[Node | str]:
    """The subtree of the largest density sum, or the article that it stands in without its
    parts of links, and the body's other parts and bare texts that reach the path's least
    density, in page order."""
    best = max(nodes, key=lambda node: node.density_sum)
    if best.density_sum <= 0:
        return []
    threshold, path, node = best.density, {best}, best
    while node is not body:
        node = node.parent
        path.add(node)
        threshold = min(threshold, node.density)
    frame = None
    node = best
    while node is not None:
        if node.tag in ("article", "main"):
            frame = node  # the outermost
        node = node.parent
    if frame is not None:  # the article, not only the densest of its sections
        drop_links(frame, path, threshold)
        best = frame
        path = {best, *ancestors(best)}
    share = body.link_chars / max(body.chars, 1)
    parts, stack = [], [body]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            text = SPACE.sub(" ", node).strip()
            if text and density(len(text), 1, 0, 0, share) >= threshold:
                parts.append(text)
        elif node is best:
            parts.append(node)
        elif node in path:
            stack.extend(c for c in reversed(node.children) if isinstance(c, str) or not c.no_text)
        elif node.density >= threshold and node.density > 0:
            parts.append(node)
    return parts


def drop_links(frame: Node, path: set[Node], threshold: float) -> None:
    """Takes out of an article what holds little but links and stays below the threshold."""
    stack = [frame]
    while stack:
        node = stack.pop()
        for child in node.children:
            if isinstance(child, str) or child.no_text:
                continue
            links = child.link_chars > PART * child.chars
            if child.tag in HOLDERS and child not in path and links and child.density < threshold:
                child.no_text = True
            else:
                stack.append(child)


def ancestors(node: Node) -> set[Node]:
    found = set()
    while node.parent is not None:
        node = node.parent
        found.add(node)
    return found


def blocks(part: Node | str) -> list[str]:
    """Texts of a subtree's blocks in page order."""
    found, running = [], []

    def end() -> None:
        text = SPACE.sub(" ", "".join(running)).strip()
        if text:
            found.append(text)
        running.clear()

    stack: list[Node | str | None] = [part]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            running.append(item)
        elif not item.no_text:
            if item.tag in BLOCK:
                end()
                stack.append(None)
            stack.extend(reversed(item.children))
    end()
    return found


def main_text(source: str | None) -> str:
    """The main text of one page, its blocks joined by line ends; empty if there is none."""
    if not source:
        return ""
    root = parse(source)
    nodes = in_order(root)
    body = next((node for node in nodes if node.tag == "body"), root)
    drop_doubtful(body)
    nodes = in_order(body)
    measure(nodes, body)
    return "\n".join(text for part in main_parts(body, nodes) for text in blocks(part))


def _main_texts(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(page.as_py()) for page in pages], pa.string())


def extracted(page: Column) -> Column:
    return F.arrow_udf(_main_texts, T.StringType())(page)


def page_texts(
    pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html"
) -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` (its code points) for each row of ``pages``.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
    comments are left out wherever they stand. Character references are decoded, white space
    inside a block becomes one space, blocks are joined by a line end. A null or empty page, and
    one without text, gives an empty text; broken markup is read as far as it goes. Repeated
    rows each get a result.
    """
    found = pages.select(
        pages[key].alias(key), pages[url].alias(url), extracted(pages[page]).alias("text")
    )
    return found.withColumn("n_chars", F.length("text").cast("long"))
