"""Main text of web pages by composite text density.

A page is parsed into a tree of block elements (inline markup belongs to the block around it; links
are counted) by a scanner that passes each character a bounded number of times. Parts that are no article by their
element, by being hidden or by a whole token of their class, id or role are taken out with all below
them: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments. Inline elements and formulas
are text whatever their class, unless they are hidden. Where only the
first or last word of a token says so, or the part stands in an article or main element and its token may
name a subject too, density decides: it is taken out if it is mostly links or less dense than the page,
unless it holds most of the page's text. Each remaining node has a composite text density: characters per
element, adjusted by how much of its text and how many of its elements are links. The densities of
a node's children are summed; the node of the greatest sum, the deepest among equals, holds the article. The
least density on its path to the body is the threshold by which the enclosing nodes are judged:
while the parent is a part of the body, as dense as that and not mostly links, it's the article's
container instead. Where that is an article element, its neighbours of the same element that are not
mostly links are articles too.

Text: character references decoded, white space within a block is one space, blocks in page order
joined by two line feeds.

Defined results: a null or empty page, or one without text, gives the empty text; a page with no
elements at all is one block; ids may repeat or be null, every row is parsed alone; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markup import RawEnds, attributes, tags
from .common import small_batches, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
#: Their content is text up to their own end tag, and no article.
RAW = frozenset("script style noscript template iframe textarea title xmp noframes noembed".split())
#: Elements that hold no article, and words in class, id or role that say so.
DROPPED = RAW | frozenset("head nav header footer aside form button select option input object embed applet svg canvas audio video dialog menu".split())
WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside comment comments commentlist disqus reply replies respond"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs footer header masthead share sharing social"
    " related recommended newsletter subscribe subscription signup login search toolbar pagination pager widget skip contentinfo complementary search dialog".split()
)
#: Those of them that name no subject of an article: a part with such a token is taken out wherever it stands.
NEVER = frozenset("ad ads adbox advert adverts advertisement advertising adsense sponsored comments commentlist disqus replies navbar breadcrumb breadcrumbs pagination pager newsletter contentinfo".split())
#: Words that make such a token together with them, as in `comment-list`, and those that need another.
PARTS = frozenset("list area section container banner box bar slot block unit links items notice popup form buttons".split())
CLEAR = NEVER | frozenset("comment reply respond subscribe signup promo cookie cookies consent gdpr".split())
CONTAINERS = frozenset(("article", "main"))
#: An open element of the key ends where one of the elements begins.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd td th tr".split()),
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")), "th": frozenset(("td", "th", "tr", "tbody", "tfoot")), "tr": frozenset(("tr", "tbody", "tfoot")),
    "option": frozenset(("option", "optgroup")), "thead": frozenset(("tbody", "tfoot")), "tbody": frozenset(("tbody", "tfoot")),
}
#: Elements that an implied end doesn't reach beyond.
BOUNDS = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "td": frozenset(("table",)), "th": frozenset(("table",)), "tr": frozenset(("table",)), "p": frozenset(("td", "th", "button", "table"))}
#: The elements that an element ends, by its name.
CLOSES = {tag: [x for x, by in CLOSED_BY.items() if tag in by] for tag in frozenset().union(*CLOSED_BY.values())}
#: Share of link text beyond which a container is a list of links.
LINKS = 1 / 3
#: Elements of text, which links alone tell from boilerplate.
TEXT = frozenset("h1 h2 h3 h4 h5 h6 p".split()) | INLINE
#: What says that a part is no article: nothing, a word at a token's end, a whole token, element or hiding.
NONE, WORD, TOKEN, SURE = range(4)
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "parent", "children", "unwanted", "linked", "chars", "link_chars", "tags", "link_tags", "density", "depth", "inside", "dropped", "holds")

    def __init__(self, tag: str, parent: Node | None, unwanted: int = NONE, linked: bool = False):
        self.tag, self.parent, self.unwanted, self.linked = tag, parent, unwanted, linked
        self.children: list[Node | str] = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = 0.0
        self.depth = parent.depth + 1 if parent else 0
        self.inside = self.dropped = self.holds = False


def hidden(name: str, value: str) -> bool:
    return bool(name == "hidden" and value.lower() != "false" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NO_DISPLAY.search(value))


def unwanted(tag: str, text: str) -> int:
    """Inline elements belong to the text around them whatever their class; only hiding takes them out."""
    if tag in INLINE:
        return SURE if any(hidden(*x) for x in attributes(text)) else NONE
    if tag in CONTAINERS or tag in ("html", "body"):
        return NONE
    if tag in DROPPED:
        return SURE
    found = NONE
    for name, value in attributes(text):
        if hidden(name, value):
            return SURE
        if name in ("class", "id", "role"):
            for token in value.split():
                words = [w.lower() for w in _CAMEL.findall(token)]
                if token.lower() in NEVER or len(words) > 1 and CLEAR.issuperset(w for w in words if w not in PARTS) and not PARTS.issuperset(words):
                    return SURE
                if token.lower() in WORDS:
                    found = TOKEN
                elif words and (words[0] in WORDS or words[-1] in WORDS):
                    found = max(found, WORD)
    return found


def parse(page: str) -> Node:
    """The tree of block elements. Links are the marks \\0 and \\1 in text, line breaks are spaces."""
    root = node = Node("html", None)
    open_ = Counter(("html",))
    at = link = 0
    ends = RawEnds(page)

    def add(text: str) -> None:
        if text:
            node.children.append(text)

    def text_to(end: int) -> None:
        add(references.unescape(page[at:end]).replace("\0", " ").replace("\1", " "))

    def leave(up: Node) -> None:
        """Goes on in a node above."""
        nonlocal node
        while node is not up:
            open_[node.tag] -= 1
            node = node.parent

    def enter(child: Node) -> None:
        nonlocal node
        node = child
        open_[child.tag] += 1

    for start, after, end, tag, text in tags(page):
        if start < at:  # in the content of a raw element
            continue
        text_to(start)
        at = after
        if not tag:
            continue
        alone = text.endswith("/")
        if tag == "a":
            if link or end:
                add("\1" * link)
                link = 0
            if not end:
                add("\0")
                link = 1
        elif tag in RAW and not end:
            if not alone:
                found = ends.after(tag, at)
                if found or tag in ("script", "style"):
                    at = found[1] if found else len(page)
        elif tag == "br":
            add(" ")
        elif tag in INLINE:
            if tag == "img":
                add(" ")
            elif not end and (level := unwanted(tag, text)) and not alone:
                child = Node(tag, node, level, bool(link))
                node.children.append(child)
                enter(child)
            elif end and node.tag == tag and node.unwanted:
                leave(node.parent)
        elif end:
            if open_[tag] and tag != "html":
                up = node
                while up.tag != tag:
                    up = up.parent
                add("\1" * link)
                link = 0
                leave(up.parent)
        elif tag in ("html", "body") and open_[tag]:
            continue
        else:
            add("\1" * link)
            link = 0
            if any(open_[x] for x in CLOSES.get(tag, ())):
                for x in path(node):
                    if tag in CLOSED_BY.get(x.tag, ()):
                        leave(x.parent)
                        break
                    if x.tag in BOUNDS.get(tag, ()) or x.tag not in INLINE and x.tag not in CLOSED_BY:
                        break
            child = Node(tag, node, unwanted(tag, text))
            node.children.append(child)
            if tag not in VOID and not alone:
                enter(child)
    text_to(len(page))
    return root


def path(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def in_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        out.append(node := todo.pop())
        todo += [x for x in reversed(node.children) if isinstance(x, Node)]
    return out


def prune(root: Node) -> None:
    """Takes unwanted nodes out. One that holds an article or main element only by its class's
    word is a wrapper of the page and stays, and so does a header within an article."""
    nodes, doubtful = in_order(root), []
    for node in nodes:
        up = node.parent
        node.inside = bool(up and (up.inside or up.tag in CONTAINERS))
        node.dropped = bool(up and up.dropped) or bool(node.unwanted and node.tag in DROPPED)
        node.holds = node.tag in CONTAINERS and not node.dropped
    for node in reversed(nodes):
        if node.holds and node.parent:
            node.parent.holds = True
    for node in nodes:
        if node.holds and node.tag in CONTAINERS:
            continue
        if node.unwanted and node.tag == "header" and node.inside:
            node.unwanted = NONE
        elif node.unwanted == WORD or node.unwanted == TOKEN and node.inside:
            doubtful.append(node)
            node.unwanted = NONE
    take_out(root)
    if doubtful:
        measure(root)
        for node in doubtful:
            dense = node.link_chars <= LINKS * node.chars and (node.tag in TEXT or node.density >= root.density)
            if not dense and 2 * node.chars <= root.chars:
                node.unwanted = SURE
        take_out(root)


def take_out(root: Node) -> None:
    todo = [root]
    while todo:
        node = todo.pop()
        node.children = [x for x in node.children if isinstance(x, str) or not x.unwanted or x.holds]
        todo += [x for x in node.children if isinstance(x, Node)]


def measure(root: Node) -> None:
    nodes = in_order(root)
    for node in reversed(nodes):
        linked = node.linked
        node.chars = node.link_chars = node.tags = node.link_tags = 0
        node.density = 0.0
        for x in node.children:
            if isinstance(x, Node):
                node.chars += x.chars
                node.link_chars += x.link_chars
                node.tags += x.tags + 1
                node.link_tags += x.link_tags
                continue
            for part in re.split("([\0\1])", x):
                if part == "\0":
                    linked = True
                    node.tags += 1
                    node.link_tags += 1
                elif part == "\1":
                    linked = False
                else:
                    n = len("".join(part.split()))
                    node.chars += n
                    node.link_chars += n * linked
    body = max(root.chars, 1)
    ratio = root.link_chars / body
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        if not c:
            continue
        base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
        node.density = c / t * max(0.0, math.log(max(1.0, c / max(lc, 1) * t / max(lt, 1))) / base) if base > 0 else 0.0


def article(root: Node) -> list[Node]:
    """The nodes that hold the article, in page order."""
    total = lambda node: sum(x.density for x in node.children if isinstance(x, Node))
    best = max(in_order(root), key=lambda node: (total(node), node.depth))  # the first in page order among equals
    threshold = min((x.density for x in path(best) if x.tag != "html"), default=0.0)
    found = best
    for x in path(best.parent):
        if x.tag in ("html", "body"):
            break
        if x.density >= threshold and x.link_chars <= LINKS * x.chars:
            found = x
    if found.tag not in CONTAINERS or found.parent is None:
        return [found]
    return [x for x in found.parent.children if x is found or isinstance(x, Node) and x.tag == found.tag and x.link_chars <= LINKS * x.chars]


def blocks(node: Node) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x.replace("\0", "").replace("\1", ""))
        elif x.tag in INLINE:
            todo += reversed(x.children)
        else:
            flush()
            todo += [None, *reversed(x.children)]
    flush()
    return out


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    prune(root)
    measure(root)
    return "\n\n".join(x for node in article(root) for x in blocks(node))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
