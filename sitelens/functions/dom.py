"""The elements of a page, and what of them links and products come from.

This is the part that expressions cannot say: ancestors, nearest cards and texts of subtrees. A page is read once, in a
task of its own, and gives one row for each link; everything else is columns over these rows.
"""

from __future__ import annotations

import html as references
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import values as V
from .markup import RawEnds, attributes, tags

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element that ends where one of these begins.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option", "optgroup"}, "a": {"a"},
            "p": set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())}
#: The elements that an element ends, by its name.
ENDS = {tag: [x for x, by in ENDED_BY.items() if tag in by] for tag in set().union(*ENDED_BY.values())}
SCOPES = frozenset("ul ol dl table select div section article body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEAR = frozenset("li div p span footer section".split())
SKIPPED_CLASSES = frozenset("nav navigation header footer menu navbar site-header site-footer main-nav top-bar bottom-bar".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo".split())
KEPT_QUERY = ("id", "product_id", "item_id", "sku")
LONGEST_URL, LONGEST_PRICE = 2000, 200


class Element:
    __slots__ = ("tag", "attrs", "parent", "children", "words", "skipped", "footer", "footer_like", "shows", "cards", "policies")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []
        self.shows: bool | None = None
        self.cards: list[Element | None] | None = None
        self.policies: frozenset[str] = frozenset()
        self.words = frozenset(attrs.get("class", "").split())
        up = parent
        self.skipped = bool(up and up.skipped) or tag in ("nav", "header", "footer") or bool(self.words & SKIPPED_CLASSES) or attrs.get("role") in SKIPPED_ROLES
        # Whether an element above is a footer, and whether one is by its id only.
        self.footer = bool(up and (up.footer or up.tag == "footer" or "footer" in up.attrs.get("class", "")))
        self.footer_like = bool(up and (up.footer_like or "footer" in up.attrs.get("id", "")))

    def has(self, part: str) -> bool:
        """Whether the class attribute holds a text."""
        return part in self.attrs.get("class", "")

    def walk(self) -> Iterator[Element | str]:
        """All below, in page order."""
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            yield x
            if isinstance(x, Element):
                todo += reversed(x.children)

    def below(self, test: Callable[[Element], bool]) -> Iterator[Element]:
        return (x for x in self.walk() if isinstance(x, Element) and test(x))

    def first(self, test: Callable[[Element], bool]) -> Element | None:
        return next(self.below(test), None)

    def up(self) -> Iterator[Element]:
        """The element, and those above it."""
        x: Element | None = self
        while x is not None:
            yield x
            x = x.parent

    def text(self) -> str:
        return "".join(x for x in self.walk() if isinstance(x, str))


#: Elements whose content is text, and those of them in which references count.
RAW, REFERRING = frozenset(("script", "style", "title", "textarea")), frozenset(("title", "textarea"))


def parse(page: str | None) -> Element:
    page = page or ""
    root = node = Element("", {}, None)
    open_: Counter[str] = Counter()
    ends, at = RawEnds(page), 0

    def leave(up: Element) -> None:
        nonlocal node
        while node is not up:
            open_[node.tag] -= 1
            node = node.parent

    for start, after, end, tag, text in tags(page):
        if start < at:  # in the content of a raw element
            continue
        if start > at:
            node.children.append(references.unescape(page[at:start]))
        at = after
        if not tag:
            continue
        if end:
            if open_[tag]:
                leave(next(x for x in node.up() if x.tag == tag).parent)
            continue
        if any(open_[x] for x in ENDS.get(tag, ())):
            for x in node.up():
                if tag in ENDED_BY.get(x.tag, ()):
                    leave(x.parent)
                    break
                if x.tag in SCOPES:
                    break
        child = Element(tag, {k: references.unescape(v) for k, v in reversed(list(attributes(text)))}, node)
        node.children.append(child)
        if tag in RAW:
            found = ends.after(tag, at)
            inner = page[at : found[0]] if found else page[at:] if tag in ("script", "style") else ""
            if inner:
                child.children.append(references.unescape(inner) if tag in REFERRING else inner)
            at = found[1] if found else at + len(inner)
        elif tag not in VOID:
            node = child
            open_[tag] += 1
    if at < len(page):
        node.children.append(references.unescape(page[at:]))
    return root


def encoded(part: str, marks: str) -> str:
    """A part of an address with the marks, spaces, controls and all beyond ASCII escaped."""
    return "".join(c if "!" <= c <= "~" and c not in marks else quote(c, safe="") for c in part)


def resolved(href: str, base: str) -> str | None:
    """An address in full; null where it can't be one."""
    try:
        parts = urlsplit(urljoin(base, href.strip()))
        host = (parts.hostname or "").lower()
        if parts.scheme not in ("http", "https") or not host:
            return None
        port = f":{parts.port}" if parts.port and parts.port != {"http": 80, "https": 443}[parts.scheme] else ""
        return urlunsplit((parts.scheme, host + port, encoded(parts.path or "/", '"<>`{}'), encoded(parts.query, "\"'<>"), parts.fragment))
    except ValueError:
        return None


def page_address(href: str, base: str) -> str:
    """A link in full, without its fragment; the link itself where it can't be resolved."""
    full = resolved(href, base)
    return urlunsplit((*urlsplit(full)[:4], "")) if full else href


def product_address(href: str, base: str) -> str | None:
    """A product's address: only the query that names another product stays, and no fragment."""
    if not href or href == "#" or href.startswith(("javascript:", "mailto:", "tel:")):
        return None
    full = resolved(href, base)
    if full is None:
        return None
    parts = urlsplit(full)
    query = dict(reversed(parse_qsl(parts.query, keep_blank_values=True)))
    return urlunsplit((parts.scheme, parts.netloc, parts.path, urlencode([(k, query[k]) for k in KEPT_QUERY if k in query]), ""))


CARDS: list[Callable[[Element], bool]] = [
    lambda x: x.tag == "li" and "wc-block-product" in x.words,
    lambda x: x.tag == "li" and "product" in x.words,
    lambda x: "wc-block-grid__product" in x.words,
    lambda x: "product-grid-item" in x.words,
    lambda x: x.tag == "article" and x.has("product"),
    lambda x: x.tag == "li" and x.has("product"),
    lambda x: x.tag == "li" and x.has("card"),
    lambda x: x.tag == "li" and x.has("item"),
    lambda x: x.tag == "article",
    lambda x: x.tag == "li",
    lambda x: x.tag == "div" and x.has("product-card"),
    lambda x: x.tag == "div" and x.has("card") and x.has("product"),
    lambda x: x.tag == "div" and x.has("item") and x.has("product"),
    lambda x: "shoplazza-product-snippet" in x.words,
    lambda x: x.tag == "div" and x.has("product-snippet") and not x.has("img-") and not x.has("__price"),
    lambda x: x.has("grid-item"),
    lambda x: x.has("tile"),
]
TITLES: list[Callable[[Element], bool]] = [
    *(lambda x, part=part: x.has(part) for part in ("product-title", "product-name", "item-title", "item-name")),
    lambda x: x.has("title") and not (x.has("save") or x.has("discount") or x.has("badge")),
    lambda x: x.has("name") and not (x.has("user") or x.has("author")),
]
PRICED: list[Callable[[Element], bool]] = [
    lambda x: x.has("price"), lambda x: x.has("cost"), lambda x: x.has("amount"), lambda x: "data-price" in x.attrs, lambda x: x.attrs.get("itemprop") == "price", lambda x: x.tag == "span",
]


def is_priced(x: Element) -> bool:
    return x.has("price") or "price" in x.attrs.get("data-block-name", "")


def card_of(anchor: Element) -> Element:
    """The card that a link belongs to: the nearest element of the first kind that is above it, else one of five
    elements above with a price and an image, else the link."""
    for x in cards_above(anchor):
        if x is not None:
            return x
    for n, x in enumerate(anchor.up()):
        if n > 5:
            break
        if n and shows_product(x):
            return x
    return anchor


def cards_above(element: Element) -> list[Element | None]:
    """Of each kind of card the nearest that the element is or stands in; worked out once for an element."""
    new = []
    for x in element.up():
        if x.cards is not None:
            break
        new.append(x)
    for x in reversed(new):
        above = x.parent.cards if x.parent else [None] * len(CARDS)
        x.cards = [x if test(x) else y for test, y in zip(CARDS, above)]
    return element.cards


def shows_product(x: Element) -> bool:
    """Whether a price and an image stand below; found out once for an element."""
    if x.shows is None:
        x.shows = x.first(is_priced) is not None and x.first(lambda y: y.tag == "img") is not None
    return x.shows


def titles_of(card: Element) -> list[str]:
    """Texts that may be a product's title, best first; the link's own come after them."""
    out = []
    for test in (lambda x: x.tag in HEADINGS, *TITLES):
        if (x := card.first(test)) is not None:
            out.append(x.text().strip())
    if (x := card.first(lambda y: y.tag in ("img", "spz-img"))) is not None:
        out.append(x.attrs.get("alt", "").strip())
    return out


def prices_of(card: Element) -> list[dict[str, str | None]]:
    """Texts that may be a price, in the order in which they are tried; with an original price where one is shown."""
    out: list[dict[str, str | None]] = []

    def add(kind: str, text: str, original: str | None = None) -> None:
        if text and len(text) <= LONGEST_PRICE:
            out.append({"kind": kind, "text": text, "original": original})

    amount = lambda x: "woocommerce-Price-amount" in x.words or "amount" in x.words
    whole = lambda xs: "".join(x.text() for x in xs).strip()
    if (box := card.first(is_priced)) is not None:
        old, new = (list(box.below(lambda x, tag=tag: x.tag == tag)) for tag in ("del", "ins"))
        inner = lambda xs: next((t for x in xs for y in [x.first(amount)] if y is not None for t in [y.text().strip()] if t), "") or whole(xs)
        if old and new:
            add("sale", inner(new), inner(old))
        if not old and (x := box.first(amount)) is not None:
            add("plain", x.text().strip())
    money = card.first(lambda x: x.tag == "span" and "money" in x.words or "money" in x.words and any("product-snippet__price" in y.words for y in x.up() if y is not x))
    if money is not None:
        before = card.first(lambda x: "product-snippet__compare-at-price" in x.words or x.has("compare-at-price"))
        add("money", money.text().strip(), before.text().strip() if before is not None else None)
    inserted = card.first(lambda x: x.tag == "ins") is not None
    for test in PRICED:
        for x in card.below(test):
            if inserted and any(y.tag == "del" for y in x.up()) or any(y.has("compare-at-price") for y in x.up()):
                continue
            add("plain", x.text().strip())
            add("plain", x.attrs.get("data-price") or x.attrs.get("content") or "")
            if x.attrs.get("data-money"):
                add("plain", x.attrs.get("data-currencysymbol", "") + x.attrs["data-money"])
    add("plain", card.text())
    return out


def image_of(card: Element, base: str) -> str | None:
    cut = lambda src: (resolved(src, base) or "")[:LONGEST_URL] or None
    x = card.first(lambda y: y.tag in ("img", "spz-img") or "data-src" in y.attrs)
    if x is not None:
        src = next((x.attrs[k] for k in ("src", "data-src", "data-lazy-src", "data-original") if x.attrs.get(k)), "")
        if src and not src.startswith("data:"):
            return cut(src)
        src = x.attrs.get("srcset", "").split(",")[0].split(" ")[0].strip()
        if src and not src.startswith("data:"):
            return cut(src)
    for x in card.below(lambda y: "background" in y.attrs.get("style", "")):
        m = re.search(r"""url\(['"]?([^'")\s]+)['"]?\)""", x.attrs["style"])
        if m and not m[1].startswith("data:"):
            return cut(m[1])
    return None


_ANCHOR_WORDS = [(k, re.compile(p, re.I)) for k, p in V.POLICY_ANCHORS]
#: For each of these patterns, words of which an ASCII text in lower case has one if it matches; a look for words is much faster than a pattern.
_ANCHOR_GUARDS = {
    "privacy": "privacy protect cookie gdpr privacidad datenschutz".split(),
    "refund": "refund return cancellation money exchange reembolso troca cambio remboursement retour erstattung umtausch rimborso reso".split(),
    "terms": "term & conditions nutzungsbedingungen agb condizioni".split(),
}


def named_policies(text: str) -> list[str]:
    """The policies whose words a text has."""
    low = text.lower() if text.isascii() else None
    return [k for k, p in _ANCHOR_WORDS if (low is None or any(w in low for w in _ANCHOR_GUARDS[k])) and p.search(text.strip())]


def mark_policies(root: Element) -> None:
    """Gives each element the policies whose words stand in a text that has it, or one above it, as its nearest container."""
    body = root.first(lambda x: x.tag == "body") or root
    every = list(body.below(lambda x: True))
    nearest: dict[int, Element] = {}
    for x in every:  # those above come first; texts of the body itself have no element around them
        above = nearest.get(id(x.parent))
        nearest[id(x)] = x if x.tag in NEAR or above is None or above.tag not in NEAR else above
        for text in x.children:
            if isinstance(text, str) and (found := named_policies(text)):
                nearest[id(x)].policies |= frozenset(found)
    for x in every:
        x.policies |= x.parent.policies


def links(page: str | None, url: str | None, products: bool = True) -> Iterator[dict]:
    """Every link of a page that has an address, in page order. A card's titles, prices and image stand at its first link only, so that
    a page of n links in one card gives n rows and not n times what the card holds; without products no cards are looked for."""
    root, base = parse(page), url or ""
    mark_policies(root)
    cards: dict[int, int] = {}
    for pos, x in enumerate(root.below(lambda y: y.tag == "a" and "href" in y.attrs)):
        titles, prices, image, number = [], [], None, None
        if products:
            card = card_of(x)
            if id(card) not in cards:
                titles, prices, image = titles_of(card), prices_of(card), image_of(card, base)
            number = cards.setdefault(id(card), pos)
        text, href = x.text().strip(), x.attrs["href"]
        yield {
            "pos": pos, "href": href, "text": text, "label": f"{text} {x.attrs.get('aria-label', '')} {x.attrs.get('title', '')}", "in_footer": x.footer, "footer_like": x.footer or x.footer_like, "skipped": x.skipped,
            "address": page_address(href, base), "product_url": product_address(href, base), "near": [k for k, _ in V.POLICY_ANCHORS if k in x.policies],
            "card": number, "own_titles": [x.attrs.get("aria-label", "").strip(), text], "titles": titles, "prices": prices, "image": image,
        }


LINK = "pos int, href string, text string, label string, in_footer boolean, footer_like boolean, skipped boolean, address string, product_url string, near array<string>, card int, own_titles array<string>, titles array<string>, prices array<struct<kind: string, text: string, original: string>>, image string"
_PRICE = pa.struct([("kind", pa.string()), ("text", pa.string()), ("original", pa.string())])
_TYPES = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(_PRICE), pa.string()]
_NAMES = ["pos", "href", "text", "label", "in_footer", "footer_like", "skipped", "address", "product_url", "near", "card", "own_titles", "titles", "prices", "image"]


def link_rows(pages: DataFrame, html: str = "html", products: bool = False) -> DataFrame:
    """(page_id, url, html) -> page_id, url and LINK: a row for each link of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A page at a time, so that a batch of long pages is never held whole as links.
            for page_id, url, page in zip(*batch.columns):
                rows = list(links(page.as_py(), url.as_py(), products))
                if rows:
                    own = [pa.array([page_id.as_py()] * len(rows), batch.schema.field(0).type), pa.array([url.as_py()] * len(rows), pa.string())]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array([r[n] for r in rows], t) for n, t in zip(_NAMES, _TYPES))], names=["page_id", "url", *_NAMES])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", F.col(html)).mapInArrow(run, f"page_id {kind}, url string, {LINK}")


HIDDEN = frozenset(("script", "style", "noscript"))


def body_text(root: Element) -> str:
    """The text of the body without scripts and styles, white space folded."""
    body = root.first(lambda x: x.tag == "body") or root
    todo, out = list(reversed(body.children)), []
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag not in HIDDEN:
            todo += reversed(x.children)
    return " ".join("".join(out).split())


def snippet(root: Element, most: int = 200) -> str | None:
    """The title, else the first first-level heading, else the first of the next two levels, cut."""
    title = "".join(x.text() for x in root.below(lambda y: y.tag == "title")).strip()
    for test in (lambda y: y.tag == "h1", lambda y: y.tag in ("h2", "h3")):
        if not title and (x := root.first(test)) is not None:
            title = x.text().strip()
    return title[:most] or None


def linked_data(root: Element) -> list[str]:
    """What the page's linked data says of contacts, a line each: `PHONE:`, `EMAIL:`, `ADDRESS:`, `SOCIAL:`. A graph stands for its members."""
    out: list[str] = []

    def gather(x) -> None:
        todo = [x]
        while todo:
            x = todo.pop()
            if not isinstance(x, dict):
                continue
            if isinstance(x.get("@graph"), list) and x["@graph"]:
                todo += reversed(x["@graph"])
                continue
            out.extend(f"{name}: {x[key]}" for name, key in (("PHONE", "telephone"), ("EMAIL", "email")) if x.get(key))
            address = x.get("address")
            if isinstance(address, str) and address:
                out.append(f"ADDRESS: {address}")
            elif isinstance(address, dict) and address.get("streetAddress"):
                out.append("ADDRESS: " + ", ".join(str(address[k]) for k in ("streetAddress", "addressLocality", "postalCode", "addressCountry") if address.get(k)))
            if isinstance(x.get("sameAs"), list):
                out.extend(f"SOCIAL: {y}" for y in x["sameAs"] if isinstance(y, str))
            points = x.get("contactPoint") or []
            for y in points if isinstance(points, list) else [points]:
                if isinstance(y, dict):
                    out.extend(f"{name}: {y[key]}" for name, key in (("PHONE", "telephone"), ("EMAIL", "email")) if y.get(key))

    for x in root.below(lambda y: y.tag == "script" and y.attrs.get("type", "").lower() == "application/ld+json"):
        try:
            gather(json.loads(x.text()))
        except (ValueError, RecursionError):
            continue
    return out


def page_texts(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """The columns of keep, and of a page's html its text (of the body), snippet and linked data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [parse(x.as_py()) for x in batch.column(0)]
            own = [pa.array(map(body_text, roots), pa.string()), pa.array(map(snippet, roots), pa.string()), pa.array(map(linked_data, roots), pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *own], names=[*keep, "body_text", "snippet", "linked"])

    kinds = dict(pages.dtypes)
    return pages.select(html, *keep).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", body_text string, snippet string, linked array<string>")
