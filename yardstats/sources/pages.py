"""Listings out of stored web pages.

Markup nests and is often broken, which SQL expressions cannot follow, so a page
is walked in Python, inside Arrow batches: one forward scan finds the tags,
and attributes are looked at only where a wanted name occurs. Only pages that can
hold a listing are sent to Python: the test for the item's name runs in the JVM.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The reader's code travels with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTING_SCHEMA = (
    "page_id long, position int, title string, price_text string, link string, complete boolean"
)

# Elements that never have content.
VOID = frozenset(
    "area base br col embed frame hr img input link meta param source track wbr".split()
)

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"""[>"']""")
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*))""")

# All tags of a page without broken markup, in one pass of the pattern engine: the text before a tag; its slash, name
# and attributes, or else a comment, declaration, script or style. At a tag that does not end, the rest is one match.
# Possessive throughout (Python 3.11 and later), so the pattern never goes back over a page.
_ATTRIBUTES = r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+"""
_SCRIPT, _STYLE = ("".join(f"[{c}{c.upper()}]" for c in name) + r"(?=[\s/>])" for name in _RAW)
_TAG = re.compile(
    r"([^<]*+(?:<(?!/?[a-zA-Z]|[!?])[^<]*+)*+)"
    rf"(?:<(?:(?!{_SCRIPT}|{_STYLE})(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})>|(!--.*?-->|(?!!--)[!?][^>]*+>"
    rf"|{_SCRIPT}{_ATTRIBUTES}>.*?</(?i:script)\s*>|{_STYLE}{_ATTRIBUTES}>.*?</(?i:style)\s*>))|(<).*|\Z)",
    re.S,
)
# Longer pages are walked tag by tag, so that their tags are never in memory together.
_WHOLE = 1 << 20


@dataclass(frozen=True)
class Selectors:
    """Where a listing and its fields are: ``.class`` or an element name.

    ``price=None`` describes listings without a price.
    """

    item: str = ".s-item"
    title: str = ".s-item__title"
    price: str | None = ".s-item__price"
    link: str = ".s-item__link"

    def fields(self) -> dict[str, str]:
        named = {"title": self.title, "price_text": self.price, "link": self.link}
        return {k: v for k, v in named.items() if v}


def _attributes(text: str) -> dict[str, str]:
    return {key.lower(): unescape(double or single or bare) for key, double, single, bare in _ATTRIBUTE.findall(text)}


def tags(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of the tags of a page, in one forward scan.

    Comments, declarations, scripts and styles yield a tag without a name. A "<" that
    starts none of these is text. A ">" inside quotes does not end a tag, unless a quote
    or the tag would not end at all: from there on quotes mean nothing, so that broken
    markup is not searched again and again.
    """
    size, at, quotes = len(html), 0, True
    while (start := html.find("<", at)) >= 0:
        at = start + 1
        if html.startswith("!--", at):
            end = html.find("-->", at + 3)
            at = size if end < 0 else end + 3
            yield start, at, "", "", ""
            continue
        plain = html.find(">", at)
        if plain < 0:
            return
        if html.startswith(("!", "?"), at):
            at = plain + 1
            yield start, at, "", "", ""
            continue
        named = _NAME.match(html, at)
        if not named:
            continue
        end = plain
        if quotes:
            look = named.end()
            while True:
                stop = _STOP.search(html, look)
                if stop and stop[0] == ">":
                    end = stop.start()
                    break
                closed = html.find(stop[0], stop.end()) if stop else -1
                if closed < 0:
                    quotes = False
                    break
                look = closed + 1
        slash, name = named.groups()
        name, at = name.lower(), end + 1
        if not slash and name in _RAW:
            over = _RAW[name].search(html, at)
            at = over.end() if over else size
            yield start, at, "", "", ""
        else:
            yield start, at, slash, name, html[named.end() : end]


def _walked(html: str) -> Iterator[tuple[str, ...]]:
    end = 0
    for start, stop, slash, name, attributes in tags(html):
        yield html[end:start], slash, name, attributes, "", ""
        end = stop


def texts_and_tags(html: str) -> Iterable[tuple[str, ...]]:
    """The text before each tag, its slash, name, attributes, and two more; the same tags as those of ``tags``."""
    if len(html) > _WHOLE:
        return _walked(html)
    found = _TAG.findall(html)  # the last one is empty
    if len(found) > 1 and found[-2][5]:
        return _walked(html)
    while found and not (found[-1][2] or found[-1][4]):  # the text behind the last tag
        found.pop()
    return found


def listing_reader(selectors: Selectors) -> Callable[[str], list[dict]]:
    """A function from page text to its item elements, in page order.

    Each item holds its first title, price and link element, if any. Text is put
    together from the stripped pieces between tags. An end tag closes the
    innermost open element of its name, with all that is open inside. The time is
    linear in the page, however deep its elements lie and however broken they are.
    """
    wanted = [selectors.item, *selectors.fields().values()]
    classes = [re.escape(w[1:]) for w in wanted if w.startswith(".")]
    names_class = re.compile("|".join(classes) or r"(?!)").search
    elements = {w for w in wanted if not w.startswith(".")}
    item, *fields = [(field, w.removeprefix("."), w.startswith(".")) for field, w in [("item", wanted[0]), *selectors.fields().items()]]

    def read(html: str) -> list[dict]:
        found: list[dict] = []
        names: list[str] = []  # open elements
        count: dict[str, int] = {}  # how many of each name are open
        lacking: dict[str, list[tuple[int, dict]]] = {field: [] for field, _, _ in fields}  # open items, with their depth
        deepest = -1  # no item that lacks something is deeper
        pieces: list[str] = []  # all text, once a text is being put together
        texts: list[tuple[int, list[int]]] = []  # open texts, with their depth: from and to in ``pieces``
        for before, slash, name, attributes, _, _ in texts_and_tags(html):
            if texts:
                piece = unescape(before).strip()
                if piece:
                    pieces.append(piece)
            if not name:
                continue
            name = name.lower()
            if slash:
                if count.get(name):
                    while (inner := names.pop()) != name:
                        count[inner] -= 1
                    count[name] -= 1
                    depth = len(names)
                    if depth <= deepest:
                        deepest = depth - 1
                        for opened in lacking.values():
                            while opened and opened[-1][0] >= depth:
                                opened.pop()
                    while texts and texts[-1][0] >= depth:
                        texts.pop()[1][1] = len(pieces)
                continue
            leaf = name in VOID or attributes[-1:] == "/"
            if name in elements or (attributes and names_class(attributes)):
                depth = len(names)
                values = _attributes(attributes)
                own = values.get("class", "").split()
                for field, word, by_class in fields:
                    if not lacking[field] or (word not in own if by_class else word != name):
                        continue
                    value = values.get("href")
                    if field != "link":
                        value = [len(pieces), len(pieces) if leaf else -1, pieces]
                        if not leaf:
                            texts.append((depth, value))
                    for _, listing in lacking[field]:
                        listing[field] = value
                    lacking[field].clear()
                if item[1] in own if item[2] else item[1] == name:
                    found.append({})
                    if not leaf:
                        deepest = depth
                        for opened in lacking.values():
                            opened.append((depth, found[-1]))
            if not leaf:
                count[name] = count.get(name, 0) + 1
                names.append(name)
        for _, text in texts:
            text[1] = len(pieces)
        return found

    return read


def _text(listing: dict, field: str) -> str | None:
    if listing.get(field) is None:
        return None
    first, last, pieces = listing[field]
    return "".join(pieces[first:last])


def extract_listings(pages: DataFrame, selectors: Selectors = Selectors()) -> DataFrame:
    """``page_id, position, title, price_text, link, complete`` per item element.

    ``complete`` tells whether all wanted child elements were found; a link
    element without an address is complete and has a null link.
    """
    types = dict(page_id=pa.int64(), position=pa.int32(), title=pa.string(), price_text=pa.string(), link=pa.string(), complete=pa.bool_())
    wanted = len(selectors.fields())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listings_of = listing_reader(selectors)
        for batch in batches:
            columns: list[list] = [[] for _ in types]
            for page_id, html in zip(batch["page_id"].to_pylist(), batch["html"].to_pylist()):
                for place, x in enumerate(listings_of(html), start=1):
                    row = page_id, place, _text(x, "title"), _text(x, "price_text"), x.get("link"), len(x) == wanted
                    for column, value in zip(columns, row):
                        column.append(value)
            arrays = [pa.array(column, kind) for column, kind in zip(columns, types.values())]
            yield pa.RecordBatch.from_arrays(arrays, names=list(types))

    marker = selectors.item.lstrip(".")
    mark = F.contains("html", F.lit(marker)) if selectors.item.startswith(".") else F.contains(
        F.lower("html"), F.lit("<" + marker.lower())
    )
    marked = pages.filter(mark).select("page_id", "html")
    # By page, so that few files of a busy table still keep all cores at work.
    return marked.repartition("page_id").mapInArrow(read, LISTING_SCHEMA)


def complete_listings(listings: DataFrame) -> DataFrame:
    return listings.filter("complete").drop("complete")
