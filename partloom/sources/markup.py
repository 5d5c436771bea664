"""A small element tree for crawled pages.

Pages are rarely well-formed, so SQL ``xpath`` cannot read them. This builds a tree from the standard library's
tokenizer with the usual repairs (void elements, implied end tags) and offers the little selection the page jobs need.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property
from html import unescape
from html.parser import HTMLParser
from itertools import chain

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "template"))
# An opening tag ends any open element named here, up to the nearest of the listed containers.
IMPLIED_END = {
    "li": (("li",), ("ul", "ol")),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
}
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)


class Page:
    """A page's elements in document order, and by tag. A subtree is a slice of that order, so nothing has to be walked to search it."""

    def __init__(self) -> None:
        self.elements: list[Element] = []
        self.nearest: dict[tuple[str, str], list[Element | None]] = {}
        self.hits: dict[tuple, list[Element]] = {}

    @cached_property
    def by_tag(self) -> dict[str, list[Element]]:
        """Sorted when first asked for, from the finished page."""
        found: dict[str, list[Element]] = {}
        for element in self.elements:
            found.setdefault(element.tag, []).append(element)
        return found

    @staticmethod
    def inside(ordered: list[Element], root: Element) -> list[Element]:
        """Those of some elements in document order that lie below ``root``."""
        place = lambda e: e.at
        return ordered[bisect_right(ordered, root.at, key=place) : bisect_left(ordered, root.until, key=place)]


class Element:
    """``at`` is its place in the page's order, ``until`` the place after its last descendant."""

    __slots__ = ("tag", "attrs", "parent", "children", "page", "at", "until")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None, page: Page) -> None:
        self.tag, self.attrs, self.parent, self.children, self.page = tag, attrs, parent, [], page
        elements = page.elements
        self.at = at = len(elements)
        self.until = at + 1
        elements.append(self)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def strings(self) -> Iterator[str]:
        """Text nodes in document order, by a stack: pages nest as deep as they like."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, str):
                    yield child
                elif child.tag not in SILENT:
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def text(self, glue: str = "") -> str:
        """Stripped text nodes, joined; blank ones are skipped."""
        if len(self.children) == 1 and isinstance(self.children[0], str):
            return self.children[0].strip()
        return glue.join(s for s in (part.strip() for part in self.strings()) if s)

    def lines(self) -> str:
        """Text nodes as they are, one per line."""
        return "\n".join(self.strings())

    def find(self, *tags: str) -> list[Element]:
        """Descendants with one of the tags, in document order."""
        found = [Page.inside(self.page.by_tag.get(tag, []), self) for tag in tags]
        return found[0] if len(found) == 1 else sorted(chain.from_iterable(found), key=lambda e: e.at)

    def ancestor(self, tag: str, css_class: str) -> Element | None:
        """The nearest one; found for all elements of the page at once, when first asked for."""
        known = self.page.nearest.get((tag, css_class))
        if known is None:
            known = self.page.nearest[tag, css_class] = []
            for element in self.page.elements:
                parent = element.parent
                fits = parent is not None and parent.tag == tag and css_class in parent.classes
                known.append(parent if fits or parent is None else known[parent.at])
        return known[self.at]


#: Elements without attributes share these; nobody writes to them.
_NO_ATTRS: dict[str, str] = {}


class _Builder(HTMLParser):
    """Builds the tree. Open elements are a stack with the places of each tag in it, so that an end tag, or an implied end, finds
    its partner without going up."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.root = Element("#root", {}, None, self.page)
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}

    def updatepos(self, i: int, j: int) -> int:
        """Lines are not counted: nobody asks where a tag stands."""
        return j

    def _close_from(self, place: int) -> None:
        """End the open elements from this place of the stack on; each is ended once, so this is linear in all."""
        end = len(self.page.elements)
        while len(self.open) > place:
            element = self.open.pop()
            element.until = end
            if element is not self.root:
                self.places[element.tag].pop()

    def _imply_end(self, tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        """End the outermost open element with one of the tags that is inside the nearest container."""
        fence = max((at[-1] for at in map(self.places.get, stop) if at), default=0)
        first = len(self.open)
        for at in map(self.places.get, tags):
            if at:
                i = bisect_right(at, fence)
                if i < len(at):
                    first = min(first, at[i])
        self._close_from(first)

    def imply_ends(self, tag: str) -> None:
        """End what an opening tag ends."""
        if tag in IMPLIED_END:
            self._imply_end(*IMPLIED_END[tag])
        elif tag in ENDS_PARAGRAPH:
            self._imply_end(("p",), ("table", "td", "th", "div", "li"))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.imply_ends(tag)
        parent = self.open[-1]
        element = Element(tag, {k: v or "" for k, v in reversed(attrs)} if attrs else _NO_ATTRS, parent, self.page)
        parent.children.append(element)
        if tag not in VOID:
            at = self.places.get(tag)
            if at is None:
                at = self.places[tag] = []
            at.append(len(self.open))
            self.open.append(element)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        at = self.places.get(tag)
        if at:
            self._close_from(at[-1])

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


# A named reference only counts with its semicolon; a bare ampersand is text.
_BARE_AMPERSAND = re.compile(r"&(?!(?:[A-Za-z][A-Za-z0-9]*;|#[0-9]|#[xX][0-9A-Fa-f]))")


# Plain markup and the text behind it: a script or style up to its end tag, an end tag, a start tag whose attributes have quoted values or
# none, a doctype, a comment. Each is read as the standard tokenizer reads it; whatever is written otherwise is left to that tokenizer.
_ATTR = r"""[ \t\n\r\f]+([a-zA-Z_:@][\w:.-]*+)(?:=("[^"]*+"|'[^']*+'))?+(?=[ \t\n\r\f/>]|\Z)"""
_ATTRS = rf"""((?:{re.sub(r"[(](?![?])", "(?:", _ATTR)})*+)[ \t\n\r\f]*+"""
_PLAIN = re.compile(
    rf"(<(?:(?i:(script|style)){_ATTRS}>((?s:.*?))</\s*(?i:\2)\s*>|/([a-zA-Z][-.a-zA-Z0-9:_]*+)[ \t\n\r\f]*+>|([a-zA-Z][-.a-zA-Z0-9:_]*+){_ATTRS}(/?)>"
    r"|!(?i:doctype)[^>]*+>|!--(?s:.*?)--\s*>))([^<]*+)"
)
_PLAIN_ATTR = re.compile(_ATTR)
_SCRIPTS = frozenset(HTMLParser.CDATA_CONTENT_ELEMENTS)
_CLOSERS = IMPLIED_END.keys() | ENDS_PARAGRAPH


def _attributes(text: str) -> dict[str, str]:
    """The first of several equal names counts."""
    return {k.lower(): unescape(v[1:-1]) if "&" in v else v[1:-1] for k, v in reversed(_PLAIN_ATTR.findall(text))}


def _build_plain(builder: _Builder, html: str) -> bool:
    """Build the tree of a page that is plain markup throughout; false, with the tree unfinished, for any other page."""
    first = html.find("<")
    if first < 0:
        first = len(html)
    tokens = _PLAIN.findall(html, first)
    # What is no token is skipped by the search, so the lengths tell whether the page is tokens throughout.
    if first + sum([len(t[0]) + len(t[-1]) for t in tokens]) != len(html):
        return False
    if first:
        builder.handle_data(unescape(html[:first]))
    page, places, stack, elements = builder.page, builder.places, builder.open, builder.page.elements
    for _, script, script_attrs, content, closed, opened, attrs, empty, text in tokens:
        if opened:
            tag = opened.lower()
            if tag in _CLOSERS:
                builder.imply_ends(tag)
            elif tag in _SCRIPTS and not empty:
                return False
            parent = stack[-1]
            element = Element(tag, _attributes(attrs) if attrs else _NO_ATTRS, parent, page)
            parent.children.append(element)
            if tag not in VOID:
                at = places.get(tag)
                if at is None:
                    at = places[tag] = []
                at.append(len(stack))
                stack.append(element)
        elif closed:
            tag = closed.lower()
            at = places.get(tag)
            if at:
                place = at[-1]
                if place == len(stack) - 1:
                    at.pop()
                    stack.pop().until = len(elements)
                else:
                    builder._close_from(place)
        elif script:
            parent = stack[-1]
            element = Element(script.lower(), _attributes(script_attrs) if script_attrs else _NO_ATTRS, parent, page)
            parent.children.append(element)
            if content:
                element.children.append(content)
        if text:
            stack[-1].children.append(unescape(text) if "&" in text else text)
    return True


def parse(html: str) -> Element:
    """The tree of a page, in time that grows with its length, however deep it is nested."""
    if "&" in html:
        html = _BARE_AMPERSAND.sub("&amp;", html)
    builder = _Builder()
    if not _build_plain(builder, html):
        builder = _Builder()
        builder.feed(html)
        builder.close()
    builder._close_from(0)
    return builder.root


_STEP = re.compile(r"(?P<tag>^[a-zA-Z][\w-]*|^\*)|\.(?P<css>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)\]")


class Selector:
    """Tag, ``.class``, ``#id`` and ``[attribute]`` tests, combined by descent (blank)."""

    def __init__(self, css: str) -> None:
        self.steps = []
        for step in css.split():
            tests = [m.groupdict() for m in _STEP.finditer(step)]
            if "".join(m.group(0) for m in _STEP.finditer(step)) != step:
                raise ValueError(f"unsupported selector: {css}")
            self.steps.append(tests)
        if not self.steps:
            raise ValueError("empty selector")
        self.key = tuple(css.split())

    @staticmethod
    def _candidates(page: Page, tests: list[dict]) -> list[Element]:
        """Elements that fit a step, in document order; a tag, or the attributes it asks for, leaves few to look at."""
        tag = next((t["tag"].lower() for t in tests if t["tag"] and t["tag"] != "*"), None)
        found = page.elements if tag is None else page.by_tag.get(tag, [])
        for test in tests:
            if test["css"]:
                found = [e for e in found if e.attrs and test["css"] in e.classes]
            elif test["id"]:
                found = [e for e in found if e.attrs.get("id") == test["id"]]
            elif test["attr"]:
                found = [e for e in found if test["attr"] in e.attrs]
        return found

    def _hits(self, page: Page) -> list[Element]:
        """All matches of a page: the elements that fit a step and lie below one that is left of the step before."""
        hits = page.hits.get(self.key)
        if hits is None:
            hits = self._candidates(page, self.steps[0])
            for tests in self.steps[1:]:
                above, hits, until = iter(hits), [], 0
                upper = next(above, None)
                for element in self._candidates(page, tests):
                    while upper is not None and upper.at < element.at:
                        until = max(until, upper.until)
                        upper = next(above, None)
                    if element.at < until:
                        hits.append(element)
            page.hits[self.key] = hits
        return hits

    def all(self, root: Element) -> list[Element]:
        return Page.inside(self._hits(root.page), root)

    def first(self, root: Element) -> Element | None:
        return next(iter(self.all(root)), None)
