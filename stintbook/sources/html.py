"""A small element tree over the standard library's HTML parser.

That parser takes most of the time of an extraction, so pages in which every mark is written in the
plainest way are cut into marks by one regular expression. All others go through the parser, and
both ways build the tree with the same code.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

# Elements without an end tag, and open elements a new element ends.
_VOID = frozenset(
    "area base br col embed hr img input link meta source track wbr".split()
)
_ENDS = {
    "li": {"li"},
    "p": {"p"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
}


class Element:
    """An element that knows the span of its own subtree in the page's document order."""

    __slots__ = ("tag", "attrs", "classes", "parent", "children", "page", "begin", "end")

    def __init__(
        self, tag: str, attrs: dict[str, str], parent: Element | None, page: Page
    ) -> None:
        self.tag = tag
        self.attrs = attrs
        self.classes = attrs["class"].split() if "class" in attrs else ()
        self.parent = parent
        self.children: list[Element | str] = []
        self.page = page
        self.begin = len(page)
        self.end = self.begin + 1
        page.append(self)

    def below(self) -> list[Element]:
        """All elements inside this one, in document order."""
        return self.page[self.begin + 1 : self.end]

    def own_texts(self) -> list[str]:
        return [c for c in self.children if isinstance(c, str)]

    def all_texts(self) -> list[str]:
        stack: list[Element | str] = [self]
        found = []
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                found.append(node)
            else:
                stack.extend(reversed(node.children))
        return found

    def ancestors(self) -> Iterator[Element]:
        element = self.parent
        while element is not None:
            yield element
            element = element.parent


class Page(list):
    """A page's elements in document order, and where those with a tag, id or class stand."""

    def __init__(self) -> None:
        super().__init__()
        self.places: dict[str, dict[str, list[int]]] = {"tag": {}, "id": {}, "class": {}}

    def note_places(self) -> None:
        tags, ids, classes = self.places.values()
        for i, element in enumerate(self):
            tags.setdefault(element.tag, []).append(i)
            if element.attrs:
                if "id" in element.attrs:
                    ids.setdefault(element.attrs["id"], []).append(i)
                for name in set(element.classes):
                    classes.setdefault(name, []).append(i)


class Has:
    """Test for a tag, id or class (also with a tag), which ``select`` looks up."""

    __slots__ = ("kind", "value", "tag")

    def __init__(self, kind: str, value: str, tag: str | None = None) -> None:
        self.kind = kind
        self.value = value
        self.tag = tag

    def between(self, page: Page, begin: int, end: int) -> list[Element]:
        places = page.places[self.kind].get(self.value)
        if not places:
            return []
        first = bisect_left(places, begin)
        found = [page[i] for i in places[first : bisect_left(places, end, first)]]
        return [e for e in found if e.tag == self.tag] if self.tag else found


Test = Callable[[Element], bool] | Has


def _between(test: Test, page: Page, begin: int, end: int) -> list[Element]:
    if isinstance(test, Has):
        return test.between(page, begin, end)
    return [e for e in page[begin:end] if test(e)]


def select(scope: Element, *path: Test) -> list[Element]:
    """Elements matching the last test that lie below matches of the earlier ones.

    The scope itself can match the first test. The result is in document order.
    """
    page = scope.page
    found = _between(path[0], page, scope.begin, scope.end)
    for test in path[1:]:
        if len(found) == 1:
            found = _between(test, page, found[0].begin + 1, found[0].end)
        elif found:
            inner = {e.begin: e for o in found for e in _between(test, page, o.begin + 1, o.end)}
            found = [inner[i] for i in sorted(inner)]
    return found


class _Tree:
    """Takes the marks of a page one by one."""

    def __init__(self) -> None:
        self.page = Page()
        self.open = Element("", {}, None, self.page)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in _ENDS:
            while self.open.tag in _ENDS[tag]:
                self.open = self.open.parent
        element = Element(tag, attrs, self.open, self.page)
        self.open.children.append(element)
        if tag not in _VOID:
            self.open = element

    def end(self, tag: str) -> None:
        element: Element | None = self.open
        if element.tag == tag and element.parent is not None:
            self.open = element.parent
            return
        while element is not None and element.tag != tag:
            element = element.parent
        if element is not None and element.parent is not None:
            self.open = element.parent

    def text(self, data: str) -> None:
        children = self.open.children
        if children and isinstance(children[-1], str):
            children[-1] += data
        else:
            children.append(data)

    def closed(self) -> Element:
        for element in reversed(self.page):
            if element.parent is not None:
                if element.end > element.parent.end:
                    element.parent.end = element.end
        self.page.note_places()
        return self.page[0]


class _Parser(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tree = _Tree()

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not needed

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tree.start(tag, {name: value or "" for name, value in attrs})

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tree.end(tag)

    def handle_data(self, data: str) -> None:
        self.tree.text(data)


# Attributes in double quotes, without marks or references that parsers read in different ways.
_VALUE = r'[^"<>&\0]*+(?:&(?:amp|lt|gt|quot|#39);[^"<>&\0]*+)*+'
_PAIR = r'[ \t\n]++[a-zA-Z][a-zA-Z0-9_-]*+="' + _VALUE + '"'
_NAME = "[a-zA-Z][a-zA-Z0-9]*+"
# A text, a start with its attributes, an end, or a character that is none of them.
_MARKS = re.compile(
    rf"([^<\0]++)|<({_NAME})((?:{_PAIR})*+)[ \t\n]*+/?>|</({_NAME})>|(.)", re.DOTALL
)
_PAIRS = re.compile(rf'([a-zA-Z][a-zA-Z0-9_-]*+)="({_VALUE})"')
# Fixed value: elements whose text is not cut into marks, in any version of the parser.
_RAW = frozenset(
    "iframe math noembed noframes noscript plaintext script style svg textarea title xmp".split()
)


def _plain_tree(html: str) -> _Tree | None:
    """The tree of a page in the plainest form; None if it is not in that form."""
    if "<!" in html:
        return None
    tree = _Tree()
    for text, tag, pairs, ended, other in _MARKS.findall(html):
        if text:
            tree.text(unescape(text) if "&" in text else text)
        elif ended:
            tree.end(ended.lower())
        elif other:
            return None
        else:
            tag = tag.lower()
            if tag in _RAW:
                return None
            attrs = {}
            if pairs:
                for name, value in _PAIRS.findall(pairs):
                    attrs[name.lower()] = unescape(value) if "&" in value else value
            tree.start(tag, attrs)
    return tree


def parse(html: str) -> Element:
    tree = _plain_tree(html)
    if tree is None:
        parser = _Parser()
        parser.feed(html)
        parser.close()
        tree = parser.tree
    return tree.closed()
