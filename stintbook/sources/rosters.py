"""Roster rows of many pages at once.

Pages in which every mark is written in the plain form of ``html`` and is closed in order are read
together. Their marks are numbers in arrays, an element is the span from its mark to the one that
closes it, and a selector is a test of spans. Other pages are left to the element tree.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stintbook.sources.html import _ENDS, _NAME, _PAIR, _PAIRS, _RAW, _VOID

_START = re.compile(rf"<({_NAME})((?:{_PAIR})*+)[ \t\n]*+/?>")
_END = re.compile(rf"</({_NAME})>")
_BAD, _OPENS, _ALONE, _CLOSES = range(4)

# What selectors ask for, as bits: tags, ids, classes (some with a tag) and attributes.
_BITS = {
    name: 1 << i
    for i, name in enumerate(
        "a abbr div h2 i img li span #firstHeading #Player_Roster #Organization .nav-tabs"
        " .roster-card .flag .LargeStuff .MobileStuffDate tr.Player td.ID td.Name td.Position"
        " td.Date div.infobox-description [href] [title] captain content ends".split()
    )
}
# Marks that are remembered, and different names of elements.
_MOST_SEEN, _MOST_NAMES = 50_000, 5_000
_BYTES_AT_ONCE = 1 << 22
_DEEPEST = 1_000

# A path and query that urljoin only puts behind the host.
_PATH = (
    r"^(?:/[A-Za-z0-9_%~:@!$&'()*+,=-][A-Za-z0-9_%~:@!$&'()*+,=.-]*)+"
    r"(?:\?[A-Za-z0-9_%~:@!$&'()*+,=./-]+)?$"
)
_HOST = r"^(?P<host>https?://[A-Za-z0-9.-]+)(?:/[^\x00-\x20]*)?$"
_STRIPPED = r"^[!-~](?:[ -~]*[!-~])?$"


class _Mark(NamedTuple):
    kind: int
    name: int = 0
    bits: int = 0
    href: str | None = None
    title: str | None = None
    content: str | None = None
    tab: str | None = None


_seen: dict[str, _Mark] = {}
_names: dict[str, int] = {}


def _mark(text: str) -> _Mark:
    found = _seen.get(text)
    if found is None:
        if len(_seen) >= _MOST_SEEN:
            _seen.clear()
        found = _seen[text] = _read_mark(text)
    return found


def _read_mark(text: str) -> _Mark:
    closing = _END.fullmatch(text)
    opening = None if closing else _START.fullmatch(text)
    if not (closing or opening):
        return _Mark(_BAD)
    tag = (closing or opening).group(1).lower()
    if tag in _RAW or tag == "base" or (tag not in _names and len(_names) >= _MOST_NAMES):
        return _Mark(_BAD)
    name = _names.setdefault(tag, len(_names))
    if closing:
        return _Mark(_BAD) if tag in _VOID else _Mark(_CLOSES, name)
    attrs = {n.lower(): unescape(v) for n, v in _PAIRS.findall(opening.group(2))}
    classes = attrs.get("class", "")
    content = re.search(r"content(\d+)", classes)
    tab = re.search(r"tab(\d+)", classes)
    words = {tag, "#" + attrs.get("id", "")}
    for c in classes.split():
        words |= {f".{c}", f"{tag}.{c}"}
    words |= {f"[{n}]" for n in ("href", "title") if n in attrs}
    words |= {"captain"} if tag == "i" and attrs.get("title") == "Captain" else set()
    words |= {"content"} if content else set()
    words |= {"ends"} if tag in _ENDS else set()
    return _Mark(
        _ALONE if tag in _VOID else _OPENS,
        name,
        sum(_BITS.get(w, 0) for w in words),
        attrs.get("href"),
        attrs.get("title"),
        content.group(1) if content else None,
        tab.group(1) if tab else None,
    )


class _Pages:
    """The marks of the pages that can be read together; the others are ``left``."""

    def __init__(self, htmls: pa.StringArray) -> None:
        n = len(htmls)
        at = np.frombuffer(htmls.buffers()[1], np.int32)[htmls.offset : htmls.offset + n + 1]
        data = htmls.buffers()[2]
        text = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
        at = (at - at[0]).astype(np.int64)
        first = np.flatnonzero(text == ord("<"))
        over = np.append(np.flatnonzero(text == ord(">")) + 1, len(text))
        page = np.searchsorted(at, first, "right") - 1
        following = np.append(first[1:], len(text))[: len(first)]
        end = over[np.searchsorted(over, first, "right")] if len(first) else first
        end = np.minimum(np.minimum(end, following), at[page + 1])
        cuts = np.empty(2 * len(first) + 1, np.int32)
        cuts[:-1:2], cuts[1::2], cuts[-1] = first, end, len(text)
        # a mark, the text after it, the next mark, ...
        self.strings = pa.StringArray.from_buffers(
            2 * len(first), pa.py_buffer(cuts), pa.py_buffer(text)
        )
        marks = self.strings.take(pa.array(np.arange(0, 2 * len(first), 2))).dictionary_encode()
        self.different = [_mark(m) for m in marks.dictionary.to_pylist()]
        code = marks.indices.to_numpy()
        kind = np.array([m.kind for m in self.different], np.int8)[code]

        left = np.zeros(n, bool)
        left[page[kind == _BAD]] = True
        if len(text) and not text.all():
            left |= pc.match_substring(htmls, "\0").to_numpy(zero_copy_only=False)
        depth = np.cumsum(np.array([0, 1, 0, -1])[kind])
        begin = np.append(0, depth)[np.searchsorted(page, np.arange(n + 1))]
        left |= begin[1:] != begin[:-1]
        level = depth - begin[page] + (kind != _OPENS)
        left[page[(level < 1) | (level > _DEEPEST)]] = True

        self.left = left
        name = np.array([m.name for m in self.different], np.int32)[code]
        bits = np.array([m.bits for m in self.different], np.int32)[code]
        self.name, self.bits, self.code, self.page, self.kind = name, bits, code, page, kind
        self.level, self.slot, self.has_text = level, np.arange(len(first)), end < following
        while True:
            self._keep(~left[self.page])
            wrong = self._pair()
            if not len(wrong):
                break
            left[wrong] = True

    def _keep(self, kept: np.ndarray) -> None:
        if not kept.all():
            for name in ("name", "bits", "code", "page", "kind", "level", "slot", "has_text"):
                setattr(self, name, getattr(self, name)[kept])
        self.count = len(self.page)

    def _pair(self) -> np.ndarray:
        """Find the end of each element; returns pages in which marks are not closed in order."""
        of_level = np.argsort(self.level.astype(np.int16), kind="stable")
        of_level = of_level[self.kind[of_level] != _ALONE]
        self.opening, closing = of_level[::2], of_level[1::2]
        self.end = np.arange(1, self.count + 1)
        self.end[self.opening] = closing
        self._ordered = self.level[self.opening] * (self.count + 1) + self.opening
        wrong = [self.page[self.opening[self.name[self.opening] != self.name[closing]]]]
        # elements that would end the one they stand in
        inner = self.where("ends")
        outer = self.parent(inner)
        inner, outer = inner[outer >= 0], outer[outer >= 0]
        for tag, ended in _ENDS.items():
            if tag in _names:
                codes = [_names[e] for e in ended if e in _names]
                hit = (self.name[inner] == _names[tag]) & np.isin(self.name[outer], codes)
                wrong.append(self.page[inner[hit]])
        return np.unique(np.concatenate(wrong))

    def parent(self, marks: np.ndarray) -> np.ndarray:
        """The element around each mark; -1 at the top."""
        level = self.level[marks] - 1
        found = np.searchsorted(self._ordered, level * (self.count + 1) + marks) - 1
        return np.where(level > 0, np.append(self.opening, -1)[found], -1)

    def where(self, what: str, inside: np.ndarray | None = None) -> np.ndarray:
        hit = (self.bits & _BITS[what]) != 0
        return np.flatnonzero(hit if inside is None else hit & inside)

    def below(self, elements: np.ndarray, itself: bool = False) -> np.ndarray:
        """Which marks lie inside one of the elements."""
        return self._around(elements, itself) > 0

    def _around(self, elements: np.ndarray, itself: bool) -> np.ndarray:
        change = np.zeros(self.count + 1, np.int32)
        np.add.at(change, elements + (not itself), 1)
        np.subtract.at(change, self.end[elements], 1)
        return np.cumsum(change[: self.count], dtype=np.int32)

    def nested(self, elements: np.ndarray) -> np.ndarray:
        """Pages in which one of the elements lies in another."""
        return self.page[elements[self.below(elements)[elements]]]

    def scope_of(self, elements: np.ndarray) -> np.ndarray:
        """For each mark the number of the element it lies in or begins; -1 in none."""
        last = np.cumsum(np.bincount(elements, minlength=self.count)[: self.count]) - 1
        if not len(elements):
            return last
        return np.where(np.arange(self.count) < self.end[elements][last], last, -1)

    def note_texts(self) -> None:
        """Texts with the element each stands in."""
        texts = np.flatnonzero(self.has_text)
        around = np.where(self.kind[texts] == _OPENS, texts, -1)
        late = np.flatnonzero(around < 0)
        around[late] = self.parent(texts[late])
        self.texts = texts
        self._of_element = texts[around >= 0], around[around >= 0]

    def first_text(self, elements: np.ndarray, scope: np.ndarray, scopes: int) -> pa.Array:
        """The first own text among the elements of each scope."""
        texts, around = self._of_element
        wanted = np.zeros(self.count, bool)
        wanted[elements] = True
        hit = wanted[around]
        texts, around = texts[hit], around[hit]
        order = np.lexsort((texts, around))
        return self.text(_first(texts[order], scope[around[order]], scopes))

    def text(self, marks: np.ndarray) -> pa.Array:
        """The text after each mark; null where that is -1."""
        at = 2 * np.append(self.slot, 0)[marks] + 1
        found = self.strings.take(pa.array(at, mask=marks < 0))
        if pc.any(pc.match_substring(found, "&")).as_py():
            plain = [unescape(t) if t and "&" in t else t for t in found.to_pylist()]
            found = pa.array(plain, pa.string())
        return found

    def attr(self, name: str, marks: np.ndarray) -> pa.Array:
        values = pa.array([getattr(m, name) for m in self.different], pa.string())
        return values.take(pa.array(np.append(self.code, 0)[marks], mask=marks < 0))

    def texts_in(self, elements: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """All texts in the elements, and how many each has."""
        first = np.searchsorted(self.texts, elements)
        size = np.searchsorted(self.texts, self.end[elements]) - first
        return self.text(self.texts[_ranges(first, size)]), size

    def joined_texts(self, elements: np.ndarray) -> pa.Array:
        every, size = self.texts_in(elements)
        if (size == 1).all():
            return every
        ends = pa.array(np.append(0, np.cumsum(size)), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(ends, every), "")


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of each range, one range after the other."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def _offsets(scope: np.ndarray, scopes: int) -> pa.Array:
    """Where the values of each scope begin, as lists have it."""
    return pa.array(np.append(0, np.cumsum(np.bincount(scope, minlength=scopes))), pa.int32())


def _first(values: np.ndarray, scope: np.ndarray, scopes: int) -> np.ndarray:
    """The first value of each scope, where scopes stand in order; else -1."""
    found = np.full(scopes, -1, np.int64)
    if len(values):
        begins = np.append(True, scope[1:] != scope[:-1])
        found[scope[begins]] = values[begins]
    return found


def _sections(pages: _Pages, n: int) -> np.ndarray:
    """Blocks after the player heading, up to the one about the organisation."""
    heading = pages.where("#Player_Roster")
    holder = pages.parent(heading)
    heading, holder = heading[holder >= 0], holder[holder >= 0]
    level, after, until = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    page, outer = pages.page[holder], pages.parent(holder)
    level[page], after[page] = pages.level[holder], pages.end[holder]
    last = np.searchsorted(pages.page, page, "right")
    until[page] = np.where(outer >= 0, np.append(pages.end, 0)[outer], last)
    block = np.flatnonzero(pages.bits & (_BITS["div"] | _BITS["h2"]))
    page = pages.page[block]
    beside = (pages.level[block] == level[page]) & (block > after[page]) & (block < until[page])
    block = block[beside]
    other = pages.where("#Organization", pages.below(block, itself=True))
    limit = _first(other, pages.page[other], n)
    limit[limit < 0] = pages.count + 1
    is_div = (pages.bits[block] & _BITS["div"]) != 0
    return block[is_div & (pages.end[block] < limit[pages.page[block]])]


def _tabs(pages: _Pages, inside: np.ndarray, n: int) -> pa.Array:
    tabs = pages.where("li", pages.below(pages.where(".nav-tabs", inside)))
    numbers, texts = pages.attr("tab", tabs), pages.joined_texts(tabs)
    texts = _stripped(texts, texts)
    named = pc.and_(pc.is_valid(numbers), pc.starts_with(texts, "CS"))
    page, numbers, texts = (x.filter(named) for x in (pa.array(pages.page[tabs]), numbers, texts))
    # of several with one number the first
    page, codes = page.to_numpy(), numbers.dictionary_encode().indices.to_numpy()
    _, first = np.unique(page * (len(page) + 1) + codes, return_index=True)
    first = np.sort(first)
    taken = pa.array(first)
    return pa.MapArray.from_arrays(_offsets(page[first], n), numbers.take(taken), texts.take(taken))


def _games(pages: _Pages, n: int) -> pa.Array:
    """Link texts beside the "Games:" caption."""
    caption = pages.where("div.infobox-description")
    said = pc.match_substring(pages.joined_texts(caption), "Games:")
    box = np.unique(pages.parent(caption[said.to_numpy(zero_copy_only=False)]))
    box = box[(box >= 0) & ((np.append(pages.bits, 0)[box] & _BITS["div"]) != 0)]
    link = pages.where("a")
    first = np.searchsorted(link, box)
    # a link in two boxes counts in both
    link = link[_ranges(first, np.searchsorted(link, pages.end[box]) - first)]
    texts, size = pages.texts_in(link)
    return pa.ListArray.from_arrays(_offsets(np.repeat(pages.page[link], size), n), texts)


def _joined(urls: pa.Array, hrefs: pa.Array) -> pa.Array:
    """Absolute links; null without one."""
    host = pc.struct_field(pc.extract_regex(urls, _HOST), "host")
    plain = pc.and_(pc.match_substring_regex(hrefs, _PATH), pc.is_valid(host))
    plain = pc.fill_null(plain, False)
    found = pc.if_else(plain, pc.binary_join_element_wise(host, hrefs, ""), None)
    rest = pc.invert(plain)
    values = zip(urls.filter(rest).to_pylist(), hrefs.filter(rest).to_pylist())
    said = [(url, (href or "").strip()) for url, href in values]
    joined = [urljoin(url, href) if href else None for url, href in said]
    return pc.replace_with_mask(found, rest, pa.array(joined, pa.string()))


def _stripped(texts: pa.Array, instead: pa.Array) -> pa.Array:
    """Texts without white space around; those that are empty are taken from ``instead``."""
    rest = pc.invert(pc.fill_null(pc.match_substring_regex(texts, _STRIPPED), False))
    values = zip(texts.filter(rest).to_pylist(), instead.filter(rest).to_pylist())
    stripped = [(text or "").strip() or other for text, other in values]
    return pc.replace_with_mask(texts, rest, pa.array(stripped, pa.string()))


def slices(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """Parts of a batch of about the bytes that are read at once."""
    size = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
    cut = np.flatnonzero(np.diff(np.cumsum(size) // _BYTES_AT_ONCE)) + 1
    edges = [0, *cut.tolist(), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a]


def roster_columns(
    batch: pa.RecordBatch, schema: pa.Schema
) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows of the pages ``(page_id, url, html)`` that can be read together, and the numbers of the
    pages that can't."""
    n = batch.num_rows
    urls, htmls = (batch.column(c).cast(pa.string()) for c in (1, 2))
    pages = _Pages(htmls)
    heading = pages.where("#Player_Roster")
    twice = np.bincount(pages.page[heading], minlength=n)[pages.page[heading]] > 1
    sections = _sections(pages, n)
    inside = pages.below(sections, itself=True)
    cards = pages.where(".roster-card", inside)
    rows = pages.where("tr.Player", pages.below(cards, itself=True))
    cells = pages.where("td.Date", pages.below(rows))
    contents = pages.where("content")
    # what would be found twice or in another place
    left = pages.left
    left[pages.page[heading[twice]]] = True
    for elements in (cards, rows, cells, contents):
        left[pages.nested(elements)] = True
    rows, cells = rows[~left[pages.page[rows]]], cells[~left[pages.page[cells]]]
    if not len(rows):
        return pa.RecordBatch.from_pylist([], schema=schema), np.flatnonzero(left)

    pages.note_texts()
    page, size = pages.page[rows], len(rows)
    row_of, cell_of = pages.scope_of(rows), pages.scope_of(cells)
    in_row, in_cell = row_of >= 0, cell_of >= 0
    in_id = pages.below(pages.where("td.ID", in_row))
    in_name = pages.below(pages.where("td.Name", in_row))
    in_position = pages.below(pages.where("td.Position", in_row))
    links = pages.where("a", in_id)
    with_href = links[(pages.bits[links] & _BITS["[href]"]) != 0]
    images = pages.where("img", pages.below(pages.where(".flag", in_id)))
    images = images[(pages.bits[images] & _BITS["[title]"]) != 0]
    captains = np.zeros(size, bool)
    captains[row_of[pages.where("captain", in_id)]] = True
    content = np.searchsorted(contents, rows) - 1
    content = np.where(content >= 0, np.append(contents, -1)[content], -1)
    content[(content >= 0) & (np.append(pages.end, 0)[content] < rows)] = -1
    spans = pages.where("span", pages.below(pages.where("#firstHeading")))
    italics = pages.where("i", in_cell)
    abbreviated = pages.where("abbr", pages.below(italics))

    def first_text(elements: np.ndarray) -> pa.Array:
        return pages.first_text(elements, row_of, size)

    def of_cells(elements: np.ndarray) -> pa.Array:
        return pages.first_text(elements, cell_of, len(cells))

    taken = pa.array(page)
    shown = _stripped(of_cells(italics), of_cells(abbreviated))
    cell = pa.StructArray.from_arrays(
        [of_cells(pages.where(".MobileStuffDate", in_cell)), shown],
        fields=list(schema.field("cells").type.value_type),
    )
    own_urls = urls.take(taken)
    hrefs = pages.attr("href", _first(with_href, row_of[with_href], size))
    columns = {
        "page_id": batch.column(0).take(taken),
        "url": own_urls,
        "heading": pages.first_text(spans, pages.page, n).take(taken),
        "tabs": _tabs(pages, inside, n).take(taken),
        "games": _games(pages, n).take(taken),
        "content_no": pages.attr("content", content),
        "in_content": pa.array(content >= 0),
        "href": _joined(own_urls, hrefs),
        "nickname": first_text(links),
        "full_name": first_text(pages.where(".LargeStuff", in_name)),
        "is_captain": pa.array(captains),
        "position": first_text(pages.where("i", in_position)),
        "flag_name": pages.attr("title", _first(images, row_of[images], size)),
        "cells": pa.ListArray.from_arrays(_offsets(row_of[cells], size), cell),
    }
    arrays = [columns[f.name].cast(f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema), np.flatnonzero(left)
