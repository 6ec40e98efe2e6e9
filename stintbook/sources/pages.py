"""Roster records and links from stored wiki pages.

Python only turns one page into flat rows of text. Dates, ids, game versions and null rules
are column expressions on those rows.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stintbook.functions.dates import columns_of_read, read_cells
from stintbook.functions.text import clean_id, name_from_url, strip, strip_or_null
from stintbook.schema import ROSTER_FEED
from stintbook.sources import html as html_tree
from stintbook.sources import rosters
from stintbook.sources.html import Element, Has, Test, parse, select

# The parsing code travels with the job, so executors need not have this package installed.
for _module in (html_tree, rosters, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)

_LINKS = "page_id bigint, url string, kind string, href string, link string"
_ROWS = """
    page_id bigint, url string, heading string, tabs map<string, string>,
    games array<string>, content_no string, in_content boolean, href string,
    nickname string, full_name string, is_captain boolean, position string,
    flag_name string, cells array<struct<label: string, text: string>>
"""
_LINKS_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("kind", pa.string()),
        ("href", pa.string()),
        ("link", pa.string()),
    ]
)
_ROWS_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("heading", pa.string()),
        ("tabs", pa.map_(pa.string(), pa.string())),
        ("games", pa.list_(pa.string())),
        ("content_no", pa.string()),
        ("in_content", pa.bool_()),
        ("href", pa.string()),
        ("nickname", pa.string()),
        ("full_name", pa.string()),
        ("is_captain", pa.bool_()),
        ("position", pa.string()),
        ("flag_name", pa.string()),
        ("cells", pa.list_(pa.struct([("label", pa.string()), ("text", pa.string())]))),
    ]
)
_ROWS_PER_BATCH = 2000


def _tag(name: str) -> Test:
    return Has("tag", name)


def _id(value: str) -> Test:
    return Has("id", value)


def _class(name: str, tag: str | None = None) -> Test:
    return Has("class", name, tag)


def _first_text(elements: list[Element]) -> str | None:
    return next((text for e in elements for text in e.own_texts()), None)


def _first_attr(elements: list[Element], name: str) -> str | None:
    return next((e.attrs[name] for e in elements if name in e.attrs), None)


def _base_url(page: Element, url: str) -> str:
    declared = _first_attr(select(page, _tag("base")), "href")
    return urljoin(url, declared) if declared else url


def _category_links(page: Element, url: str) -> Iterator[dict]:
    """Team links of a category page, and the link to the next page."""
    base = _base_url(page, url)
    for link in select(page, _id("mw-pages"), _class("mw-content-ltr"), _tag("a")):
        if "href" in link.attrs:
            yield _link("team", link.attrs["href"], base)
    following = [
        e for e in select(page, _id("mw-pages"), _tag("a")) if "next page" in "".join(e.all_texts())
    ]
    href = _first_attr(following, "href")
    if href is not None:
        yield _link("next", href, base)


def _any_links(page: Element, url: str) -> Iterator[dict]:
    base = _base_url(page, url)
    for link in select(page, _tag("a")):
        if "href" in link.attrs:
            yield _link("link", link.attrs["href"], base)


def _link(kind: str, href: str, base: str) -> dict:
    return {"kind": kind, "href": href, "link": urljoin(base, href)}


def _roster_sections(page: Element) -> list[Element]:
    """Blocks after the player heading, up to the one about the organisation."""
    following: set[int] = set()
    for heading in select(page, _id("Player_Roster")):
        holder = heading.parent
        if holder is None or holder.parent is None:
            continue
        siblings = [c for c in holder.parent.children if isinstance(c, Element)]
        place = next(i for i, c in enumerate(siblings) if c is holder)
        following.update(c.begin for c in siblings[place + 1 :] if c.tag in ("div", "h2"))
    sections = []
    for element in (page.page[i] for i in sorted(following)):
        if select(element, _id("Organization")):
            break
        if element.tag == "div":
            sections.append(element)
    return sections


def _tab_names(sections: list[Element]) -> dict[str, str]:
    names: dict[str, str] = {}
    for section in sections:
        for tab in select(section, _class("nav-tabs"), _tag("li")):
            number = re.search(r"tab(\d+)", tab.attrs.get("class", ""))
            text = "".join(tab.all_texts()).strip()
            if number and text.startswith("CS"):
                names.setdefault(number.group(1), text)
    return names


def _infobox_games(page: Element) -> list[str]:
    """Link texts beside the "Games:" caption."""
    captions = [
        e
        for e in select(page, _class("infobox-description", "div"))
        if "Games:" in "".join(e.all_texts())
    ]
    boxes = {e.parent.begin: e.parent for e in captions if e.parent and e.parent.tag == "div"}
    links = [link for i in sorted(boxes) for link in select(boxes[i], _tag("a"))]
    return [text for link in links for text in link.all_texts()]


def _roster_rows(page: Element, url: str) -> Iterator[dict]:
    sections = _roster_sections(page)
    if not sections:
        return
    base = _base_url(page, url)
    shared = {
        "heading": _first_text(select(page, _id("firstHeading"), _tag("span"))),
        "tabs": list(_tab_names(sections).items()),
        "games": _infobox_games(page),
    }
    cards = [card for s in sections for card in select(s, _class("roster-card"))]
    for row in (row for card in cards for row in select(card, _class("Player", "tr"))):
        numbers = (re.search(r"content(\d+)", a.attrs.get("class", "")) for a in row.ancestors())
        content = next((n.group(1) for n in numbers if n), None)
        id_cell = _class("ID", "td")
        href = (_first_attr(select(row, id_cell, _tag("a")), "href") or "").strip()
        titles = select(row, id_cell, _class("flag"), _tag("img"))
        yield shared | {
            "content_no": content,
            "in_content": content is not None,
            "href": urljoin(base, href) if href else None,
            "nickname": _first_text(select(row, id_cell, _tag("a"))),
            "full_name": _first_text(select(row, _class("Name", "td"), _class("LargeStuff"))),
            "is_captain": any(
                e.attrs.get("title") == "Captain" for e in select(row, id_cell, _tag("i"))
            ),
            "position": _first_text(select(row, _class("Position", "td"), _tag("i"))),
            "flag_name": _first_attr(titles, "title"),
            "cells": [
                {
                    "label": _first_text(select(cell, _class("MobileStuffDate"))),
                    "text": (_first_text(select(cell, _tag("i"))) or "").strip()
                    or _first_text(select(cell, _tag("i"), _tag("abbr"))),
                }
                for cell in select(row, _class("Date", "td"))
            ],
        }


def _page_job(
    rows_of: Callable[[Element, str], Iterator[dict]], schema: pa.Schema
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html = (batch.column(c)[i].as_py() for c in range(3))
                own = {"page_id": page_id, "url": url}
                rows += [own | row for row in rows_of(parse(html), url)]
                if len(rows) >= _ROWS_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _roster_job(
    schema: pa.Schema,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pages that can be read together, then the others one by one."""
    one_by_one = _page_job(_roster_rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rosters.slices(batch):
                rows, left = rosters.roster_columns(part, schema)
                yield rows
                if len(left):
                    yield from one_by_one(iter([part.take(pa.array(left))]))

    return run


def _read(pages: DataFrame) -> DataFrame:
    """Pages with a text. All of them are parsed: marks in raw text can be written in many ways."""
    return pages.select("page_id", "url", "html").filter(F.col("html").isNotNull())


def page_links(pages: DataFrame, category: bool = True) -> DataFrame:
    """Absolute links of pages ``(page_id, url, html)``, without links to user pages.

    With ``category`` only the listing of a category page is read, and its link to the next
    page; otherwise every link of the page.
    """

    rows_of = _category_links if category else _any_links
    found = _read(pages).mapInArrow(_page_job(rows_of, _LINKS_ARROW), _LINKS)
    return found.filter((F.col("kind") == "next") | ~F.col("href").contains("User:")).drop("href")


def roster_rows(pages: DataFrame) -> DataFrame:
    """Player rows of team pages as plain text, one row per table row.

    ``page_id`` is a number or a string.
    """
    if pages.schema["page_id"].dataType == StringType():
        arrow = _ROWS_ARROW.set(0, pa.field("page_id", pa.string()))
        schema = _ROWS.replace("page_id bigint", "page_id string", 1)
    else:
        arrow, schema = _ROWS_ARROW, _ROWS
    return _read(pages).mapInArrow(_roster_job(arrow), schema)


def extract_feed(pages: DataFrame) -> DataFrame:
    """Roster feed records from team pages."""
    return extract_records(pages).select(*ROSTER_FEED.names)


def extract_records(pages: DataFrame) -> DataFrame:
    """Roster feed records with the ``page_id`` they come from."""
    rows = roster_rows(pages).withColumn("cells", read_cells(F.col("cells")))
    tab = F.try_element_at("tabs", F.col("content_no"))
    only_game = F.when(F.size("games") == 1, F.get("games", F.lit(0)))
    nickname = F.coalesce(strip(F.col("nickname")), F.lit(""))
    name = F.coalesce(name_from_url(F.col("href")), F.lit(""))
    dates = columns_of_read(F.col("cells"))
    return rows.select(
        "page_id",
        clean_id(F.coalesce(name_from_url(F.col("url")), F.lit(""))).alias("team_unique_name"),
        F.col("heading").alias("team_name"),
        F.col("url").alias("team_url"),
        clean_id(F.coalesce(F.nullif(name, F.lit("")), nickname)).alias("player_unique_id"),
        F.when(F.col("in_content"), tab).otherwise(only_game).alias("game_version"),
        nickname.alias("player_id"),
        strip_or_null(F.col("full_name")).alias("full_name"),
        F.col("href").alias("player_url"),
        "is_captain",
        strip_or_null(F.col("position")).alias("position"),
        strip_or_null(F.col("flag_name")).alias("flag_name"),
        *[column.alias(name) for name, column in dates.items()],
    )
