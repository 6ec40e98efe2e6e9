"""Partly known dates: strict parsing, repair, and the raw text kept beside a date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stintbook.functions.text import strip

# The date cells a roster row may hold.
DATE_TYPES = ("join_date", "inactive_date", "leave_date")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shape(text: Column) -> Column:
    """The text with every digit as 0: a cheap test of its form without a regular expression."""
    return F.translate(text, "123456789", "000000000")


def iso_date(text: Column) -> Column:
    """``2024-01-05`` or ``20240105`` to a date; anything else, or an impossible day, is null."""
    packed = F.concat_ws(
        "-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)
    )
    return _let(
        F.when(F.length(text) == 8, packed).otherwise(text),
        lambda dashed: F.when(
            (_shape(dashed) == "0000-00-00") & ~dashed.startswith("0000"),
            dashed.try_cast("date"),
        ),
    )


def date_type(label: Column) -> Column:
    """Cell caption such as ``Join Date:`` to one of :data:`DATE_TYPES`, else null."""
    key = F.replace(
        F.replace(F.lower(strip(label)), F.lit(" "), F.lit("_")), F.lit(":"), F.lit("")
    )
    return F.when(key.isin(*DATE_TYPES), key)


def _head(text: Column) -> Column:
    return F.lower(F.substring(strip(text), 1, 10))


def exact_date(text: Column) -> Column:
    """The first ten characters as a strict date."""
    return _let(_head(text), iso_date)


def repaired_date(kind: Column, text: Column, month_end: bool = False) -> Column:
    """Complete a date whose tail is unknown.

    Joins are completed with 01-01, other dates with 12-31. The parts are appended and the
    first three kept, so a leave date known to the month ends on day 12 of that month; with
    ``month_end`` it ends on the last day of that month.
    """
    # The parts that stand in for unknown ones.
    tail = F.when(kind == "join_date", F.array(F.lit("01"), F.lit("01"))).otherwise(
        F.array(F.lit("12"), F.lit("31"))
    )

    def complete(head: Column) -> Column:
        month_unknown = (F.length(head) > 4) & (_shape(F.substring(head, 6, 1)) != "0")
        known = F.when(month_unknown, F.substring(head, 1, 4)).otherwise(head)
        digits = F.rtrim(F.regexp_replace(known, "[^0-9-]", ""), F.lit("-"))
        parts = F.slice(F.concat(F.split(digits, "-"), tail), 1, 3)
        has_year = _shape(F.substring(head, 1, 4)) == "0000"
        date = _let(F.array_join(parts, "-"), iso_date)
        if month_end:
            to_the_month = (kind != "join_date") & (F.size(F.split(digits, "-")) == 2)
            date = F.when(to_the_month, F.last_day(date)).otherwise(date)
        return F.when(has_year, date)

    return _let(_head(text), complete)


def parsed_date(kind: Column, text: Column, month_end: bool = False) -> Column:
    return F.coalesce(exact_date(text), repaired_date(kind, text, month_end))


def raw_date(kind: Column, text: Column) -> Column:
    """Text to keep beside the date: null for an exact date, ``unknown`` for a missing one."""

    def kept(shown: Column) -> Column:
        missing = (shown == "") & kind.isin("join_date", "leave_date")
        inexact = iso_date(_head(shown)).isNull()
        return F.when(missing, F.lit("unknown")).when(inexact, F.nullif(shown, F.lit("")))

    return _let(F.coalesce(strip(text), F.lit("")), kept)


def read_cells(cells: Column) -> Column:
    """The known ones of ``array<struct<label, text>>`` as ``array<struct<kind, date, raw>>``.

    Kind, date and raw text are those of :func:`date_type`, :func:`parsed_date` and
    :func:`raw_date`, whose shared parts are evaluated once.
    """
    kinds = F.transform(
        cells,
        lambda c: F.struct(
            date_type(c["label"]).alias("kind"), F.coalesce(strip(c["text"]), F.lit("")).alias("text")
        ),
    )

    def read(cell: Column) -> Column:
        kind, shown = cell["kind"], cell["text"]
        head = F.lower(F.substring(shown, 1, 10))
        missing = (shown == "") & kind.isin("join_date", "leave_date")
        return _let(
            F.struct(iso_date(head).alias("exact"), missing.alias("missing")),
            lambda known: F.when(
                known["exact"].isNotNull(),
                F.struct(
                    kind.alias("kind"),
                    known["exact"].alias("date"),
                    F.lit(None).cast("string").alias("raw"),
                ),
            ).otherwise(
                F.struct(
                    kind.alias("kind"),
                    F.when(shown != "", repaired_date(kind, shown)).alias("date"),
                    F.when(known["missing"], F.lit("unknown"))
                    .otherwise(F.nullif(shown, F.lit("")))
                    .alias("raw"),
                )
            ),
        )

    return F.transform(F.filter(kinds, lambda c: c["kind"].isNotNull()), read)


def date_columns(cells: Column) -> dict[str, Column]:
    """Six date columns and ``has_invalid_dates`` from ``array<struct<label, text>>``.

    The cells of a row sit in one small array, so no shuffle is needed to pivot them.
    A later cell of the same type replaces the date, but never clears an earlier raw text.
    """
    return columns_of_read(read_cells(cells))


def columns_of_read(read: Column) -> dict[str, Column]:
    """``date_columns`` from the result of :func:`read_cells`, kept as a column of its own: each of
    these refers to it."""
    columns: dict[str, Column] = {}
    for name in DATE_TYPES:
        mine = F.filter(read, lambda c: c["kind"] == name)
        kept = F.filter(read, lambda c: (c["kind"] == name) & c["raw"].isNotNull())
        columns[name] = F.try_element_at(mine, F.lit(-1))["date"]
        columns[f"{name}_raw"] = F.try_element_at(kept, F.lit(-1))["raw"]
    inexact = F.exists(read, lambda c: c["raw"].isNotNull())
    columns["has_invalid_dates"] = (F.size(read) == 0) | inexact
    return columns
