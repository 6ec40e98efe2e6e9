"""Ready-to-show texts for days, dates, positions and game versions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from stintbook.functions.text import strip
from stintbook.schema import DATE_MAX, DATE_MIN, day

# A line-up shows the first of these that any member carries.
VERSION_PRIORITY = ("-", "CS1.6", "CS:S", "CS:GO", "CS2")

# Fixed value: the caption of the line-up that gathers unreadable dates.
INVALID_PERIOD = "Entries with invalid dates"


def days_text(days: Column) -> Column:
    """``31 days``, ``2 months``, ``1 years``, ``1 years, 1 months``; a month has 31 days."""
    count = days.cast("long")
    months = F.floor(count / 31)
    years = F.floor(months / 12).cast("string")
    rest = months % 12
    return (
        F.when(count <= 31, F.concat(count.cast("string"), F.lit(" days")))
        .when(months <= 11, F.concat(months.cast("string"), F.lit(" months")))
        .when(rest == 0, F.concat(years, F.lit(" years")))
        .otherwise(F.concat(years, F.lit(" years, "), rest.cast("string"), F.lit(" months")))
    )


def days_exact_text(days: Column) -> Column:
    return F.concat(days.cast("string"), F.lit(" days"))


def days_tooltip(days: Column) -> Column:
    """Exact day count where :func:`days_text` rounds, else null."""
    return F.when(days > 31, days_exact_text(days))


def version_text(version: Column) -> Column:
    """Old versions only: newer ones are recorded too loosely to be shown."""
    value = strip(version)
    lower = F.lower(value)
    return (
        F.when(F.coalesce(version, F.lit("")) == "", F.lit("-"))
        .when(lower.contains("source"), F.lit("CS:S"))
        .when(lower == "cs", F.lit("CS1.6"))
        .when(lower.contains("2") | lower.contains("go"), F.lit("-"))
        .otherwise(value)
    )


def date_text(date: Column, as_of: dt.date) -> Column:
    """``5 Jan 2024``; ``-`` for none, ``Unknown`` and ``Present`` for the open ends."""
    return (
        F.when(date.isNull(), F.lit("-"))
        .when(date == day(DATE_MIN), F.lit("Unknown"))
        .when((date == day(DATE_MAX)) | (date == day(as_of)), F.lit("Present"))
        .otherwise(F.date_format(date, "d MMM yyyy"))
    )


def period_text(start: Column, end: Column, as_of: dt.date) -> Column:
    return F.concat(date_text(start, as_of), F.lit(" - "), date_text(end, as_of))


def position_text(is_captain: Column, position: Column) -> Column:
    is_coach = F.lower(F.coalesce(position, F.lit(""))).contains("coach")
    joined = F.concat_ws(
        ", ", F.when(is_captain, F.lit("Captain")), F.when(is_coach, F.lit("Coach"))
    )
    return F.when(joined == "", F.lit("Player")).otherwise(joined)


def country_text(flag_name: Column) -> Column:
    return F.coalesce(F.nullif(flag_name, F.lit("")), F.lit("-"))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def dated_text(label: Column, raw: Column) -> Column:
    """A shown date together with the text it was read from, if any."""
    return F.struct(label.alias("display"), F.nullif(raw, F.lit("")).alias("original"))


def version_iso(version: Column) -> Column:
    return F.date_format(version, "yyyy-MM-dd")
