"""Which stints count (two validity rules) and where a stint ends (three end rules).

The rules look alike but differ on purpose, so each has its own name.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from stintbook.schema import DATE_MAX, DATE_MIN, day


def is_clean() -> Column:
    """The join date is known and no date was repaired or left as text."""
    exact = F.col("join_date").isNotNull()
    for raw in ("join_date_raw", "leave_date_raw", "inactive_date_raw"):
        exact = exact & (F.coalesce(F.col(raw), F.lit("")) == "")
    return exact


def has_join() -> Column:
    return F.col("join_date").isNotNull()


def not_left() -> Column:
    """Clean and without a leave date. An inactive player still counts."""
    return is_clean() & F.col("leave_date").isNull()


def is_ongoing() -> Column:
    return is_clean() & F.col("inactive_date").isNull() & F.col("leave_date").isNull()


def has_valid_dates() -> Column:
    """Weaker than :func:`is_clean`: a repaired date is valid, a date out of order is not."""
    ok = F.col("join_date").isNotNull()
    for end, raw in (("inactive_date", "inactive_date_raw"), ("leave_date", "leave_date_raw")):
        unreadable = F.col(end).isNull() & (F.coalesce(F.col(raw), F.lit("")) != "")
        reversed_ = F.coalesce(F.col("join_date") > F.col(end), F.lit(False))
        ok = ok & ~unreadable & ~reversed_
    return ok


def stored_end() -> Column:
    """End as stored in the table; null while the stint is open."""
    return F.coalesce(F.col("inactive_date"), F.col("leave_date"))


def period_start() -> Column:
    return F.coalesce(F.col("join_date"), day(DATE_MIN))


def period_end() -> Column:
    """End of the period shown in line-ups; open stints run to 9999-12-31."""
    return F.coalesce(F.col("inactive_date"), F.col("leave_date"), day(DATE_MAX))


def overlap_end(as_of: dt.date) -> Column:
    """End used for overlaps: the earlier of both dates, a missing one standing for ``as_of``."""
    return F.least(
        F.coalesce(F.col("inactive_date"), day(as_of)),
        F.coalesce(F.col("leave_date"), day(as_of)),
    )


def in_window(date_from: dt.date, date_to: dt.date) -> Column:
    """The stint touches the closed window; a missing date never excludes it."""
    joined = F.col("join_date").isNull() | (F.col("join_date") <= day(date_to))
    ended = F.col("inactive_or_leave_date")
    return joined & (ended.isNull() | (ended >= day(date_from)))
