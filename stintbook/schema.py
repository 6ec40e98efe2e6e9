"""Fixed schemas and sentinel dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# An unknown start and an open end of a membership period.
DATE_MIN = dt.date(1, 1, 1)
DATE_MAX = dt.date(9999, 12, 31)

# Fixed value: the default start of a team page's window.
DEFAULT_FROM = dt.date(2000, 11, 9)

# Fixed value: periods shorter than this many days are not shown.
MIN_SHOWN_DAYS = 3


def day(date: dt.date) -> Column:
    """A date constant. Passed as text, since Spark's Python literal drops leading zeros."""
    return F.lit(date.isoformat()).cast("date")


def _fields(spec: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in spec])


_S, _B, _D = T.StringType(), T.BooleanType(), T.DateType()

# One flat record per player, team and stay, as JSON lines.
ROSTER_FEED = _fields(
    [
        ("team_unique_name", _S),
        ("team_name", _S),
        ("team_url", _S),
        ("player_unique_id", _S),
        ("game_version", _S),
        ("player_id", _S),
        ("full_name", _S),
        ("player_url", _S),
        ("is_captain", _B),
        ("position", _S),
        ("flag_name", _S),
        ("join_date", _D),
        ("inactive_date", _D),
        ("leave_date", _D),
        ("join_date_raw", _S),
        ("inactive_date_raw", _S),
        ("leave_date_raw", _S),
        ("has_invalid_dates", _B),
    ]
)

TEAMS = _fields([("unique_name", _S), ("name", _S), ("wiki_url", _S)])

# The fact table. The feed calls the nickname "player_id"; here every id says what it is.
STINTS = _fields(
    [
        ("player_uid", _S),
        ("team_id", _S),
        ("game_version", _S),
        ("nickname", _S),
        ("full_name", _S),
        ("player_url", _S),
        ("is_captain", _B),
        ("position", _S),
        ("flag_name", _S),
        ("join_date", _D),
        ("inactive_date", _D),
        ("leave_date", _D),
        ("inactive_or_leave_date", _D),
        ("has_invalid_dates", _B),
        ("join_date_raw", _S),
        ("inactive_date_raw", _S),
        ("leave_date_raw", _S),
    ]
)

# The columns that identify one membership record. Derived columns are left out.
RECORD = [
    "player_uid",
    "team_id",
    "game_version",
    "nickname",
    "full_name",
    "player_url",
    "is_captain",
    "position",
    "flag_name",
    "join_date",
    "inactive_date",
    "leave_date",
    "join_date_raw",
    "inactive_date_raw",
    "leave_date_raw",
]
