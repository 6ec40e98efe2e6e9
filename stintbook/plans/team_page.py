"""Team page: the line-ups of one team, or of all teams at once, flat or nested."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stintbook.functions.labels import (
    INVALID_PERIOD,
    country_text,
    date_text,
    dated_text,
    or_empty,
    period_text,
    position_text,
)
from stintbook.functions.text import flag_path, team_link
from stintbook.operators.lineups import (
    dated_records,
    gathered_members,
    lineup_members,
    lineup_segments,
    shown_segments,
    team_window,
    undated_records,
)
from stintbook.operators.lookups import team

# Members in one row of the nested form; a larger line-up takes several rows.
MOST_MEMBERS = 1_000


def _member_fields(as_of: dt.date, highlight: str) -> list[Column]:
    position = position_text(F.col("is_captain"), F.col("position"))
    return [
        F.col("player_uid"),
        F.col("nickname"),
        (F.col("nickname") == highlight).alias("highlight"),
        F.col("full_name"),
        F.col("is_captain"),
        position.contains("Coach").alias("is_coach"),
        F.col("player_url"),
        flag_path(F.col("flag_name")).alias("flag_url"),
        country_text(F.col("flag_name")).alias("country"),
        position.alias("position"),
        *[
            date_text(F.col(d), as_of).alias(d)
            for d in ("join_date", "inactive_date", "leave_date")
        ],
        *[
            or_empty(F.col(r)).alias(r)
            for r in ("join_date_raw", "inactive_date_raw", "leave_date_raw")
        ],
    ]


def team_lineups(
    stints: DataFrame,
    as_of: dt.date,
    date_from: dt.date | None = None,
    date_to: dt.date | None = None,
    highlight: str = "",
    team_id: str | None = None,
) -> DataFrame:
    """One row per line-up and member.

    ``lineup_no`` 0 holds the entries with unusable dates; the others follow in time. The
    window is applied to the stints first, so it can move the edges of the line-ups.
    """
    inside, records, segments = _windowed(stints, as_of, date_from, date_to, team_id)
    undated = _undated_rows(inside, as_of, highlight)
    dated = _dated_rows(lineup_members(records, segments), as_of, highlight)
    return undated.unionByName(dated)


def _windowed(
    stints: DataFrame,
    as_of: dt.date,
    date_from: dt.date | None,
    date_to: dt.date | None,
    team_id: str | None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stints in the window, of these the dated records, and their shown segments."""
    if team_id is not None:
        stints = stints.filter(F.col("team_id") == team_id)
    inside = team_window(stints, date_from, date_to, as_of)
    records = dated_records(inside)
    return inside, records, shown_segments(lineup_segments(records), date_from, date_to, as_of)


def _undated_rows(inside: DataFrame, as_of: dt.date, highlight: str, *more: str) -> DataFrame:
    """``more`` names columns of the stints that are kept, as ``entry_0`` and so on."""
    return undated_records(inside, *more).select(
        "team_id",
        F.lit(0).cast("long").alias("lineup_no"),
        F.lit(INVALID_PERIOD).alias("period"),
        F.lit("-").alias("game_version"),
        *_member_fields(as_of, highlight),
        *[F.col(c).alias(f"entry_{i}") for i, c in enumerate(more)],
    )


def _dated_rows(members: DataFrame, as_of: dt.date, highlight: str, *more: str) -> DataFrame:
    return members.select(
        "team_id",
        F.col("segment_no").alias("lineup_no"),
        period_text(F.col("segment_start"), F.col("segment_end"), as_of).alias("period"),
        F.col("segment_version").alias("game_version"),
        *_member_fields(as_of, highlight),
        *more,
    )


def nested_lineups(
    stints: DataFrame,
    as_of: dt.date,
    date_from: dt.date | None = None,
    date_to: dt.date | None = None,
    highlight: str = "",
    team_id: str | None = None,
    entry_order: list[str] | None = None,
    most_members: int = MOST_MEMBERS,
) -> DataFrame:
    """One row per line-up: team_id, lineup_no, part, period, game_version, players (an array).

    Players stand by nickname, then id. Line-up 0, the entries with unusable dates, keeps the
    order of its entries: by the columns ``entry_order`` of the stints, else as the stints are
    read. No array is longer than ``most_members``: a larger line-up goes on in the next ``part``,
    and members are numbered by a window that sorts on disk where it has to.
    """
    if entry_order is None:
        stints = stints.withColumn("entry", F.monotonically_increasing_id())
        entry_order = ["entry"]
    inside, records, segments = _windowed(stints, as_of, date_from, date_to, team_id)
    undated = _undated_rows(inside, as_of, highlight, *entry_order)
    dated = _dated_rows(gathered_members(records, segments), as_of, highlight, "block")
    entry = [f"entry_{i}" for i in range(len(entry_order))]
    return _in_parts(undated, ["team_id"], entry, most_members).unionByName(
        # a line-up lies in one block, and the rows of a block already lie together
        _in_parts(dated, ["team_id", "block", "lineup_no"], [], most_members)
    )


def _in_parts(
    rows: DataFrame, lineup: list[str], entry: list[str], most_members: int
) -> DataFrame:
    """Line-ups, told apart by ``lineup``, as arrays of their players by place."""
    keys = ["team_id", "lineup_no", "period", "game_version"]
    names = [c for c in rows.columns if c not in {*keys, *lineup, *entry}]
    # the rest of the record makes the order of equal nicknames fixed
    first = [*entry, "nickname", "player_uid"]
    place = [F.col(c).asc_nulls_last() for c in [*first, *[n for n in names if n not in first]]]
    number = F.row_number().over(W.partitionBy(*lineup).orderBy(*place))
    numbered = rows.withColumn("number", number).select(
        *dict.fromkeys([*lineup, *keys]),
        (F.floor((F.col("number") - 1) / most_members) + 1).cast("bigint").alias("part"),
        F.struct("number", F.struct(*names).alias("player")).alias("placed"),
    )
    # At most ``most_members`` in each.
    placed = F.array_sort(F.collect_list("placed"))
    return (
        numbered.groupBy(*dict.fromkeys([*lineup, *keys]), "part")
        .agg(placed["player"].alias("players"))
        .select("team_id", "lineup_no", "part", "period", "game_version", "players")
    )


def team_headers(
    teams: DataFrame,
    stints: DataFrame,
    as_of: dt.date,
    date_from: dt.date | None = None,
    date_to: dt.date | None = None,
) -> DataFrame:
    """Name, URL and reset link of the teams that have stints in the window.

    ``reset_url`` leads to the page without a window; it is null where none was given.
    """
    unfiltered = date_from is None and date_to is None
    reset = F.lit(None).cast("string") if unfiltered else team_link(F.col("unique_name"))
    inside = team_window(stints, date_from, date_to, as_of)
    there = inside.select(F.col("team_id").alias("unique_name"))
    return teams.join(there, "unique_name", "left_semi").select(
        F.col("unique_name").alias("team_id"),
        F.col("name").alias("team_name"),
        F.col("wiki_url").alias("team_url"),
        reset.alias("reset_url"),
    )


def team_page(
    teams: DataFrame,
    stints: DataFrame,
    team_id: str,
    as_of: dt.date,
    date_from: dt.date | None = None,
    date_to: dt.date | None = None,
    highlight: str = "",
) -> DataFrame:
    """The page of one team in reading order; no rows if the team is unknown or has no stints in
    the window.

    A team with stints but without a line-up to show has one row, with its name and links only.
    """
    mine = stints.filter(F.col("team_id") == team_id)
    known = team_headers(team(teams, team_id), mine, as_of, date_from, date_to)
    lineups = team_lineups(mine, as_of, date_from, date_to, highlight)
    return known.join(lineups, "team_id", "left").orderBy("lineup_no", "nickname", "player_uid")


def shown_dates(stints: DataFrame, as_of: dt.date) -> DataFrame:
    """Each stint's dates as a page shows them, with the text they were read from (else null)."""
    return stints.select(
        "player_uid",
        "team_id",
        *[
            dated_text(date_text(F.col(d), as_of), F.col(f"{d}_raw")).alias(d)
            for d in ("join_date", "inactive_date", "leave_date")
        ],
    )
