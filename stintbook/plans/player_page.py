"""Player page: header, teams and teammates, for one player or for many."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stintbook.functions.labels import (
    country_text,
    date_text,
    days_exact_text,
    days_text,
    or_empty,
    period_text,
    position_text,
)
from stintbook.functions.predicates import period_start, stored_end
from stintbook.functions.text import flag_path, team_link
from stintbook.operators.lookups import latest_stint
from stintbook.operators.teammates import teammate_periods, teammate_summary


def player_headers(stints: DataFrame) -> DataFrame:
    """Nickname, country and profile link from each player's latest stint."""
    return latest_stint(stints).select(
        "player_uid",
        "nickname",
        country_text(F.col("flag_name")).alias("country"),
        flag_path(F.col("flag_name")).alias("flag_url"),
        "player_url",
    )


def player_teams(stints: DataFrame, as_of: dt.date) -> DataFrame:
    """Each player's different team entries; order by ``period_start`` to read them."""
    return stints.select(
        "player_uid",
        period_start().alias("period_start"),
        "team_id",
        team_link(
            F.col("team_id"), F.col("join_date"), stored_end(), F.col("nickname")
        ).alias("url_with_filters"),
        position_text(F.col("is_captain"), F.col("position")).alias("position"),
        *[
            date_text(F.col(d), as_of).alias(d)
            for d in ("join_date", "inactive_date", "leave_date")
        ],
        *[
            or_empty(F.col(r)).alias(r)
            for r in ("join_date_raw", "inactive_date_raw", "leave_date_raw")
        ],
    ).distinct()


def player_teammates(
    stints: DataFrame, players: DataFrame, as_of: dt.date, merge: str = "lag"
) -> DataFrame:
    """Teammates with their periods, one row per period, with texts to show."""
    summary = teammate_summary(teammate_periods(stints, players, as_of, merge))
    return summary.select(
        "of_player",
        "player_uid",
        "mate_nickname",
        "total_days",
        days_text(F.col("total_days")).alias("total_text"),
        days_exact_text(F.col("total_days")).alias("total_tooltip"),
        "first_start",
        "overlap_start",
        "team_id",
        F.concat(
            period_text(F.col("overlap_start"), F.col("overlap_end"), as_of),
            F.lit(" ("),
            days_exact_text(F.col("days")),
            F.lit(")"),
        ).alias("period"),
    )


def reading_order_of_teams() -> list[Column]:
    """Entries of one player, earliest first; the rest only makes equal starts repeatable."""
    rest = ["team_id", "url_with_filters", "position", "join_date", "inactive_date", "leave_date",
            "join_date_raw", "inactive_date_raw", "leave_date_raw"]
    return [F.asc("period_start"), *[F.asc_nulls_last(c) for c in rest]]


def reading_order_of_mates() -> list[Column]:
    """Mates of one player, the longest time first, and each mate's periods in time."""
    return [
        F.desc("total_days"),
        *[F.asc(c) for c in ("first_start", "player_uid", "overlap_start", "team_id", "period")],
    ]


def numbered(rows: DataFrame, page: str, order: list[Column]) -> DataFrame:
    """Rows of many players' pages with their ``place`` on the page of ``page``."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(page).orderBy(*order)))


def player_page(
    stints: DataFrame, player_uid: str, as_of: dt.date
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Header, teams and teammates of one player, each in reading order."""
    mine = stints.filter(F.col("player_uid") == player_uid)
    mates = player_teammates(stints, mine.select("player_uid"), as_of)
    return (
        player_headers(mine),
        player_teams(mine, as_of).orderBy(*reading_order_of_teams()),
        mates.orderBy(*reading_order_of_mates()),
    )
