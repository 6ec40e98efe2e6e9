"""Main page: six ranked tables in one long table."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stintbook.functions.labels import days_text, days_tooltip
from stintbook.operators import rankings
from stintbook.operators.overlap import clean_spans
from stintbook.sources.shared import keep

# Titles in page order.
TITLES = (
    "TOP5 Players with most time in current team (without breaks)",
    "TOP5 Players with most teams",
    "TOP10 Players with most teammates",
    "TOP10 Teammates with most time together",
    "TOP10 Teams with most players in history",
    "TOP10 Countries by active players",
)


def _section(number: int, table: DataFrame, keys: list[str], measure: str, days: bool) -> DataFrame:
    value = F.col(measure)
    none = F.lit(None).cast("string")
    names: list[Column] = [F.col(k) for k in keys] + [none] * (2 - len(keys))
    # at most ten rows reach this window
    order = W.orderBy(F.desc(measure), *[F.asc_nulls_last(k) for k in keys])
    return table.select(
        F.lit(number).cast("long").alias("report_no"),
        F.lit(TITLES[number - 1]).alias("title"),
        F.row_number().over(order).cast("long").alias("rank"),
        names[0].alias("key1"),
        names[1].alias("key2"),
        value.alias("value"),
        (days_text(value) if days else value.cast("string")).alias("display"),
        (days_tooltip(value) if days else none).alias("tooltip"),
    )


# What the six tables read of a stint.
_READ = ["player_uid", "team_id", "flag_name", "join_date", "inactive_date", "leave_date"]
_READ += ["join_date_raw", "leave_date_raw", "inactive_date_raw"]


def main_report(stints: DataFrame, as_of: dt.date, merge: str = "lag") -> DataFrame:
    """``stints`` are read once, however they come about; all tables are made from what is kept."""
    stints = keep(stints.select(*_READ), "stints")
    spans = keep(clean_spans(stints, as_of).distinct(), "spans")
    sections = [
        (rankings.longest_current_tenure(stints, as_of, merge, 5), ["player_uid", "team_id"],
         "total_days", True),
        (rankings.most_teams(stints, 5), ["player_uid"], "total_teams", False),
        (rankings.most_teammates_of_spans(spans, 10), ["player_uid"], "teammate_count", False),
        (rankings.pairs_with_most_time_of_spans(spans, merge, 10), ["player1", "player2"],
         "total_days", True),
        (rankings.teams_with_most_players(stints, 10), ["team_id"], "total_players", False),
        (rankings.active_by_country(stints, 10), ["flag_name"], "total_players", False),
    ]
    tables = [
        _section(number, table, keys, measure, days)
        for number, (table, keys, measure, days) in enumerate(sections, start=1)
    ]
    return reduce(DataFrame.unionByName, tables)
