"""Teammates of chosen players and the periods spent together."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stintbook.functions.predicates import is_clean, overlap_end
from stintbook.operators.merging import MERGES
from stintbook.operators.overlap import overlaps_with
from stintbook.schema import MIN_SHOWN_DAYS, RECORD
from stintbook.sources.shared import keep

# A mate's own period shows in the order of these; they make the order of equal overlaps fixed.
_TIES = [
    "team_id",
    "join_date",
    "inactive_date",
    "leave_date",
    "game_version",
    "nickname",
    "full_name",
    "player_url",
    "is_captain",
    "position",
    "flag_name",
]


def teammate_periods(
    stints: DataFrame, players: DataFrame, as_of: dt.date, merge: str = "lag"
) -> DataFrame:
    """Periods the given players spent with each mate, with the mate's record.

    ``players`` has a column ``player_uid``. Periods with one mate are put in order of
    (start, end) across teams. Under ``lag`` each is compared with the one before: an overlapping
    period starts where that one ended, and ends no earlier. Under ``exact`` it is compared with
    the last end of all before, so the days of the periods add up to the length of their union.
    Returns the record columns of the mate plus ``of_player``, ``overlap_start`` and
    ``overlap_end``.
    """
    if merge not in MERGES:
        raise ValueError(f"merge must be one of {MERGES}, not {merge!r}")
    dated = (
        stints.filter(is_clean())
        .select(*RECORD)
        .withColumn("start", F.col("join_date"))
        .withColumn("end", overlap_end(as_of))
    )
    # overlaps are found on keys and dates alone; the record is looked up for what was found
    span = ["player_uid", "team_id", "start", "end"]
    wanted = players.select("player_uid").distinct()
    chosen = keep(dated.select(*span).join(wanted, "player_uid", "left_semi"), "chosen-spans")
    touched = dated.join(chosen.select("team_id").distinct(), "team_id", "left_semi")
    met = overlaps_with(chosen, touched.select(*span).distinct())
    met = met.join(touched, span).drop("start", "end")

    # equal rows shrink to one with a count before they are put in order
    pair = ["of_player", "player_uid"]
    counted = (
        met.groupBy("of_player", *RECORD, "overlap_start", "overlap_end")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("month", F.trunc("overlap_start", "month"))
    )
    # Order is kept within months; only each month's end is passed on to the pair's next
    # months. So even a mate with very many stints is not sorted as a whole in one task.
    in_order = W.partitionBy(*pair, "month").orderBy(*_in_time())
    by_month = W.partitionBy(*pair).orderBy("month")
    if merge == "lag":
        month_end = F.max(F.struct("overlap_start", "overlap_end"))["overlap_end"]
        carried = F.lag("month_end").over(by_month)
        before = F.coalesce(F.lag("overlap_end").over(in_order), F.col("carried"))
    else:
        month_end = F.max("overlap_end")
        carried = F.max("month_end").over(by_month.rowsBetween(W.unboundedPreceding, -1))
        reached = F.max("overlap_end").over(in_order.rowsBetween(W.unboundedPreceding, -1))
        before = F.greatest(reached, "carried")
    months = counted.groupBy(*pair, "month").agg(month_end.alias("month_end"))
    earlier = months.select(*pair, "month", carried.alias("carried"))
    apart = F.col("before").isNull() | (F.col("overlap_start") > F.col("before"))
    until = F.greatest("overlap_end", "before")
    merged = F.struct(
        F.when(apart, F.col("overlap_start")).otherwise(F.col("before")).alias("start"),
        until.alias("end"),
    )
    # a second copy begins where the first one ended, so it is merged to an empty period there
    last = F.col("overlap_end") if merge == "lag" else until
    again = F.struct(last.alias("start"), last.alias("end"))
    periods = F.when(F.col("copies") > 1, F.array(merged, again)).otherwise(F.array(merged))
    return (
        counted.join(earlier, [*pair, "month"])
        .withColumn("before", before)
        .withColumn("period", F.explode(periods))
        .select(
            "of_player",
            *RECORD,
            F.col("period.start").alias("overlap_start"),
            F.col("period.end").alias("overlap_end"),
        )
        .distinct()
    )


def _in_time() -> list[Column]:
    return [
        F.col("overlap_start"),
        F.col("overlap_end"),
        *[F.asc_nulls_last(c) for c in _TIES],
    ]


def teammate_summary(periods: DataFrame) -> DataFrame:
    """Shown periods, one row each, with the mate's totals.

    Periods that are too short are left out. ``mate_nickname`` is the one of the last period.
    """
    pair = ["of_player", "player_uid"]
    shown = keep(
        periods.withColumn("days", F.datediff("overlap_end", "overlap_start")).filter(
            F.col("days") >= MIN_SHOWN_DAYS
        ),
        "teammate-periods",
    )
    # a struct puts nulls first; a flag before each tie puts them last, as the order above does
    ties = [c for t in _TIES for c in (F.col(t).isNull().alias(f"no_{t}"), F.col(t))]
    place = F.struct("overlap_start", "overlap_end", *ties)
    totals = shown.groupBy(*pair).agg(
        F.max_by("nickname", place).alias("mate_nickname"),
        F.sum("days").alias("total_days"),
        F.min("overlap_start").alias("first_start"),
    )
    return shown.join(totals, pair).select(
        *pair,
        "mate_nickname",
        "total_days",
        "first_start",
        "team_id",
        "overlap_start",
        "overlap_end",
        "days",
    )
