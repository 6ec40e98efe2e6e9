"""Team line-ups: who was together in a team, from when to when.

A line-up lasts from one day on which the team changed to the next. Line-ups are found from
counts per team and day, so the window over a team is bounded by the calendar, not by the
number of its members. Members are listed one row each; they are never gathered in an array.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stintbook.functions.labels import VERSION_PRIORITY, version_text
from stintbook.functions.predicates import (
    has_valid_dates,
    in_window,
    period_end,
    period_start,
)
from stintbook.schema import DEFAULT_FROM, MIN_SHOWN_DAYS, RECORD, day


def team_window(
    stints: DataFrame, date_from: dt.date | None, date_to: dt.date | None, as_of: dt.date
) -> DataFrame:
    """Stints that touch the window, by default from the first team on to tomorrow."""
    since = date_from or DEFAULT_FROM
    until = date_to or as_of + dt.timedelta(days=1)
    return stints.filter(in_window(since, until))


def dated_records(stints: DataFrame) -> DataFrame:
    """Different records with usable dates and a period of at least one day."""
    return (
        stints.filter(has_valid_dates())
        .select(*RECORD)
        .distinct()
        .withColumn("start", period_start())
        .withColumn("end", period_end())
        .filter(F.col("start") < F.col("end"))
    )


def undated_records(stints: DataFrame, *more: str) -> DataFrame:
    """Records whose dates cannot be placed in time; each team shows them apart.

    ``more`` names columns that are kept besides.
    """
    return stints.filter(~has_valid_dates()).select(*RECORD, *[m for m in more if m not in RECORD])


def lineup_segments(records: DataFrame) -> DataFrame:
    """Consecutive periods of each team with unchanged members.

    Returns ``team_id, segment_no, start, end, members, game_version``. A gap in which the team
    had no members is a segment with ``members = 0``. Every day a record starts or ends on is a
    real change, because records differ, so no neighbours have to be merged afterwards.
    """
    label = version_text(F.col("game_version"))
    # the first label of the fixed order that any member carries names the line-up
    ranked = {name: f"with_{i}" for i, name in enumerate(VERSION_PRIORITY)}
    one = F.lit(1).cast("long")
    edges = records.select(
        "team_id",
        label.alias("label"),
        F.explode(
            F.array(
                F.struct(F.col("start").alias("day"), one.alias("step")),
                F.struct(F.col("end").alias("day"), (-one).alias("step")),
            )
        ).alias("edge"),
    ).select("team_id", "label", "edge.day", "edge.step")
    days = edges.groupBy("team_id", "day").agg(
        F.sum("step").alias("members"),
        *[
            F.sum(F.when(F.col("label") == name, F.col("step")).otherwise(0)).alias(column)
            for name, column in ranked.items()
        ],
    )
    ordered = W.partitionBy("team_id").orderBy("day")
    counts = ["members", *ranked.values()]
    running = days.select(
        "team_id",
        F.row_number().over(ordered).cast("long").alias("segment_no"),
        F.col("day").alias("start"),
        F.lead("day").over(ordered).alias("end"),
        *[F.sum(c).over(ordered).alias(c) for c in counts],
    )
    version = F.lit("-")
    for name, column in reversed(ranked.items()):
        version = F.when(F.col(column) > 0, F.lit(name)).otherwise(version)
    return running.filter(F.col("end").isNotNull()).select(
        "team_id", "segment_no", "start", "end", "members", version.alias("game_version")
    )


def shown_segments(
    segments: DataFrame, date_from: dt.date | None, date_to: dt.date | None, as_of: dt.date
) -> DataFrame:
    """Segments with members, inside the open window, that last long enough."""
    since = day(date_from or DEFAULT_FROM)
    until = day(date_to or as_of + dt.timedelta(days=1))
    return segments.filter(
        (F.col("members") > 0)
        & (F.col("end") > since)
        & (F.col("start") < until)
        & (F.datediff("end", "start") >= MIN_SHOWN_DAYS)
    )


def lineup_members(records: DataFrame, segments: DataFrame) -> DataFrame:
    """One row per record and segment it was part of; ``segments`` are some of the records' own.

    A team's segments come to each record as one array, bounded by the calendar, so the many rows of
    the result are made beside the record and not moved.
    """
    fields = [c for c in records.columns if c not in {"start", "end"}]
    return (
        _with_segments(records, segments, ["team_id"])
        .select(*fields, F.explode("segments").alias("segment"))
        .select(
            *fields,
            F.col("segment.no").alias("segment_no"),
            F.col("segment.from").alias("segment_start"),
            F.col("segment.to").alias("segment_end"),
            F.col("segment.version").alias("segment_version"),
        )
    )


# Segments whose members are made in one task at least; a team with more is spread over several.
SEGMENTS_PER_BLOCK = 64


def gathered_members(records: DataFrame, segments: DataFrame) -> DataFrame:
    """``lineup_members`` with a ``block``, all rows of a team's block in one partition.

    For results that need the members of a line-up together. A record is moved once for each block
    of segments it was part of, and not for each segment, of which it takes the columns afterwards.
    """
    fields = [c for c in records.columns if c not in {"start", "end"}]
    block = F.floor(F.col("segment_no") / SEGMENTS_PER_BLOCK)
    blocks = F.array_distinct(
        F.transform("segments", lambda s: F.floor(s["no"] / SEGMENTS_PER_BLOCK))
    )
    return (
        _with_segments(records, segments, ["team_id"])
        .select(*records.columns, F.explode(blocks).alias("block"))
        .transform(_with_segments, segments.withColumn("block", block), ["team_id", "block"])
        .select(*fields, "block", F.explode("segments").alias("segment"))
        .select(
            *fields,
            "block",
            F.col("segment.no").alias("segment_no"),
            F.col("segment.from").alias("segment_start"),
            F.col("segment.to").alias("segment_end"),
            F.col("segment.version").alias("segment_version"),
        )
    )


def _with_segments(records: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Records with the array ``segments`` of those they were part of.

    A record begins and ends on days on which its team changed, so a segment that starts inside it
    also ends there.
    """
    found = F.array_sort(
        F.collect_list(
            F.struct(
                F.col("start").alias("from"),
                F.col("end").alias("to"),
                F.col("segment_no").alias("no"),
                F.col("game_version").alias("version"),
            )
        )
    )
    of_key = segments.groupBy(*keys).agg(found.alias("all"))
    # a column of its own, because each step of the search would read it from the structs again
    of_key = of_key.select(*keys, "all", F.col("all.from").alias("starts"))
    if "block" in keys:
        of_key = of_key.hint("shuffle_merge")  # a broadcast would leave the rows where they are
    placed = records.join(of_key, keys).select(
        *records.columns,
        "all",
        _count_below("starts", F.col("start")).alias("before"),
        _count_below("starts", F.col("end")).alias("until"),
    )
    part_of = F.slice("all", F.col("before") + 1, F.col("until") - F.col("before"))
    return placed.select(*records.columns, part_of.alias("segments"))


# Fixed value: halvings that are enough for as many days as the calendar has.
_HALVINGS = [2**i for i in reversed(range(22))]


def _count_below(ordered: str, value: Column) -> Column:
    """How many values of a sorted array are smaller, by bisection."""

    def step(found: Column, width: Column) -> Column:
        smaller = F.get(F.col(ordered), found + width - 1) < value
        return F.when(smaller, found + width).otherwise(found)

    return F.aggregate(F.array(*[F.lit(w) for w in _HALVINGS]), F.lit(0), step)
