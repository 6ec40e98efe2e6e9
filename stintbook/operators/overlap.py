"""Interval-overlap joins between members of the same team, by nested ranges of days.

Days are grouped by fours, sixteens and so on; each group is a node. A span is the union of a few
nodes, at most six of each size, and a day lies in one node of each size. Of two overlapping spans
the later one starts on a day of the earlier one, so the spans' nodes are joined with the nodes
around all starts, by equality. A pair meets in exactly one node. So rows that meet are the result,
but for a player's own spans and equal starts, however many spans a team has on how few days; and
a large team is as many keys as it has nodes.

A team with at most ``DIRECT`` spans is one node: there no span meets more than so many others,
and looking at all of them costs less than copying spans to nodes.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintbook.functions.predicates import is_clean, overlap_end


def clean_spans(stints: DataFrame, as_of: dt.date) -> DataFrame:
    """Clean stints as ``(player_uid, team_id, start, end)``.

    Intervals that end before they start overlap nothing and are dropped here.
    """
    return (
        stints.filter(is_clean())
        .select(
            "player_uid",
            "team_id",
            F.col("join_date").alias("start"),
            overlap_end(as_of).alias("end"),
        )
        .filter(F.col("start") <= F.col("end"))
    )


# Sizes of a node: 1, 4, 16, ... days. Longer spans take several of the largest.
SIZES = 8
_FAN_BITS = 2
DIRECT = 200


def _nodes(first: Column, after: Column) -> Column:
    """The fewest nodes that make up the days from ``first`` to the one before ``after``."""
    empty = F.array().cast("array<int>")
    begin, end = F.unix_date(first), F.unix_date(after)

    def whole(size: int) -> tuple[Column, Column]:
        """Nodes of a size that lie inside: the first one, and the one behind the last."""
        bits = _FAN_BITS * size
        return F.shiftright(begin + ((1 << bits) - 1), bits), F.shiftright(end, bits)

    def between(low: Column, high: Column) -> Column:
        return F.when(low < high, F.sequence(low, high - 1)).otherwise(empty)

    parts = []
    for size in range(SIZES):
        low, high = whole(size)
        numbers = between(low, high)
        if size + 1 < SIZES:
            # What larger nodes cover lies between those that are left over on both sides.
            inner, outer = (F.shiftleft(x, _FAN_BITS) for x in whole(size + 1))
            sides = F.concat(between(low, inner), between(outer, high))
            numbers = F.when(inner < outer, sides).otherwise(numbers)
        parts.append(_of_size(size, numbers))
    return F.concat(*parts)


def _of_size(size: int, numbers: Column) -> Column:
    return F.transform(numbers, lambda n: F.struct(F.lit(size).alias("size"), n.alias("node")))


def _around(date: Column) -> Column:
    """The nodes a day lies in, one of each size."""
    number = F.unix_date(date)
    return F.array(
        *[
            F.struct(
                F.lit(k).alias("size"), F.shiftright(number, _FAN_BITS * k).alias("node")
            )
            for k in range(SIZES)
        ]
    )


# Which side covers the other's start; in a small team, either.
_KEYS = ["team_id", "kind", "size", "node"]
_EITHER, _COVERS, _STARTS = -1, 0, 1


def _days_after(end: str, closed: bool) -> Column:
    """The first day that is none of a span's."""
    return F.date_add(end, 1) if closed else F.col(end)


def _large_teams(spans: DataFrame) -> DataFrame:
    counted = spans.groupBy("team_id").agg(F.count(F.lit(1)).alias("spans"))
    return counted.filter(F.col("spans") > DIRECT).select("team_id", F.lit(True).alias("large"))


def _of_kind(kind: int, nodes: Column) -> Column:
    return F.transform(
        nodes, lambda n: F.struct(F.lit(kind).alias("kind"), n.size.alias("size"), n.node.alias("node"))
    )


def _at_nodes(df: DataFrame, large: DataFrame, nodes: Column) -> DataFrame:
    """Rows once for each of their nodes; in a small team once."""
    one = F.array(
        F.struct(F.lit(_EITHER).alias("kind"), F.lit(0).alias("size"), F.lit(0).alias("node"))
    )
    at = F.when(F.col("large"), nodes).otherwise(one)
    spread = df.join(large, "team_id", "left").withColumn("at", F.explode(at))
    return spread.select(*df.columns, "at.kind", "at.size", "at.node")


def _meeting(earlier: DataFrame, later: DataFrame, closed: bool) -> DataFrame:
    """Each row of ``later`` with each of ``earlier`` in whose days it starts.

    ``earlier`` has ``team_id, earlier_start, earlier_end``, ``later`` has ``team_id`` and
    ``later_start``; ``later`` is read twice. With ``closed`` the end is one of the days.
    """
    large = _large_teams(later)
    after = _days_after("earlier_end", closed)
    covers = _of_kind(_COVERS, _nodes(F.col("earlier_start"), after))
    starts = _of_kind(_COVERS, _around(F.col("later_start")))
    inside = (F.col("later_start") >= F.col("earlier_start")) & (F.col("later_start") < after)
    return (
        _at_nodes(earlier, large, covers)
        .join(_at_nodes(later, large, starts), _KEYS)
        .filter(inside)
        .drop("kind", "size", "node")
    )


def _lasting(spans: DataFrame, closed: bool) -> DataFrame:
    """Spans that can overlap anything."""
    return spans.filter(F.col("start") <= F.col("end") if closed else F.col("start") < F.col("end"))


def self_overlaps(spans: DataFrame, closed: bool) -> DataFrame:
    """Every unordered pair of overlapping spans of two players in one team, once.

    Returns ``player1 < player2``, the team and the overlap's ``start`` and ``end``. With
    ``closed`` an overlap of zero days counts.
    """
    lasting = _lasting(spans, closed)

    def side(name: str) -> DataFrame:
        renamed = {"player_uid": f"{name}_uid", "start": f"{name}_start", "end": f"{name}_end"}
        return lasting.select("team_id", *[F.col(c).alias(n) for c, n in renamed.items()])

    # Of two spans that start on one day, the smaller player's counts as the earlier one.
    before = (F.col("earlier_start") < F.col("later_start")) | (
        F.col("earlier_uid") < F.col("later_uid")
    )
    return (
        _meeting(side("earlier"), side("later"), closed)
        .filter((F.col("earlier_uid") != F.col("later_uid")) & before)
        .select(
            F.least("earlier_uid", "later_uid").alias("player1"),
            F.greatest("earlier_uid", "later_uid").alias("player2"),
            "team_id",
            F.col("later_start").alias("start"),
            F.least("earlier_end", "later_end").alias("end"),
        )
    )


def overlaps_with(chosen: DataFrame, mates: DataFrame, closed: bool = False) -> DataFrame:
    """Spans of ``mates`` that overlap a span of ``chosen`` in the same team.

    ``chosen`` has ``player_uid, team_id, start, end``; ``mates`` has those and any further
    columns, which are kept. Adds ``of_player`` and the overlap as ``overlap_start`` and
    ``overlap_end``. Both sides are copied to their nodes, so ``mates`` should be narrow; spans
    that end before they start meet nothing. ``mates`` is read twice.
    """
    renamed = {"player_uid": "of_player", "start": "of_start", "end": "of_end"}
    own = _lasting(chosen, closed).select(
        "team_id", *[F.col(c).alias(n) for c, n in renamed.items()]
    )
    mates = _lasting(mates, closed)
    large = _large_teams(mates)

    def both_ways(start: str, end: str, covers: int, starts: int) -> Column:
        nodes = _nodes(F.col(start), _days_after(end, closed))
        return F.concat(_of_kind(covers, nodes), _of_kind(starts, _around(F.col(start))))

    begins, until = F.greatest("start", "of_start"), F.least("end", "of_end")
    meets = begins <= until if closed else begins < until
    # Equal starts meet both ways; one of them counts.
    once = (F.col("kind") != _STARTS) | (F.col("start") < F.col("of_start"))
    return (
        _at_nodes(own, large, both_ways("of_start", "of_end", _COVERS, _STARTS))
        .join(_at_nodes(mates, large, both_ways("start", "end", _STARTS, _COVERS)), _KEYS)
        .filter((F.col("player_uid") != F.col("of_player")) & meets & once)
        .withColumn("overlap_start", begins)
        .withColumn("overlap_end", until)
        .select("of_player", *mates.columns, "overlap_start", "overlap_end")
    )
