"""The six ranked statistics. Ties are broken by id, so results are repeatable."""

from __future__ import annotations

import datetime as dt
import functools
import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stintbook.functions.predicates import has_join, is_ongoing, not_left
from stintbook.operators.merging import covered_days, disjoint_periods
from stintbook.operators.overlap import clean_spans, overlaps_with, self_overlaps
from stintbook.schema import day
from stintbook.sources.shared import keep

# How many times ``limit`` rows are tried to find a lower bound for a place in the top list.
PROBE = 10
# A round of counting has so many times the players of the one before, up to a size whose ids are
# still few for the driver.
ROUND_GROWTH, LARGEST_ROUND = 40, 20_000


def _top(ranked: DataFrame, measure: str, ids: list[str], limit: int) -> DataFrame:
    ties = [F.asc_nulls_last(i) for i in ids]
    return ranked.orderBy(F.desc(measure), *ties).limit(limit)


def _kth_best(ranked: DataFrame, measure: str, limit: int) -> int:
    """The value a row needs to be among the best ``limit``; 0 if there are fewer rows."""
    best = ranked.select(measure).orderBy(F.desc(measure)).limit(limit)
    enough = F.count(F.lit(1)) >= limit
    return best.agg(F.when(enough, F.min(measure)).otherwise(0).alias("needed")).first()[0]


def most_teams(stints: DataFrame, limit: int = 5) -> DataFrame:
    counts = (
        stints.filter(has_join())
        .groupBy("player_uid")
        .agg(F.countDistinct("team_id").alias("total_teams"))
    )
    return _top(counts, "total_teams", ["player_uid"], limit)


def teams_with_most_players(stints: DataFrame, limit: int = 10) -> DataFrame:
    counts = (
        stints.filter(has_join())
        .groupBy("team_id")
        .agg(F.countDistinct("player_uid").alias("total_players"))
    )
    return _top(counts, "total_players", ["team_id"], limit)


def active_by_country(stints: DataFrame, limit: int = 10) -> DataFrame:
    """Players who have not left, by country; an unknown country is a group of its own."""
    counts = (
        stints.filter(not_left())
        .groupBy("flag_name")
        .agg(F.countDistinct("player_uid").alias("total_players"))
    )
    return _top(counts, "total_players", ["flag_name"], limit)


def current_tenure(stints: DataFrame, as_of: dt.date, merge: str = "lag") -> DataFrame:
    """Days of each player in each current team, up to ``as_of``.

    Open stints all end on ``as_of``, so merging them needs no window: the earliest one covers
    the rest. Under ``lag`` a join after ``as_of`` takes days away; under ``exact`` it adds none.
    """
    joined = F.col("join_date")
    days = F.datediff(day(as_of), joined)
    first = F.greatest(F.datediff(day(as_of), F.min(joined)), F.lit(0))
    if merge == "lag":
        total = first + F.sum(F.when(days < 0, days).otherwise(0))
    elif merge == "exact":
        total = first
    else:
        raise ValueError(f"unknown merge {merge!r}")
    return (
        stints.filter(is_ongoing())
        .groupBy("player_uid", "team_id")
        .agg(total.cast("long").alias("total_days"))
    )


def longest_current_tenure(
    stints: DataFrame, as_of: dt.date, merge: str = "lag", limit: int = 5
) -> DataFrame:
    ranked = current_tenure(stints, as_of, merge)
    return _top(ranked, "total_days", ["player_uid", "team_id"], limit)


def team_spans(spans: DataFrame) -> DataFrame:
    """Clean spans merged to disjoint periods per player and team, empty ones dropped.

    Merging changes no overlap of positive length, and leaves each player at most one row per
    team and day.
    """
    lasting = spans.filter(F.col("start") < F.col("end"))
    return disjoint_periods(lasting, ["player_uid", "team_id"])


def teammate_bounds(periods: DataFrame) -> DataFrame:
    """Upper bound of each player's number of teammates, without forming pairs.

    In one team, the periods that overlap ``[s, e)`` are those that start before ``e`` less
    those that end by ``s``. A mate with several of them is counted again for each absence that
    lies inside ``[s, e)``, so these are taken off: at least as many as absences ending before
    ``e`` exceed absences beginning by ``s``. All of this comes from running counts over the
    team's days. It is done for each of the player's periods, and for the time from the first to
    the last of them; the smaller result counts for the team, and the teams are added up.
    """
    first, last = F.col("period_no") == 1, F.col("period_no") == F.col("periods")
    edges = periods.select(
        "player_uid",
        "team_id",
        (F.col("periods") > 1).alias("several"),
        F.explode(
            F.array(
                F.struct(
                    F.col("start").alias("day"), F.lit(True).alias("opens"), (~first).alias("gap")
                ),
                F.struct(
                    F.col("end").alias("day"), F.lit(False).alias("opens"), (~last).alias("gap")
                ),
            )
        ).alias("edge"),
    ).select("player_uid", "team_id", "several", "edge.*")
    opens, gap = F.col("opens"), F.col("gap")
    # one row per team and day, so the window below is bounded by the calendar
    days = edges.groupBy("team_id", "day").agg(
        F.count_if(opens).alias("opened"),
        F.count_if(~opens).alias("closed"),
        F.count_if(opens & gap).alias("returned"),
        F.count_if(~opens & gap).alias("paused"),
    )
    until = W.partitionBy("team_id").orderBy("day")
    running = days.select(
        "team_id",
        "day",
        (F.sum("opened").over(until) - F.col("opened")).alias("opened_before"),
        F.sum("closed").over(until).alias("closed_until"),
        (F.sum("returned").over(until) - F.col("returned")).alias("returned_before"),
        F.sum("paused").over(until).alias("paused_until"),
    )
    # each period's own count is one sum over its two ends, so few numbers are moved per edge
    met = F.sum(F.when(opens, -F.col("closed_until") - 1).otherwise(F.col("opened_before")))
    again = F.sum(F.when(opens, -F.col("paused_until")).otherwise(F.col("returned_before")))
    # with one period, the time from the first to the last is that period: null, which least skips
    starts, ends = opens & F.col("several"), ~opens & F.col("several")
    # running counts only grow, so the largest belongs to the last end, the least to the first start
    met_overall = (
        F.max(F.when(ends, F.col("opened_before"))) - F.min(F.when(starts, F.col("closed_until"))) - 1
    )
    again_overall = F.max(F.when(ends, F.col("returned_before"))) - F.min(
        F.when(starts, F.col("paused_until"))
    )
    zero = F.lit(0)
    # many periods of a team may end on one day; its one row of ``running`` meets them in as many
    # tasks as adaptive execution splits that day into
    return (
        edges.join(running, ["team_id", "day"])
        .groupBy("player_uid", "team_id")
        .agg(
            F.least(
                met - F.greatest(again, zero), met_overall - F.greatest(again_overall, zero)
            ).alias("in_team")
        )
        .groupBy("player_uid")
        .agg(F.sum("in_team").alias("bound"))
    )


def teammate_counts(players: DataFrame, periods: DataFrame) -> DataFrame:
    """Exact number of different teammates of the given players."""
    periods = periods.select("player_uid", "team_id", "start", "end")
    chosen = periods.join(players.select("player_uid"), "player_uid", "left_semi")
    # mates are in the same teams; kept, so the planner knows their size before it moves any rows
    teams = keep(chosen.select("team_id").distinct(), "teams-of-chosen")
    mates = periods.join(teams, "team_id", "left_semi")
    met = overlaps_with(chosen, mates).select("of_player", "player_uid")
    return met.groupBy(F.col("of_player").alias("player")).agg(
        F.countDistinct("player_uid").alias("teammate_count")
    ).withColumnRenamed("player", "player_uid")


def most_teammates(stints: DataFrame, as_of: dt.date, limit: int = 10) -> DataFrame:
    """Players with the most different teammates.

    Players are counted in rounds, those with the best bounds first and among equal bounds by id,
    until the ``limit``-th best of the counts beats the next bound, or equals it with a smaller
    id. Nobody behind that can be in the result, so it is exact; where bounds are close to the
    counts, or very many players tie, few are counted.
    """
    return most_teammates_of_spans(clean_spans(stints, as_of), limit)


def most_teammates_of_spans(spans: DataFrame, limit: int) -> DataFrame:
    spark = spans.sparkSession
    periods = keep(team_spans(spans), "team-spans")
    bounds = keep(teammate_bounds(periods), "teammate-bounds")
    left, size, rounds = bounds, PROBE * limit, []
    while True:
        # the players of this round, and the next one; bounded by LARGEST_ROUND
        ahead = _top(left, "bound", ["player_uid"], size + 1).collect()
        chosen = spark.createDataFrame([(r.player_uid,) for r in ahead[:size]], "player_uid string")
        rounds.append(keep(teammate_counts(chosen, periods), "teammate-counts"))
        counts = functools.reduce(DataFrame.unionByName, rounds)
        best = _top(counts, "teammate_count", ["player_uid"], limit)
        if len(ahead) <= size:
            return best
        following = ahead[size]
        found = best.collect()
        if len(found) == limit and _beats(found[-1], following):
            return best
        if size == LARGEST_ROUND:
            break
        left = bounds.filter(_from(following))
        if len(found) == limit:
            left = left.filter(F.col("bound") >= found[-1].teammate_count)
        size = min(ROUND_GROWTH * size, LARGEST_ROUND)
    # Bounds tell little here: all who can still win are counted together.
    needed = found[-1].teammate_count if len(found) == limit else 0
    rest = bounds.filter(_from(following) & (F.col("bound") >= needed))
    counts = counts.unionByName(teammate_counts(rest, periods))
    return _top(counts, "teammate_count", ["player_uid"], limit)


def _beats(last: Row, following: Row) -> bool:
    """Whether the last one of a full list stays before a player with this bound, and so before
    all who come later in the order of bounds."""
    if last.teammate_count != following.bound:
        return last.teammate_count > following.bound
    # without an id comes last
    return following.player_uid is None or (
        last.player_uid is not None and last.player_uid < following.player_uid
    )


def _from(first: Row) -> Column:
    """Players from this one on, in falling order of bounds and then by id."""
    uid = F.col("player_uid")
    same = uid.isNull() if first.player_uid is None else uid.isNull() | (uid >= first.player_uid)
    return (F.col("bound") < first.bound) | ((F.col("bound") == first.bound) & same)


def _days_of_pairs(pairs: DataFrame, spans: DataFrame, merge: str) -> DataFrame:
    """Days together of the given pairs, over all their teams.

    ``pairs`` is read three times, so it should be a kept or a small table.
    """
    ids = pairs.select(F.explode(F.array("player1", "player2")).alias("player_uid")).distinct()
    spans = spans.join(ids, "player_uid", "left_semi")
    # the spans of the player with fewer are looked up among those of the other, so a pair costs
    # no more than the smaller number, even if the other player has a large share of all spans
    sizes = spans.groupBy("player_uid").agg(F.count(F.lit(1)).alias("size"))
    size1 = sizes.select(F.col("player_uid").alias("player1"), F.col("size").alias("size1"))
    size2 = sizes.select(F.col("player_uid").alias("player2"), F.col("size").alias("size2"))
    fewer_first = F.col("size1") <= F.col("size2")
    driven = pairs.join(size1, "player1").join(size2, "player2").select(
        "player1",
        "player2",
        F.when(fewer_first, F.col("player1")).otherwise(F.col("player2")).alias("player_uid"),
        F.when(fewer_first, F.col("player2")).otherwise(F.col("player1")).alias("other_uid"),
    )
    first = driven.join(spans, "player_uid").select(
        "player1",
        "player2",
        "other_uid",
        "team_id",
        F.col("start").alias("own_start"),
        F.col("end").alias("own_end"),
    )
    second = spans.select(
        F.col("player_uid").alias("other_uid"),
        "team_id",
        F.col("start").alias("other_start"),
        F.col("end").alias("other_end"),
    )
    both = (
        first.join(second, ["other_uid", "team_id"])
        .select(
            "player1",
            "player2",
            F.greatest("own_start", "other_start").alias("start"),
            F.least("own_end", "other_end").alias("end"),
        )
        .filter(F.col("start") <= F.col("end"))
    )
    return covered_days(both, ["player1", "player2"], merge)


def _probe_pairs(spans: DataFrame, limit: int) -> DataFrame:
    """Likely long pairs: among the longest spans of each team and of all, the longest overlaps.

    A few spans of each team serve where teams are alike, the longest of all where one team
    holds most of these.
    """
    per_team = math.ceil((1 + math.sqrt(1 + 8 * limit)) / 2)
    length = F.datediff("end", "start")
    # a row_number limit is applied before the shuffle too, so a heavy team sends few rows
    longest = W.partitionBy("team_id").orderBy(F.desc(length), "player_uid", "start")
    some = spans.withColumn("place", F.row_number().over(longest)).filter(
        F.col("place") <= per_team
    )
    overall = spans.orderBy(F.desc(length), "player_uid", "start").limit(PROBE * limit)
    some = some.drop("place").unionByName(overall).distinct()
    pairs = (
        self_overlaps(some, False)
        .groupBy("player1", "player2")
        .agg(F.max(F.datediff("end", "start")).alias("days"))
    )
    top = _top(pairs, "days", ["player1", "player2"], PROBE * limit)
    return top.select("player1", "player2")


def pairs_with_most_time(
    stints: DataFrame,
    as_of: dt.date,
    merge: str = "lag",
    limit: int = 10,
) -> DataFrame:
    """Pairs with the most days together, exact, without forming all pairs.

    A few long pairs are added up first; the ``limit``-th best total is what any other pair
    has to reach. Days together, under either merge, are at most

    * the days of each of the two players, and the time from their first join to their last end;
    * the time from the pair's first overlap to the earlier of the two last ends.

    So only players with enough days, and only first overlaps early enough to leave room for
    the needed days, are joined. The pairs found are then added up over all their teams.
    """
    spans = keep(clean_spans(stints, as_of).distinct(), "spans")
    return pairs_with_most_time_of_spans(spans, merge, limit)


def pairs_with_most_time_of_spans(spans: DataFrame, merge: str, limit: int) -> DataFrame:
    pair = ["player1", "player2"]
    probe = keep(_probe_pairs(spans, limit), "probe-pairs")
    needed = _kth_best(_days_of_pairs(probe, spans, merge), "total_days", limit)

    players = (
        spans.groupBy("player_uid")
        .agg(
            F.max("end").alias("last_end"),
            F.least(
                F.sum(F.datediff("end", "start")), F.datediff(F.max("end"), F.min("start"))
            ).alias("most_days"),
        )
        .filter(F.col("most_days") >= needed)
        .select("player_uid", "last_end")
    )
    early = (
        spans.join(players, "player_uid")
        .filter(F.datediff("last_end", "start") >= needed)
        .select("player_uid", "team_id", "start", "end")
    )
    early = keep(early, "early-spans")
    seeds = keep(self_overlaps(early, True).select(*pair).distinct(), "pairs")
    return _top(_days_of_pairs(seeds, spans, merge), "total_days", pair, limit)
