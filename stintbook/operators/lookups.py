"""Point lookups and id listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stintbook.functions.predicates import period_start
from stintbook.schema import RECORD


def team(teams: DataFrame, unique_name: str) -> DataFrame:
    return teams.filter(F.col("unique_name") == unique_name).limit(1)


def teams_of(teams: DataFrame, ids: DataFrame) -> DataFrame:
    """The teams listed in a column ``team_id``."""
    listed = ids.select(F.col("team_id").alias("unique_name"))
    return teams.join(listed, "unique_name", "left_semi")


def player_stints(stints: DataFrame, player_uid: str) -> DataFrame:
    return stints.filter(F.col("player_uid") == player_uid).select(*RECORD)


def stints_of(stints: DataFrame, players: DataFrame) -> DataFrame:
    """All stints of the players listed in a column ``player_uid``."""
    return stints.join(players.select("player_uid"), "player_uid", "left_semi").select(*RECORD)


def team_names(teams: DataFrame) -> DataFrame:
    return teams.select("unique_name")


def player_names(stints: DataFrame) -> DataFrame:
    return stints.select("player_uid").distinct()


def entity_index(teams: DataFrame, stints: DataFrame) -> DataFrame:
    """All ids for the search box: ``team:`` ids in order, then ``player:`` ids in order."""
    listed = [
        (0, "team:", team_names(teams).withColumnRenamed("unique_name", "id")),
        (1, "player:", player_names(stints).withColumnRenamed("player_uid", "id")),
    ]
    parts = [
        ids.filter(F.length("id") > 0).select(
            F.lit(kind).alias("kind"),
            F.col("id"),
            F.concat(F.lit(prefix), F.col("id")).alias("item"),
        )
        for kind, prefix, ids in listed
    ]
    return parts[0].unionAll(parts[1]).orderBy("kind", "id").select("item")


def latest_stint(stints: DataFrame) -> DataFrame:
    """Each player's stint with the latest start; an unknown start counts as the earliest.

    A row_number limit is applied before the shuffle too, so a busy player sends few rows.
    """
    ties = [F.asc_nulls_last(c) for c in RECORD if c != "player_uid"]
    newest = W.partitionBy("player_uid").orderBy(F.desc(period_start()), *ties)
    return (
        stints.select(*RECORD)
        .withColumn("place", F.row_number().over(newest))
        .filter("place = 1")
        .drop("place")
    )
