"""Roster feed: reading, the tables built from it, their constraints, and writing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F

from stintbook.functions.predicates import stored_end
from stintbook.schema import ROSTER_FEED


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with a declared schema: absent keys are null, ISO dates are dates.

    A line that is no record, or a value of the wrong type, fails the load.
    """
    return spark.read.schema(ROSTER_FEED).option("mode", "FAILFAST").json(path)


# A compressed file is read by one task, so it holds this many records at most.
RECORDS_PER_FILE = 500_000


def write_feed(feed: DataFrame, path: str, mode: str = "error", compression: str = "none") -> None:
    """JSON lines, UTF-8, null keys kept."""
    _writer(feed, mode, compression).option("ignoreNullFields", "false").json(path)


def write_sized_feed(feed: DataFrame, path: str, compression: str = "gzip") -> int:
    """Like ``write_feed``; returns the bytes of the lines, whatever they take when compressed."""
    written = Observation()
    record = F.to_json(F.struct(*feed.columns), {"ignoreNullFields": "false"})
    lines = feed.select(record.alias("value"))
    size = F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).cast("bigint").alias("size")
    _writer(lines.observe(written, size), "error", compression).text(path)
    return written.get["size"]


def _writer(rows: DataFrame, mode: str, compression: str) -> DataFrameWriter:
    writer = rows.write.mode(mode).option("compression", compression)
    if compression != "none":
        writer = writer.option("maxRecordsPerFile", RECORDS_PER_FILE)
    return writer


def build_teams(feed: DataFrame) -> DataFrame:
    """One row per team. Where a team has several names or URLs, the smallest pair is kept."""
    # hashing removes repeats before the shuffle; the minimum of a struct would have to sort them
    versions = feed.select(
        F.col("team_unique_name").alias("unique_name"), "team_name", "team_url"
    ).distinct()
    return (
        versions.groupBy("unique_name")
        .agg(F.min(F.struct("team_name", "team_url")).alias("chosen"))
        .select(
            "unique_name",
            F.col("chosen.team_name").alias("name"),
            F.col("chosen.team_url").alias("wiki_url"),
        )
    )


def build_stints(feed: DataFrame, *more: str) -> DataFrame:
    """The fact table; ``more`` names columns of the feed that are kept besides."""
    return feed.select(
        F.col("player_unique_id").alias("player_uid"),
        F.col("team_unique_name").alias("team_id"),
        "game_version",
        F.col("player_id").alias("nickname"),
        "full_name",
        "player_url",
        "is_captain",
        "position",
        "flag_name",
        "join_date",
        "inactive_date",
        "leave_date",
        stored_end().alias("inactive_or_leave_date"),
        "has_invalid_dates",
        "join_date_raw",
        "inactive_date_raw",
        "leave_date_raw",
        *more,
    )


# Columns that must not be null.
TEAM_RULES = ["unique_name", "name", "wiki_url"]
STINT_RULES = ["nickname", "is_captain", "has_invalid_dates"]


def null_counts(columns: list[str]) -> list[Column]:
    """Aggregates for an observation, one per column."""
    return [F.count_if(F.col(c).isNull()).alias(c) for c in columns]


def rows_of_rules(table: str, counted: dict[str, int]) -> list[tuple[str, int]]:
    return [(f"{table}.{c} not null", n) for c, n in counted.items()]


def unknown_teams(teams: DataFrame, stints: DataFrame) -> DataFrame:
    """Team ids of stints that no team has, each once.

    They are made distinct first, so a team with many stints is looked up once.
    """
    used = stints.select("team_id").filter(F.col("team_id").isNotNull()).distinct()
    return used.join(teams, F.col("team_id") == F.col("unique_name"), "left_anti")


def constraint_report(teams: DataFrame, stints: DataFrame) -> DataFrame:
    """Number of violations per rule; all zero for a sound load."""

    def nulls(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
        # one pass over the table, then one row per rule
        counted = df.agg(*null_counts(columns))
        pairs = [
            F.struct(F.lit(f"{table}.{c} not null").alias("rule"), F.col(c).alias("violations"))
            for c in columns
        ]
        return counted.select(F.inline(F.array(*pairs)))

    def one(df: DataFrame, rule: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(rule).alias("rule"), "violations"
        )

    twice = (
        teams.groupBy("unique_name")
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter((F.col("copies") > 1) & F.col("unique_name").isNotNull())
    )
    parts = [
        nulls(teams, "teams", TEAM_RULES),
        one(twice, "teams.unique_name unique"),
        nulls(stints, "stints", STINT_RULES),
        one(unknown_teams(teams, stints), "stints.team_id known"),
    ]
    return reduce(DataFrame.unionByName, parts)


def check_constraints(teams: DataFrame, stints: DataFrame) -> None:
    """Raise if any rule is violated. The report has a fixed, small number of rows."""
    broken = constraint_report(teams, stints).filter("violations > 0").collect()
    if broken:
        raise ValueError("; ".join(f"{r.rule}: {r.violations}" for r in broken))
