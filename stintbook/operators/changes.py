"""What changed between two snapshots, by team, and results brought up to date for these teams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row_hash(columns: list[str], salt: int) -> Column:
    """Hash of a row. A hash skips nulls, so which columns are null goes in as well."""
    return F.xxhash64(F.lit(salt), *[F.col(c).isNull() for c in columns], *columns)


def _total(numbers: Column) -> Column:
    """Sum of 64-bit numbers, which needs more room than they do: of their halves, each as a long,
    and put together once a group. Halves of two billion rows fit."""
    wide = lambda half: F.sum(half).cast("decimal(19,0)")
    high, low = F.shiftright(numbers, 32), numbers.bitwiseAND(F.lit((1 << 32) - 1))
    total = wide(high) * F.lit(1 << 32).cast("decimal(10,0)") + wide(low)
    return total.cast("decimal(29,0)")


def team_digests(stints: DataFrame) -> DataFrame:
    """One row per team: ``team_id, records, digest_1, digest_2``.

    The digests are sums of two hashes of each row, so they don't depend on the order of rows,
    count repeated ones, and are added up before any shuffle. A team without an id is one too.
    """
    columns = sorted(stints.columns)
    hashed = stints.select(
        "team_id", _row_hash(columns, 1).alias("hash_1"), _row_hash(columns, 2).alias("hash_2")
    )
    return hashed.groupBy("team_id").agg(
        F.count(F.lit(1)).alias("records"),
        _total(F.col("hash_1")).alias("digest_1"),
        _total(F.col("hash_2")).alias("digest_2"),
    )


def changed_teams(before: DataFrame, now: DataFrame) -> DataFrame:
    """Teams whose stints differ between two tables, and those that only one of them has.

    Columns ``team_id`` and ``gone`` (no stints any more).
    """
    measures = ["records", "digest_1", "digest_2"]
    old = team_digests(before.select(*now.columns)).withColumnsRenamed(
        {c: f"old_{c}" for c in ["team_id", *measures]}
    )
    new = team_digests(now)
    same_team = F.col("team_id").eqNullSafe(F.col("old_team_id"))
    differ = F.lit(False)
    for m in measures:
        differ = differ | ~F.col(m).eqNullSafe(F.col(f"old_{m}"))
    return (
        new.join(old, same_team, "full")
        .filter(differ)
        .select(
            F.when(F.col("records").isNull(), F.col("old_team_id"))
            .otherwise(F.col("team_id"))
            .alias("team_id"),
            F.col("records").isNull().alias("gone"),
        )
    )


def bring_up_to_date(
    result: DataFrame, changed: DataFrame, now: DataFrame, compute: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``compute(now)``, from an earlier ``result`` of it and the teams that changed since.

    For computations that treat each team by itself and keep ``team_id``. Only the stints of
    changed teams are computed again; ``changed`` is read twice, so it should be a kept table.
    """
    teams = changed.select(F.col("team_id").alias("changed_id"))
    of_team = F.col("team_id").eqNullSafe(F.col("changed_id"))
    fresh = compute(now.join(teams, of_team, "left_semi"))
    return result.join(teams, of_team, "left_anti").unionByName(fresh)
