"""Merging intervals of one key.

Both forms first shrink each key to one row per start date, which partial aggregation does
before the shuffle. After that a key has at most one row per calendar day, so the window that
follows stays small even for a key that holds a large share of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MERGES = ("lag", "exact")


def disjoint_periods(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Union of ``[start, end]`` per key as disjoint periods; touching periods are joined.

    Adds ``period_no``, counted from 1, and ``periods``, the number the key has in all.
    """
    reduced = intervals.groupBy(*keys, "start").agg(F.max("end").alias("end"))
    ordered = W.partitionBy(*keys).orderBy("start")
    reached = F.max("end").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reached.isNull() | (F.col("start") > reached), 1).otherwise(0)
    return (
        reduced.withColumn("opens", opens)
        .withColumn("period_no", F.sum("opens").over(ordered))
        .withColumn("periods", F.sum("opens").over(W.partitionBy(*keys)))
        .groupBy(*keys, "period_no", "periods")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )


def covered_days(intervals: DataFrame, keys: list[str], merge: str = "lag") -> DataFrame:
    """Days covered per key as ``total_days``. Every interval must have ``start <= end``.

    ``lag`` compares each interval, in order of (start, end), with the one before it only.
    A contained interval then takes days away: [1, 100] and [2, 50] give 49. ``exact`` is the
    length of the union.

    Under ``lag`` the intervals that share a start add up to their last end minus their first
    end, whatever lies between, so the first and last end per start date are all it needs.
    """
    if merge not in MERGES:
        raise ValueError(f"merge must be one of {MERGES}, not {merge!r}")
    ordered = W.partitionBy(*keys).orderBy("start")
    reduced = intervals.groupBy(*keys, "start").agg(
        F.min("end").alias("first_end"), F.max("end").alias("last_end")
    )
    if merge == "lag":
        before = F.lag("last_end").over(ordered)
        begins = F.coalesce(F.greatest(before, F.col("start")), F.col("start"))
        days = F.datediff("first_end", begins) + F.datediff("last_end", "first_end")
    else:
        reached = F.max("last_end").over(ordered.rowsBetween(W.unboundedPreceding, -1))
        begins = F.coalesce(F.greatest(reached, F.col("start")), F.col("start"))
        days = F.greatest(F.datediff("last_end", begins), F.lit(0))
    return (
        reduced.withColumn("days", days)
        .groupBy(*keys)
        .agg(F.sum("days").alias("total_days"))
    )
