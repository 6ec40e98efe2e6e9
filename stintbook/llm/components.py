"""Connected components of an edge table, by rounds of stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintbook.sources.shared import keep


def connected(edges: DataFrame) -> DataFrame:
    """From ``edges`` (a, b) to rows (node, root): root is the smallest node of the component.

    Each round hangs every node's larger neighbours, then its smaller ones, under the smallest
    node it sees, so long chains shrink fast. Only the edges' number and a sum of their hashes
    reach the driver. Loops and repeated edges are allowed; nodes without an edge are left out.
    """
    edges = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = keep(edges.distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        larger = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), "m")
        larger = larger.filter("a <> m").withColumnRenamed("m", "b").distinct()
        lowest = larger.groupBy("a").agg(F.min("b").alias("m"))
        hung = larger.join(lowest, "a")
        hung = hung.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = keep(
            hung.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges"
        )
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
