"""Refresh: stored pages to a published snapshot."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stintbook.schema import ROSTER_FEED
from stintbook.sources.pages import extract_feed, extract_records
from stintbook.sources.snapshot import Commit, publish, publish_from


class Refreshed(NamedTuple):
    commit: Commit
    contents: int  # different pages
    parsed: int  # of these, the ones the snapshot before did not have


def refresh(pages: DataFrame, root: str, version: dt.date) -> Commit:
    """Extract the roster feed of ``pages(page_id, url, html)`` and publish it under ``root``."""
    return publish(extract_feed(pages), root, version)


def page_digest() -> Column:
    """What a page's records depend on: its URL and text, not its id."""
    return F.sha2(F.to_json(F.struct("url", "html")), 256)


def refresh_incremental(pages: DataFrame, root: str, version: dt.date) -> Refreshed:
    """Like ``refresh``, but pages the current snapshot was made of are not parsed again.

    A snapshot made here also holds ``contents`` (digest of each page) and ``records`` (the
    extracted records of each). Pages are joined with those by digest; only new or changed ones
    are parsed, and those that are gone leave. Repeated pages are parsed once and counted as often
    as they stand. After a snapshot that was made by ``refresh``, all pages are parsed.
    """
    spark = pages.sparkSession
    counted, seen = Observation(), Observation()

    def make(path: str, before: Commit | None) -> DataFrame:
        old = f"{root.rstrip('/')}/{before.folder}" if before else None
        digested = pages.filter(F.col("html").isNotNull()).select(
            page_digest().alias("digest"), "url", "html"
        )
        one = F.count(F.lit(1))
        copies = digested.groupBy("digest").agg(one.alias("copies"))
        copies.observe(counted, one.alias("n")).write.parquet(f"{path}/contents")
        now = spark.read.parquet(f"{path}/contents")
        known, reused = _of_snapshot(spark, old)
        fresh = now.join(known, "digest", "left_anti").select("digest")
        texts = digested.join(fresh, "digest", "left_semi").dropDuplicates(["digest"])
        parsed = texts.observe(seen, one.alias("n")).withColumnRenamed("digest", "page_id")
        new = extract_records(parsed).withColumnRenamed("page_id", "digest")
        kept = reused.join(now.select("digest"), "digest", "left_semi")
        columns = ["digest", *ROSTER_FEED.names]
        new.select(*columns).unionByName(kept.select(*columns)).write.parquet(f"{path}/records")
        records = spark.read.parquet(f"{path}/records").join(now, "digest")
        repeated = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
        return records.withColumn("copy", repeated).select(*ROSTER_FEED.names)

    commit = publish_from(spark, make, root, version)
    return Refreshed(commit, counted.get["n"], seen.get["n"])


def _of_snapshot(spark, path: str | None) -> tuple[DataFrame, DataFrame]:
    """Digests and records of a snapshot; empty where it has none."""
    records = "digest string, " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in ROSTER_FEED.fields
    )
    schemas = {"contents": "digest string", "records": records}
    found = []
    for name, schema in schemas.items():
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if path and where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            found.append(spark.read.schema(schema).parquet(f"{path}/{name}"))
        else:
            found.append(spark.createDataFrame([], schema))
    return found[0], found[1]
