"""Versioned snapshots of the feed: guarded publishing and reload on a newer version.

Each snapshot has a folder of its own with ``feed`` (JSON lines, gzip), ``feed_size`` (the bytes of
these lines before compression) and the tables ``teams`` and ``stints`` (Parquet), which never
changes. ``commits`` has a small file per published snapshot, numbered: the version as an ISO date,
then the folder. The one with the highest number is current.

A commit is written beside and renamed to the number after the one its publisher started from,
without overwriting. So readers see the old snapshot or the new one and never half of one, and of
two publishers that started from the same snapshot one is rejected. This is as safe as the file
system's rename: HDFS refuses a name that is taken; a local disk looks before it renames.
``updated.txt`` repeats the current version for other tools, and is replaced in one step too.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stintbook.functions.dates import iso_date
from stintbook.functions.labels import version_iso
from stintbook.functions.text import strip
from stintbook.schema import STINTS, TEAMS
from stintbook.sources.feed import (
    STINT_RULES,
    TEAM_RULES,
    build_stints,
    build_teams,
    null_counts,
    rows_of_rules,
    unknown_teams,
    write_sized_feed,
)

# The current snapshot and this many before it stay.
BACKUPS = 1

# Fixed value: a new snapshot may be at most 10 % smaller than the one it replaces.
MIN_SIZE_RATIO = 0.9


class PublishRejected(RuntimeError):
    """The new snapshot looks wrong; the current one was left as it is."""


class PublishConflict(PublishRejected):
    """Another snapshot was published meanwhile."""


class Commit(NamedTuple):
    number: int
    version: dt.date
    folder: str


class _Folder:
    """The few file operations publishing needs, on any file system Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._root = root.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self._root).getFileSystem(self._conf)

    def at(self, name: str) -> str:
        return f"{self._root}/{name}"

    def names(self, name: str) -> list[str]:
        path = self._path(self.at(name))
        if not self._fs.exists(path):
            return []
        return [status.getPath().getName() for status in self._fs.listStatus(path)]

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(self.at(name))).getLength()

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)

    def put(self, name: str, text: str, replace: bool) -> bool:
        """Write a file beside, then give it its name. False if that is taken and must stay."""
        beside = self._path(self.at(f"{name}.{uuid.uuid4().hex}.tmp"))
        out = self._fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs
        kind = getattr(files, "Options$Rename")
        options = self._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE if replace else kind.NONE
        target = self._fs.makeQualified(self._path(self.at(name)))
        context = files.FileContext.getFileContext(target.toUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(beside), target, options)
        except Py4JJavaError as error:
            self._fs.delete(beside, True)
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise
        return True


_NUMBER = re.compile(r"\d+")


def latest(spark: SparkSession, root: str) -> Commit | None:
    """The current commit; None if nothing was published yet. A damaged one raises."""
    folder = _Folder(spark, root)
    numbers = [n for n in folder.names("commits") if _NUMBER.fullmatch(n)]
    return _read(spark, folder, max(numbers, key=int)) if numbers else None


def _read(spark: SparkSession, folder: _Folder, name: str) -> Commit:
    path = folder.at(f"commits/{name}")
    lines = F.transform(F.split("value", "\n"), strip)
    row = (
        spark.read.text(path, wholetext=True)
        .select(lines.alias("lines"))
        .select(
            iso_date(F.get("lines", F.lit(0))).alias("version"),
            F.get("lines", F.lit(1)).alias("folder"),
        )
        .first()
    )
    if row is None or row.version is None or not row.folder:
        raise ValueError(f"no date and folder in {path}")
    return Commit(int(name), row.version, row.folder)


def read_version(spark: SparkSession, root: str) -> dt.date | None:
    """The published version; None if nothing was published yet. A damaged file raises."""
    commit = latest(spark, root)
    return commit.version if commit else None


def version_table(spark: SparkSession, root: str) -> DataFrame:
    """The version as a table of one row, or of none."""
    version = read_version(spark, root)
    rows = [] if version is None else [(version,)]
    return spark.createDataFrame(rows, "rosters_updated_date date")


def version_shown(spark: SparkSession, root: str) -> DataFrame:
    """The version as a page shows it, ``db_last_updated_date``; null if nothing was published."""
    rows = spark.createDataFrame([(read_version(spark, root),)], "version date")
    return rows.select(version_iso(F.col("version")).alias("db_last_updated_date"))


def publish(feed: DataFrame, root: str, version: dt.date) -> Commit:
    """Write the feed and its tables to a new folder, check them, then commit it.

    ``feed`` is computed once. A failed job, an empty result, one that breaks a constraint, one
    that shrank too much, or another snapshot published meanwhile leaves the current one. Folders
    older than the backups are removed, and with them frames that were taken from them.
    """
    return publish_from(feed.sparkSession, lambda path, commit: feed, root, version)


def publish_from(
    spark: SparkSession,
    make: Callable[[str, Commit | None], DataFrame],
    root: str,
    version: dt.date,
) -> Commit:
    """Like ``publish``, with the feed that ``make`` returns. It gets the new snapshot's path, where
    it may write tables of its own, and the commit to be followed."""
    folder = _Folder(spark, root)
    before = latest(spark, root)
    name = f"snapshot-{version.isoformat()}-{uuid.uuid4().hex}"
    try:
        _write_tables(make(folder.at(name), before), folder.at(name))
        size = _feed_size(spark, folder, name)
        if size == 0:
            raise PublishRejected("the new snapshot is empty")
        if before and size < _feed_size(spark, folder, before.folder) * MIN_SIZE_RATIO:
            raise PublishRejected("the new snapshot is significantly smaller than the old one")
        number = before.number + 1 if before else 1
        text = f"{version.isoformat()}\n{name}\n"
        if not folder.put(f"commits/{number:012d}", text, replace=False):
            raise PublishConflict("another snapshot was published meanwhile")
    except BaseException:
        folder.delete(name)
        raise
    folder.put("updated.txt", f"{version.isoformat()}\n", replace=True)
    _forget(spark, folder, number - 1 - BACKUPS)
    return Commit(number, version, name)


def _feed_size(spark: SparkSession, folder: _Folder, name: str) -> int:
    """Bytes of the lines of a snapshot's feed. Where none are noted, its files are plain."""
    if not folder.exists(f"{name}/feed_size"):
        return folder.size(f"{name}/feed")
    return int(spark.read.text(folder.at(f"{name}/feed_size")).first().value)


def _forget(spark: SparkSession, folder: _Folder, number: int) -> None:
    """Remove the folder of a commit that is no backup any more; its commit stays, so that its
    number is never given again."""
    name = f"{number:012d}"
    if number > 0 and folder.exists(f"commits/{name}"):
        folder.delete(_read(spark, folder, name).folder)


def _write_tables(feed: DataFrame, path: str) -> None:
    """The three tables of a snapshot; raises PublishRejected if a constraint is broken.

    The feed is computed for ``stints`` only, which keep the team's name and URL; all else is
    read from there, each time only the columns it needs. Rules on single rows are counted while
    rows are written.
    """
    spark = feed.sparkSession
    stints = build_stints(feed, "team_name", "team_url")
    of_stints, of_teams = Observation(), Observation()
    _by_team(stints.observe(of_stints, *null_counts(STINT_RULES))).write.parquet(f"{path}/stints")
    written = spark.read.parquet(f"{path}/stints")
    records = written.withColumnsRenamed(
        {"team_id": "team_unique_name", "player_uid": "player_unique_id", "nickname": "player_id"}
    )
    size = write_sized_feed(records.select(*feed.columns), f"{path}/feed")
    spark.range(1, numPartitions=1).select(F.lit(str(size))).write.text(f"{path}/feed_size")
    build_teams(records).observe(of_teams, *null_counts(TEAM_RULES)).write.parquet(f"{path}/teams")
    # Teams are one row each by the way they are made.
    broken = rows_of_rules("teams", of_teams.get) + rows_of_rules("stints", of_stints.get)
    broken.append(("stints.team_id known", unknown_teams(*_tables(spark, path)).count()))
    found = "; ".join(f"{rule}: {count}" for rule, count in broken if count)
    if found:
        raise PublishRejected(found)


def _by_team(stints: DataFrame) -> DataFrame:
    """Rows of a team side by side and by join date, so that a reader of few teams or of a window
    skips most of the file by its statistics. A large team is split by adaptive execution."""
    return stints.hint("rebalance", "team_id").sortWithinPartitions("team_id", "join_date")


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (
        spark.read.schema(TEAMS).parquet(f"{path}/teams"),
        spark.read.schema(STINTS).parquet(f"{path}/stints"),
    )


class RosterTables:
    """``teams`` and ``stints`` of the current snapshot, reloaded when a newer one appears."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._spark = spark
        self._root = root
        self._loaded: tuple[DataFrame, DataFrame] | None = None
        self.version: dt.date | None = None

    def current(self) -> tuple[DataFrame, DataFrame]:
        """The tables of the newest version seen so far; an older one that is published later
        loads nothing. Raises a LookupError as long as nothing is published."""
        found = latest(self._spark, self._root)
        if found and (self.version is None or found.version > self.version):
            self._loaded = _tables(self._spark, f"{self._root.rstrip('/')}/{found.folder}")
            self.version = found.version
        if self._loaded is None:
            raise LookupError(f"nothing is published under {self._root}")
        return self._loaded
