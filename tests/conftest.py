from __future__ import annotations

import datetime as dt
import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from stintbook.schema import STINTS  # noqa: E402

AS_OF = dt.date(2024, 12, 31)
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def stint(player: str, team: str, join=None, leave=None, inactive=None, **more) -> dict:
    row = dict.fromkeys(STINTS.names)
    row |= {
        "player_uid": player,
        "team_id": team,
        "nickname": player.lower(),
        "is_captain": False,
        "join_date": join,
        "leave_date": leave,
        "inactive_date": inactive,
        "inactive_or_leave_date": inactive or leave,
        "has_invalid_dates": False,
    }
    return row | more


def frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[n] for n in STINTS.names) for r in rows], STINTS)


def random_stints(seed: int, size: int = 250, players: int = 25, teams: int = 4) -> list[dict]:
    """Stints with duplicates, empty and reversed periods, unknown dates and raw texts."""
    rng = random.Random(seed)
    origin = dt.date(2020, 1, 1)
    rows = []
    for _ in range(size):
        # one team gets a third of all rows
        team = "hot" if rng.random() < 0.33 else f"t{rng.randrange(teams)}"
        join = origin + dt.timedelta(days=rng.randrange(400))
        end = join + dt.timedelta(days=rng.choice([-5, 0, 1, 2, 10, 40, 90, 200]))
        row = stint(
            f"P{rng.randrange(players)}",
            team,
            join,
            leave=end if rng.random() < 0.6 else None,
            inactive=end if rng.random() < 0.3 else None,
            game_version=rng.choice([None, "CS", "CS: Source", "CS:GO", "CS2"]),
            is_captain=rng.random() < 0.2,
            position=rng.choice([None, "(Coach)", "(Trial)"]),
        )
        if rng.random() < 0.05:
            row |= {"join_date": None, "join_date_raw": "unknown"}
        if rng.random() < 0.05:
            row["leave_date_raw"] = "2021-??-??"
        rows.append(row)
        if rng.random() < 0.1:
            rows.append(dict(row))
    return rows


def is_clean(row: dict) -> bool:
    raws = ("join_date_raw", "leave_date_raw", "inactive_date_raw")
    return row["join_date"] is not None and not any(row[r] for r in raws)


def overlap_end(row: dict, as_of: dt.date = AS_OF) -> dt.date:
    return min(row["inactive_date"] or as_of, row["leave_date"] or as_of)
