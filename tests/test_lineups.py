"""Line-ups against a sweep over sets."""

import datetime as dt
from collections import defaultdict

import pytest

from stintbook.operators import changes, lineups, lookups
from stintbook.plans.player_page import player_page, player_teams
from stintbook.plans.team_page import nested_lineups, team_lineups, team_page
from stintbook.schema import RECORD

from conftest import AS_OF, frame, random_stints, stint

D = dt.date
FAR = D(9999, 12, 31)


def usable(row):
    join, inactive, leave = row["join_date"], row["inactive_date"], row["leave_date"]
    if join is None or (inactive is None and row["inactive_date_raw"]):
        return False
    if leave is None and row["leave_date_raw"]:
        return False
    return not (inactive and join > inactive) and not (leave and join > leave)


def sweep(rows):
    """Segments of one team as {(start, end): members}, without empty ones."""
    records = {tuple(r[c] for c in RECORD): r for r in rows if usable(r)}
    periods = {
        k: (r["join_date"], r["inactive_date"] or r["leave_date"] or FAR)
        for k, r in records.items()
    }
    periods = {k: p for k, p in periods.items() if p[0] < p[1]}
    days = sorted({d for p in periods.values() for d in p})
    found = {}
    for start, end in zip(days, days[1:]):
        members = {k for k, p in periods.items() if p[0] <= start and end <= p[1]}
        if members:
            found[start, end] = members
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_segments_and_members(spark, seed):
    rows = random_stints(seed)
    teams = defaultdict(list)
    for r in rows:
        teams[r["team_id"]].append(r)
    records = lineups.dated_records(frame(spark, rows))
    segments = lineups.lineup_segments(records)
    counted = {
        (r.team_id, r.start, r.end): r.members for r in segments.collect() if r.members
    }
    expected = {(t, *p): m for t, rs in teams.items() for p, m in sweep(rs).items()}
    assert counted == {k: len(m) for k, m in expected.items()}

    found = defaultdict(set)
    for r in lineups.lineup_members(records, segments).collect():
        found[r.team_id, r.segment_start, r.segment_end].add(tuple(r[c] for c in RECORD))
    assert found == expected


def test_each_record_is_covered_by_its_segments(spark):
    rows = random_stints(8)
    records = lineups.dated_records(frame(spark, rows))
    members = lineups.lineup_members(records, lineups.lineup_segments(records)).collect()
    days = defaultdict(int)
    for r in members:
        days[tuple(r[c] for c in RECORD)] += (r.segment_end - r.segment_start).days
    for r in records.collect():
        assert days[tuple(r[c] for c in RECORD)] == (r.end - r.start).days


def test_game_version_priority(spark):
    day, end = D(2020, 1, 1), D(2020, 2, 1)

    def version(*versions):
        rows = [stint(f"p{i}", "t", day, end, game_version=v) for i, v in enumerate(versions)]
        records = lineups.dated_records(frame(spark, rows))
        return lineups.lineup_segments(records).first().game_version

    assert version("CS", "CS: Source") == "CS1.6"
    assert version("CS: Source", "CS: Source") == "CS:S"
    assert version("CS", "CS2") == "-"
    assert version("Other", "Other") == "-"


ROWS = [
    stint("A", "Team One", D(2020, 1, 1), D(2020, 6, 1), is_captain=True, flag_name="Land"),
    stint("B", "Team One", D(2020, 3, 1), D(2020, 6, 3), position="(Coach)"),
    stint("C", "Team One", None, join_date_raw="unknown"),
    stint("C", "Team One", D(2020, 5, 30), D(2020, 5, 31)),
    stint("A", "Two", D(2021, 1, 1)),
    stint("A", "Two", D(2021, 1, 1), position="(Trial)"),
    stint("A", "Two", D(2021, 1, 1), is_captain=True),
]


def teams_of(spark):
    return spark.createDataFrame(
        [("Team One", "Team One", "https://w/Team_One"), ("Two", "Two", "https://w/Two")],
        "unique_name string, name string, wiki_url string",
    )


def test_team_page(spark):
    page = team_page(teams_of(spark), frame(spark, ROWS), "Team One", AS_OF, highlight="b")
    found = [(r.period, r.nickname, r.position, r.country, r.highlight) for r in page.collect()]
    assert found == [
        ("Entries with invalid dates", "c", "Player", "-", False),
        ("1 Jan 2020 - 1 Mar 2020", "a", "Captain", "Land", False),
        ("1 Mar 2020 - 30 May 2020", "a", "Captain", "Land", False),
        ("1 Mar 2020 - 30 May 2020", "b", "Coach", "-", True),
    ]
    assert {(r.team_name, r.reset_url) for r in page.collect()} == {("Team One", None)}
    assert team_page(teams_of(spark), frame(spark, ROWS), "None", AS_OF).count() == 0
    page = team_page(teams_of(spark), frame(spark, ROWS), "Team One", AS_OF, D(2020, 1, 1))
    assert {r.reset_url for r in page.collect()} == {"/teams/Team_One/"}


def test_window_moves_the_edges(spark):
    # B joined after the window, so its join is no longer an edge
    page = team_lineups(frame(spark, ROWS), AS_OF, D(2020, 1, 1), D(2020, 2, 1), team_id="Team One")
    periods = {r.period for r in page.collect()}
    assert periods == {"Entries with invalid dates", "1 Jan 2020 - 1 Jun 2020"}


def test_open_lineup_is_present(spark):
    page = team_lineups(frame(spark, ROWS), AS_OF, team_id="Two").collect()
    assert {r.period for r in page} == {"1 Jan 2021 - Present"}
    assert len(page) == 3


def test_player_page(spark):
    header, teams, mates = player_page(frame(spark, ROWS), "A", AS_OF)
    assert [(r.nickname, r.country) for r in header.collect()] == [("a", "-")]
    assert [(r.team_id, r.position) for r in teams.collect()][0] == ("Team One", "Captain")
    # the two entries of team Two that differ only in an unshown field are one
    assert len(teams.collect()) == 3
    assert [(r.player_uid, r.period, r.total_text) for r in mates.collect()] == [
        ("B", "1 Mar 2020 - 1 Jun 2020 (92 days)", "2 months")
    ]


def test_player_teams_drop_equal_entries(spark):
    rows = [stint("A", "t", D(2020, 1, 1), game_version=v) for v in ("CS", "CS2")]
    assert player_teams(frame(spark, rows), AS_OF).count() == 1


def test_lookups(spark):
    stints, teams = frame(spark, ROWS), teams_of(spark)
    assert lookups.team(teams, "Two").first().name == "Two"
    assert lookups.team(teams, "x").first() is None
    assert lookups.player_stints(stints, "A").count() == 4
    assert [r.item for r in lookups.entity_index(teams, stints).collect()] == [
        "team:Team One", "team:Two", "player:A", "player:B", "player:C",
    ]
    latest = {r.player_uid: (r.team_id, r.join_date) for r in lookups.latest_stint(stints).collect()}
    assert latest["A"] == ("Two", D(2021, 1, 1))
    assert latest["C"] == ("Team One", D(2020, 5, 30))


def test_every_listed_entity_has_a_page(spark):
    """Each id of the index resolves to a page with rows."""
    rows = random_stints(9, size=40, players=6, teams=2)
    stints = frame(spark, rows)
    lined = {r.team_id for r in team_lineups(stints, AS_OF).collect()}
    listed = {r["team_id"] for r in rows}
    # a team may lack line-ups only if none of its periods is long enough to show
    for team in listed - lined:
        periods = sweep([r for r in rows if r["team_id"] == team])
        assert all((e - s).days < 3 for s, e in periods)
    headed = {r.player_uid for r in player_teams(stints, AS_OF).collect()}
    assert headed == {r["player_uid"] for r in rows}


def test_members_of_a_hot_team_of_many_records(spark):
    """One team with 40,000 short records: work must follow the output."""
    from pyspark.sql import functions as F

    day_no = (F.col("id") % 20_000).cast("int")
    start = F.date_add(F.lit(D(1960, 1, 1)), day_no)
    rows = spark.range(40_000).select(
        F.lit("hot").alias("team_id"),
        F.format_string("P%d", "id").alias("player_uid"),
        F.lit("-").alias("game_version"),
        start.alias("start"),
        F.date_add(start, 5).alias("end"),
    )
    segments = lineups.lineup_segments(rows)
    members = lineups.lineup_members(rows, segments)
    assert members.count() == segments.agg(F.sum("members")).first()[0] == 200_000


def test_team_page_without_lineups(spark):
    rows = [stint("A", "Team One", D(2020, 1, 1), leave=D(2020, 1, 2))]
    (row,) = team_page(teams_of(spark), frame(spark, rows), "Team One", AS_OF).collect()
    assert row.team_url is not None and row.lineup_no is None
    assert row.player_uid is None


def test_nested_lineups(spark):
    rows = random_stints(12, size=120, players=25, teams=3)
    stints = frame(spark, rows)
    flat, nested = {}, {}
    for r in team_lineups(stints, AS_OF, highlight="p3").collect():
        player = {c: r[c] for c in r.__fields__ if c not in ("team_id", "lineup_no", "period", "game_version")}
        flat.setdefault((r.team_id, r.lineup_no, r.period, r.game_version), []).append(player)
    for most in (1_000, 4):
        nested.clear()
        found = nested_lineups(stints, AS_OF, highlight="p3", most_members=most).collect()
        for r in sorted(found, key=lambda r: r.part):
            assert 0 < len(r.players) <= most
            players = nested.setdefault((r.team_id, r.lineup_no, r.period, r.game_version), [])
            assert r.part == len(players) // most + 1
            players += [p.asDict() for p in r.players]
        assert set(nested) == set(flat)
        for key, players in nested.items():
            assert sorted(map(repr, players)) == sorted(map(repr, flat[key]))
            if key[1]:
                order = [(p["nickname"], p["player_uid"]) for p in players]
                assert order == sorted(order)


def test_undated_entries_keep_their_order(spark):
    names = ["z", "a", "m", "b", "y"]
    rows = [stint(n.upper(), "t", None, nickname=n) for n in names]
    (line,) = nested_lineups(frame(spark, rows).coalesce(1), AS_OF).collect()
    assert [p.nickname for p in line.players] == names
    by_name = nested_lineups(frame(spark, rows), AS_OF, entry_order=["nickname"], most_members=2)
    found = {r.part: [p.nickname for p in r.players] for r in by_name.collect()}
    assert found == {1: ["a", "b"], 2: ["m", "y"], 3: ["z"]}


def test_team_without_stints_in_the_window(spark):
    rows = [stint("A", "Two", D(2020, 1, 1), leave=D(2020, 6, 1))]
    page = lambda *window: team_page(teams_of(spark), frame(spark, rows), "Two", AS_OF, *window)
    assert page().count() == page(D(2020, 1, 1)).count() == 1
    assert page(None, D(2019, 1, 1)).count() == 0
    assert page(D(2021, 1, 1)).count() == 0


def test_changed_teams(spark):
    rows = random_stints(13, size=150, teams=6)
    rows += [stint("N", None, D(2020, 1, 1)), stint("M", "moved", D(2020, 1, 1), position="x")]
    same = frame(spark, rows[::-1]).repartition(3)
    before = frame(spark, rows)
    assert changes.changed_teams(before, same).count() == 0
    now = [dict(r) for r in rows if r["team_id"] != "t1"]
    now[-1] |= {"position": None, "flag_name": "x"}  # the same value in another column
    now[-2] |= {"nickname": "other"}  # of the team without an id
    now += [dict(next(r for r in rows if r["team_id"] == "t2")), stint("K", "new", D(2020, 1, 1))]
    found = changes.changed_teams(before, frame(spark, now)).collect()
    assert {(r.team_id, r.gone) for r in found} == {
        ("t1", True), ("t2", False), ("new", False), ("moved", False), (None, False),
    }


def test_digests_are_exact_sums_of_longs(spark):
    stints = frame(spark, random_stints(16, size=300, teams=3))
    columns = sorted(stints.columns)
    hashed = stints.select("team_id", *[changes._row_hash(columns, k).alias(f"h{k}") for k in (1, 2)])
    expected = defaultdict(lambda: [0, 0, 0])
    for r in hashed.collect():
        expected[r.team_id] = [a + b for a, b in zip(expected[r.team_id], (1, r.h1, r.h2))]
    digests = changes.team_digests(stints)
    found = {r.team_id: [r.records, int(r.digest_1), int(r.digest_2)] for r in digests.collect()}
    assert found == expected and digests.schema["digest_1"].dataType.precision == 29
    plan = digests._jdf.queryExecution().sparkPlan().toString()
    assert not [x for x in plan.splitlines() if "partial_sum(cast" in x and "decimal" in x]


def test_lineups_of_changed_teams(spark):
    rows = random_stints(14, size=150, teams=6)
    now = [r for r in rows if r["team_id"] != "t1"] + [stint("K", "t2", D(2020, 2, 2))]
    made = []

    def compute(stints):
        made.append({r.team_id for r in stints.select("team_id").distinct().collect()})
        return lineups.lineup_segments(lineups.dated_records(stints))

    old, new = frame(spark, rows), frame(spark, now)
    result = compute(old)
    updated = changes.bring_up_to_date(result, changes.changed_teams(old, new), new, compute)
    assert sorted(map(repr, updated.collect())) == sorted(map(repr, compute(new).collect()))
    assert made[1] == {"t2"}


def test_rows_of_members_are_not_moved_once_they_are_made(spark):
    records = lineups.dated_records(frame(spark, random_stints(15, size=40)))
    members = lineups.lineup_members(records, lineups.lineup_segments(records))
    lines = members._jdf.queryExecution().sparkPlan().toString().splitlines()
    kinds = [i for i, line in enumerate(lines) if "Join" in line], [i for i, line in enumerate(lines) if "Generate" in line]
    assert kinds[1][0] < kinds[0][0]


def test_segments_are_made_once_for_members(spark):
    records = lineups.dated_records(frame(spark, random_stints(17, size=40)))
    segments = lineups.lineup_segments(records)
    plan = lineups.lineup_members(records, segments)._jdf.queryExecution().sparkPlan().toString()
    assert sum(line.strip(" :+-").startswith("Window ") for line in plan.splitlines()) == 1


def test_nested_lineups_move_records_and_not_their_segments(spark):
    """No exchange stands between the segments of a record and the place of its player."""
    stints = frame(spark, random_stints(18, size=40))
    plan = nested_lineups(stints, AS_OF, D(2020, 1, 1), D(2021, 12, 31))._jdf.queryExecution().executedPlan()
    lines = plan.toString().splitlines()
    numbered = next(i for i, line in enumerate(lines) if "row_number()" in line and "block" in line)
    made = next(i for i, line in enumerate(lines) if i > numbered and "Generate explode" in line)
    assert not [line for line in lines[numbered:made] if "Exchange" in line]


def test_members_of_a_team_in_several_blocks(spark):
    rows = [
        stint(f"P{i}", "many", D(2010, 1, 1) + dt.timedelta(days=5 * i),
              leave=D(2010, 1, 1) + dt.timedelta(days=5 * i + 5 * (1 + i % 90)))
        for i in range(200)
    ] + [stint("Q", "few", D(2011, 1, 1)), stint("N", None, D(2011, 1, 1))]
    records = lineups.dated_records(frame(spark, rows))
    segments = lineups.lineup_segments(records)
    shown = segments.filter("members > 0 AND segment_no % 3 > 0")
    flat = lineups.lineup_members(records, shown).collect()
    gathered = lineups.gathered_members(records, shown)
    assert sorted(map(repr, flat)) == sorted(map(repr, gathered.drop("block").collect()))
    assert gathered.filter("team_id = 'many'").select("block").distinct().count() > 2
    expected = {
        (r.player_uid, s.team_id, s.segment_no)
        for r in records.collect() for s in shown.collect()
        if r.team_id and r.team_id == s.team_id and r.start <= s.start and s.end <= r.end
    }
    assert {(r.player_uid, r.team_id, r.segment_no) for r in flat} == expected
    assert len(flat) == len(expected) > 1_000
