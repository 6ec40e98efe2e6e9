"""Merging and overlap joins against brute force."""

import datetime as dt
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stintbook.operators import overlap, rankings
from stintbook.operators.merging import covered_days, disjoint_periods
from stintbook.operators.teammates import teammate_periods, teammate_summary
from stintbook.plans import main_report
from stintbook.sources.shared import keep

from conftest import AS_OF, frame, is_clean, overlap_end, random_stints, stint

D = dt.date
ORIGIN = D(2020, 1, 1)


def lag_days(intervals):
    total, before = 0, None
    for start, end in sorted(intervals):
        if before is None or start > before:
            total += (end - start).days
        else:
            total += (end - max(before, start)).days
        before = end
    return total


def exact_days(intervals):
    days = set()
    for start, end in intervals:
        days.update(range(start.toordinal(), end.toordinal()))
    return len(days)


def brute_pairs(rows, closed):
    """Overlaps per unordered pair of players."""
    clean = [(r, r["join_date"], overlap_end(r)) for r in rows if is_clean(r)]
    pairs = defaultdict(list)
    for a, sa, ea in clean:
        for b, sb, eb in clean:
            if a["team_id"] == b["team_id"] and a["player_uid"] < b["player_uid"]:
                start, end = max(sa, sb), min(ea, eb)
                if start < end or (closed and start == end):
                    pairs[a["player_uid"], b["player_uid"]].append((start, end))
    return pairs


spans = st.lists(
    st.tuples(st.sampled_from("ab"), st.integers(0, 30), st.integers(0, 15)), min_size=1, max_size=25
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(spans)
def test_covered_days(spark, rows):
    dated = [
        (k, ORIGIN + dt.timedelta(s), ORIGIN + dt.timedelta(s + n)) for k, s, n in rows
    ]
    df = spark.createDataFrame(dated, "k string, start date, end date")
    by_key = defaultdict(list)
    for key, start, end in dated:
        by_key[key].append((start, end))
    for merge, rule in (("lag", lag_days), ("exact", exact_days)):
        found = {r.k: r.total_days for r in covered_days(df, ["k"], merge).collect()}
        assert found == {k: rule(v) for k, v in by_key.items()}
    periods = defaultdict(list)
    for r in disjoint_periods(df, ["k"]).collect():
        periods[r.k].append((r.start, r.end))
    for key, found in periods.items():
        found.sort()
        assert all(a[1] < b[0] for a, b in zip(found, found[1:]))
        assert exact_days(found) == exact_days(by_key[key])


def test_contained_interval(spark):
    rows = [("k", D(2020, 1, 1), D(2020, 4, 9)), ("k", D(2020, 1, 2), D(2020, 2, 19))]
    df = spark.createDataFrame(rows, "k string, start date, end date")
    assert covered_days(df, ["k"], "lag").first().total_days == 49
    assert covered_days(df, ["k"], "exact").first().total_days == 99
    with pytest.raises(ValueError):
        covered_days(df, ["k"], "other")


@pytest.mark.parametrize("direct", [0, 70, 200])
@pytest.mark.parametrize("closed", [True, False])
def test_self_overlaps(spark, monkeypatch, closed, direct):
    monkeypatch.setattr(overlap, "DIRECT", direct)
    rows = random_stints(1)
    cleaned = overlap.clean_spans(frame(spark, rows), AS_OF)
    found = defaultdict(list)
    for r in overlap.self_overlaps(cleaned, closed).collect():
        found[r.player1, r.player2].append((r.start, r.end))
    expected = brute_pairs(rows, closed)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}


@pytest.mark.parametrize("direct", [0, 200])
def test_long_and_reversed_spans(spark, monkeypatch, direct):
    monkeypatch.setattr(overlap, "DIRECT", direct)
    # a long overlap is found once; a reversed span meets nothing
    rows = [
        ("A", "t", D(2020, 1, 1), D(2022, 12, 31)),
        ("B", "t", D(2019, 5, 1), D(2021, 6, 30)),
        ("C", "t", D(2021, 2, 1), D(2021, 1, 1)),
        ("D", "t", D(2022, 12, 31), D(2023, 1, 5)),
    ]
    spans_ = spark.createDataFrame(rows, "player_uid string, team_id string, start date, end date")
    chosen = spans_.filter("player_uid = 'A'")
    for closed, mates in ((False, {"B"}), (True, {"B", "D"})):
        found = overlap.overlaps_with(chosen, spans_, closed).collect()
        assert sorted(r.player_uid for r in found) == sorted(mates)
        assert {r.of_player for r in found} == {"A"}


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(-900, 9000), st.integers(0, 30_000)), min_size=1, max_size=20))
def test_nodes_make_up_the_days(spark, rows):
    epoch = D(1970, 1, 1)
    dated = [(k, epoch + dt.timedelta(a), epoch + dt.timedelta(a + n)) for k, (a, n) in enumerate(rows)]
    df = spark.createDataFrame(dated, "k int, start date, after date")
    nodes = overlap._nodes(F.col("start"), F.col("after")).alias("nodes")
    for r in df.select("k", nodes, overlap._around(F.col("start")).alias("around")).collect():
        a, n = rows[r.k]
        days = sorted(d for size, i in r.nodes for d in range(i * 4**size, (i + 1) * 4**size))
        assert days == list(range(a, a + n))
        assert len(r.nodes) <= 6 * overlap.SIZES
        assert sum(tuple(x) in set(map(tuple, r.nodes)) for x in r.around) == (n > 0)


@pytest.mark.parametrize("closed", [True, False])
def test_rows_that_meet_are_the_result(spark, monkeypatch, closed):
    monkeypatch.setattr(overlap, "DIRECT", 0)
    cleaned = overlap.clean_spans(frame(spark, random_stints(3)), AS_OF)
    side = lambda name: overlap._lasting(cleaned, closed).select(
        "team_id", *[F.col(c).alias(f"{name}_{c}") for c in ("player_uid", "start", "end")]
    )
    met = overlap._meeting(side("earlier"), side("later"), closed)
    other = met.filter("earlier_player_uid <> later_player_uid")
    equal = other.filter("earlier_start = later_start").count()
    assert other.count() - equal // 2 == overlap.self_overlaps(cleaned, closed).count()


def test_many_records_on_few_days(spark):
    """All pairs of a team's records in one quarter would be 20 billion."""
    first = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 90).cast("int"))
    short = spark.range(200_000).select(
        F.concat(F.lit("p"), F.col("id")).alias("player_uid"),
        F.lit("t").alias("team_id"),
        first.alias("start"),
        # one in two hundred lasts longer than a day's change
        F.when(F.col("id") % 200 == 0, F.date_add(first, 3)).otherwise(first).alias("end"),
    )
    brute = short.filter("start < end").collect()
    pairs = sum(
        a.player_uid < b.player_uid and max(a.start, b.start) < min(a.end, b.end)
        for a in brute for b in brute
    )
    found = overlap.self_overlaps(short, False)
    assert found.count() == pairs > 1_000
    # from day 0 to day 3
    mates = overlap.overlaps_with(short.filter("player_uid = 'p0'"), short, True)
    assert mates.count() == sum(i % 90 < 4 for i in range(1, 200_000))


@pytest.mark.parametrize("merge", ["lag", "exact"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_with_most_time(spark, merge, seed):
    rows = random_stints(seed)
    rule = {"lag": lag_days, "exact": exact_days}[merge]
    totals = {pair: rule(v) for pair, v in brute_pairs(rows, True).items()}
    df = frame(spark, rows)
    together = overlap.self_overlaps(overlap.clean_spans(df, AS_OF).distinct(), True)
    whole = covered_days(together, ["player1", "player2"], merge).collect()
    assert {(r.player1, r.player2): r.total_days for r in whole} == totals
    best = sorted(totals.items(), key=lambda t: (-t[1], t[0]))
    for limit in (4, 25, 10_000):
        found = rankings.pairs_with_most_time(df, AS_OF, merge, limit).collect()
        assert [((r.player1, r.player2), r.total_days) for r in found] == best[:limit]


@pytest.mark.parametrize("seed", [1, 2])
def test_most_teammates(spark, seed):
    rows = random_stints(seed, players=60)
    mates = defaultdict(set)
    for a, b in brute_pairs(rows, False):
        mates[a].add(b)
        mates[b].add(a)
    best = sorted(((p, len(m)) for p, m in mates.items()), key=lambda t: (-t[1], t[0]))
    for limit in (2, 7, 1000):
        found = rankings.most_teammates(frame(spark, rows), AS_OF, limit).collect()
        assert [tuple(r) for r in found] == best[:limit]


@pytest.mark.parametrize("largest", [20_000, 30])
def test_rounds_stop_early_among_ties(spark, monkeypatch, largest):
    """3,000 players of one team with the same dates tie; a few of them are enough."""
    monkeypatch.setattr(rankings, "LARGEST_ROUND", largest)
    counted = []
    count = rankings.teammate_counts

    def watched(players, periods):
        counted.append(players.count())
        return count(players, periods)

    monkeypatch.setattr(rankings, "teammate_counts", watched)
    spans_ = spark.range(3_000).select(
        F.format_string("P%05d", "id").alias("player_uid"),
        F.lit("t").alias("team_id"),
        F.lit(ORIGIN).alias("start"),
        F.lit(ORIGIN + dt.timedelta(days=9)).alias("end"),
    )
    found = rankings.most_teammates_of_spans(spans_, 3).collect()
    assert [tuple(r) for r in found] == [(f"P{i:05}", 2_999) for i in range(3)]
    assert counted == [rankings.PROBE * 3]


@pytest.mark.parametrize("growth,largest", [(2, 10_000), (2, 8), (1, 4)])
def test_rounds_find_the_same(spark, monkeypatch, growth, largest):
    monkeypatch.setattr(rankings, "PROBE", 1)
    monkeypatch.setattr(rankings, "ROUND_GROWTH", growth)
    monkeypatch.setattr(rankings, "LARGEST_ROUND", largest)
    rows = random_stints(8, players=60)
    mates = defaultdict(set)
    for a, b in brute_pairs(rows, False):
        mates[a].add(b)
        mates[b].add(a)
    best = sorted(((p, len(m)) for p, m in mates.items()), key=lambda t: (-t[1], t[0]))
    found = rankings.most_teammates(frame(spark, rows), AS_OF, 4).collect()
    assert [tuple(r) for r in found] == best[:4]


def test_teammate_bounds_hold(spark):
    rows = random_stints(5, players=60)
    periods = rankings.team_spans(overlap.clean_spans(frame(spark, rows), AS_OF))
    found = rankings.teammate_bounds(periods)
    bounds = {r.player_uid: r.bound for r in found.collect()}
    mates = defaultdict(set)
    for a, b in brute_pairs(rows, False):
        mates[a].add(b)
        mates[b].add(a)
    assert all(bounds[p] >= len(m) for p, m in mates.items())
    assert all(bounds[p] >= 0 for p in bounds)


def test_teammate_bounds_are_close(spark):
    # a mate who left and came back counts once; one who was away all the while counts too
    days = [ORIGIN + dt.timedelta(days=i) for i in range(50)]
    rows = [
        stint("long", "t", days[0], days[40]),
        stint("back", "t", days[1], days[5]),
        stint("back", "t", days[10], days[15]),
        stint("back", "t", days[20], days[25]),
        stint("short", "t", days[6], days[8]),
    ]
    periods = rankings.team_spans(overlap.clean_spans(frame(spark, rows), AS_OF))
    found = {r.player_uid: r.bound for r in rankings.teammate_bounds(periods).collect()}
    assert found == {"long": 2, "back": 2, "short": 1}


def test_few_numbers_are_moved_for_bounds(spark):
    periods = rankings.team_spans(overlap.clean_spans(frame(spark, random_stints(6)), AS_OF))
    plan = rankings.teammate_bounds(periods)._jdf.queryExecution().sparkPlan().toString()
    lines = [x for x in plan.splitlines() if "Aggregate(keys=[player_uid" in x and "partial_" in x]
    assert any("opened_before" in x for x in lines)
    assert all(x.count("partial_") <= 6 for x in lines if "opened_before" in x)


def test_mates_are_looked_up_in_teams_of_the_chosen(spark):
    rows = random_stints(9, teams=8) + [stint("lone", "own", D(2020, 1, 1), D(2020, 3, 1))]
    rows += [stint("mate", "own", D(2020, 2, 1), D(2020, 4, 1)), stint("lone", None, D(2020, 1, 1))]
    periods = rankings.team_spans(overlap.clean_spans(frame(spark, rows), AS_OF))
    counts = rankings.teammate_counts(spark.createDataFrame([("lone",)], "player_uid string"), periods)
    assert [tuple(r) for r in counts.collect()] == [("lone", 1)]
    teams = {f for f in counts.inputFiles() if "teams-of-chosen" in f}
    assert {r.team_id for r in spark.read.parquet(*teams).collect()} == {"own", None}


def test_kept_tables_are_small(spark):
    kept = keep(frame(spark, random_stints(7)), "some")
    assert all(".zstd." in f for f in kept.inputFiles()) and kept.count() > 0


def test_main_report_reads_stints_once(spark, tmp_path):
    path = str(tmp_path / "stints")
    frame(spark, random_stints(8)).write.parquet(path)
    report = main_report.main_report(spark.read.parquet(path), AS_OF)
    assert not [f for f in report.inputFiles() if path in f]
    assert report.count() > 0


def test_current_tenure(spark):
    rows = random_stints(4) + [
        stint("future", "t", AS_OF + dt.timedelta(days=9)),
        stint("both", "t", AS_OF - dt.timedelta(days=9)),
        stint("both", "t", AS_OF + dt.timedelta(days=4)),
    ]
    spans_ = defaultdict(list)
    for r in rows:
        if is_clean(r) and r["leave_date"] is None and r["inactive_date"] is None:
            spans_[r["player_uid"], r["team_id"]].append((r["join_date"], AS_OF))
    df = frame(spark, rows)
    found = rankings.current_tenure(df, AS_OF, "lag").collect()
    assert {(r.player_uid, r.team_id): r.total_days for r in found} == {
        k: lag_days(v) for k, v in spans_.items()
    }
    found = rankings.current_tenure(df, AS_OF, "exact").collect()
    assert {(r.player_uid, r.team_id): r.total_days for r in found} == {
        k: exact_days(v) for k, v in spans_.items()
    }


def test_counting_rankings(spark):
    rows = [
        stint("A", "x", ORIGIN, flag_name="U"),
        stint("A", "x", ORIGIN, flag_name="U"),
        stint("A", "y", ORIGIN, D(2021, 1, 1), flag_name="U"),
        stint("B", "y", ORIGIN, None, D(2021, 1, 1)),
        stint("C", "y", ORIGIN, leave_date_raw="?", flag_name="U"),
        stint("D", "y", None, flag_name="U"),
    ]
    df = frame(spark, rows)
    assert [tuple(r) for r in rankings.most_teams(df, 2).collect()] == [("A", 2), ("B", 1)]
    assert [tuple(r) for r in rankings.teams_with_most_players(df).collect()] == [("y", 3), ("x", 1)]
    assert [tuple(r) for r in rankings.active_by_country(df).collect()] == [("U", 1), (None, 1)]


@pytest.mark.parametrize("merge", ["lag", "exact"])
def test_teammate_periods(spark, merge):
    rows = random_stints(6)
    chosen = {"P1", "P2", "P3"}
    ties = ["team_id", "join_date", "inactive_date", "leave_date", "game_version", "nickname",
            "full_name", "player_url", "is_captain", "position", "flag_name"]

    def order(met):
        row, start, end = met
        return (start, end, *((row[t] is None, str(row[t] or "")) for t in ties))

    clean = [r for r in rows if is_clean(r)]
    met = defaultdict(list)
    for a in clean:
        for b in clean:
            if a["player_uid"] in chosen and a["player_uid"] != b["player_uid"] \
                    and a["team_id"] == b["team_id"]:
                start = max(a["join_date"], b["join_date"])
                end = min(overlap_end(a), overlap_end(b))
                if start < end:
                    met[a["player_uid"], b["player_uid"]].append((b, start, end))
    expected = set()
    for (player, _), overlaps in met.items():
        before = None
        for row, start, end in sorted(overlaps, key=order):
            apart = before is None or start > before
            period = (start, end) if apart else (before, max(end, before))
            expected.add((player, row["player_uid"], row["team_id"], row["join_date"],
                          row["position"], row["game_version"], row["is_captain"], *period))
            before = end if merge == "lag" else max(end, before or end)
    players = spark.createDataFrame([(p,) for p in chosen], "player_uid string")
    periods = teammate_periods(frame(spark, rows), players, AS_OF, merge)
    found = {
        (r.of_player, r.player_uid, r.team_id, r.join_date, r.position, r.game_version,
         r.is_captain, r.overlap_start, r.overlap_end)
        for r in periods.collect()
    }
    assert found == expected

    days = defaultdict(int)
    for r in periods.collect():
        length = (r.overlap_end - r.overlap_start).days
        days[r.of_player, r.player_uid] += length if length >= 3 else 0
    summary = teammate_summary(periods).collect()
    assert {(r.of_player, r.player_uid): r.total_days for r in summary} == {
        k: v for k, v in days.items() if v
    }
    assert all(r.days >= 3 for r in summary)
