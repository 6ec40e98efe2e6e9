"""Feed, snapshots and page extraction."""

import datetime as dt
import gzip
import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stintbook.plans.refresh import refresh, refresh_incremental
from stintbook.schema import ROSTER_FEED, STINTS
from stintbook.sources import feed as feeds
from stintbook.sources import html, pages, rosters, shared, snapshot
from stintbook.sources.html import Has, parse, select

D = dt.date


def record(**more):
    row = dict.fromkeys(ROSTER_FEED.names)
    return row | {
        "team_unique_name": "One", "team_name": "One", "team_url": "u", "player_unique_id": "A",
        "player_id": "a", "is_captain": False, "has_invalid_dates": False,
    } | more


def feed_of(spark, rows):
    return spark.createDataFrame(
        [tuple(record(**r)[n] for n in ROSTER_FEED.names) for r in rows], ROSTER_FEED
    )


def test_read_feed_with_missing_keys(spark, tmp_path):
    lines = [
        {"team_unique_name": "One", "player_id": "é", "join_date": "2024-01-06", "is_captain": True},
        {"team_unique_name": "Two", "join_date": None, "leave_date": "2024-02-03"},
    ]
    path = tmp_path / "rosters.jsonlines"
    path.write_text("\n".join(json.dumps(line, ensure_ascii=False) for line in lines))
    found = feeds.read_feed(spark, str(path)).orderBy("team_unique_name").collect()
    assert [(r.player_id, r.join_date, r.leave_date, r.inactive_date_raw) for r in found] == [
        ("é", D(2024, 1, 6), None, None), (None, None, D(2024, 2, 3), None),
    ]


def test_broken_feed_fails(spark, tmp_path):
    path = tmp_path / "rosters.jsonlines"
    for line in ('{"team_unique_name": "One"', '{"join_date": "soon"}'):
        path.write_text(line)
        with pytest.raises(Exception, match="MALFORMED|malformed"):
            feeds.read_feed(spark, str(path)).collect()


def test_kept_tables_use_the_shared_folder(spark):
    kept = shared.keep(spark.range(3), "numbers")
    assert all(f.startswith(f"file://{shared.shared_dir(spark)}") for f in kept.inputFiles())
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert kept.count() == 3


def test_feed_round_trip_keeps_null_keys(spark, tmp_path):
    original = feed_of(spark, [{"join_date": D(2020, 1, 2)}, {"player_id": "ж"}])
    feeds.write_feed(original, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert '"leave_date_raw":null' in text and "ж" in text
    back = feeds.read_feed(spark, str(tmp_path / "out"))
    assert sorted(map(str, back.collect())) == sorted(map(str, original.collect()))


def test_tables_from_feed(spark):
    feed = feed_of(spark, [
        {"team_name": "B", "inactive_date": D(2020, 1, 1), "leave_date": D(2021, 1, 1)},
        {"team_name": "A", "team_url": "z", "full_name": "Full"},
    ])
    assert [tuple(r) for r in feeds.build_teams(feed).collect()] == [("One", "A", "z")]
    stints = feeds.build_stints(feed)
    assert stints.columns == STINTS.names
    assert {r.inactive_or_leave_date for r in stints.collect()} == {D(2020, 1, 1), None}
    feeds.check_constraints(feeds.build_teams(feed), stints)


def test_constraint_violations(spark):
    feed = feed_of(spark, [{"player_id": None}, {"team_unique_name": "Gone"}, {}])
    teams = spark.createDataFrame(
        [("One", "n", "u"), ("One", "n", None), (None, "n", "u")],
        "unique_name string, name string, wiki_url string",
    )
    found = feeds.constraint_report(teams, feeds.build_stints(feed)).collect()
    assert {r.rule: r.violations for r in found if r.violations} == {
        "teams.unique_name not null": 1, "teams.wiki_url not null": 1,
        "teams.unique_name unique": 1, "stints.nickname not null": 1, "stints.team_id known": 1,
    }
    with pytest.raises(ValueError, match="team_id known"):
        feeds.check_constraints(teams, feeds.build_stints(feed))


def test_publish_and_reload(spark, tmp_path):
    root = str(tmp_path / "snap")
    tables = snapshot.RosterTables(spark, root)
    assert snapshot.read_version(spark, root) is None
    assert snapshot.version_table(spark, root).count() == 0
    snapshot.publish(feed_of(spark, [{}] * 10), root, D(2024, 1, 1))
    assert snapshot.read_version(spark, root) == D(2024, 1, 1)
    assert [r[0] for r in snapshot.version_table(spark, root).collect()] == [D(2024, 1, 1)]
    assert tables.current()[1].count() == 10
    assert tables.version == D(2024, 1, 1)

    # the same version is not loaded again, a newer one is
    loaded = tables.current()
    assert tables.current() is loaded
    snapshot.publish(feed_of(spark, [{}] * 12), root, D(2024, 1, 2))
    assert tables.current() is not loaded
    assert tables.current()[1].count() == 12
    # frames taken before go on reading the snapshot they were taken from
    assert loaded[1].count() == 10 and loaded[0].count() == 1
    # the one before stays as a backup, older ones go
    snapshot.publish(feed_of(spark, [{}] * 13), root, D(2024, 1, 3))
    assert sorted(p.name[:19] for p in (tmp_path / "snap").glob("snapshot-*")) == [
        "snapshot-2024-01-02", "snapshot-2024-01-03",
    ]


def test_nothing_published(spark, tmp_path):
    with pytest.raises(LookupError):
        snapshot.RosterTables(spark, str(tmp_path)).current()


@pytest.mark.parametrize("rows", [0, 3])
def test_publish_rejects_empty_and_shrunk(spark, tmp_path, rows):
    root = str(tmp_path / "snap")
    snapshot.publish(feed_of(spark, [{}] * 10), root, D(2024, 1, 1))
    with pytest.raises(snapshot.PublishRejected):
        snapshot.publish(feed_of(spark, [{}] * 10).limit(rows), root, D(2024, 1, 2))
    assert snapshot.read_version(spark, root) == D(2024, 1, 1)
    assert snapshot.RosterTables(spark, root).current()[1].count() == 10
    assert len(list((tmp_path / "snap").glob("snapshot-*"))) == 1


def test_publish_accepts_ten_percent_less(spark, tmp_path):
    root = str(tmp_path / "snap")
    snapshot.publish(feed_of(spark, [{}] * 10), root, D(2024, 1, 1))
    snapshot.publish(feed_of(spark, [{}] * 9), root, D(2024, 1, 2))
    assert snapshot.RosterTables(spark, root).current()[1].count() == 9


CATEGORY = """
<html><body><a href="/outside">x</a>
<div id="mw-pages"><a href="/index.php?from=B">next <b>page</b></a>
<div class="wide mw-content-ltr"><ul><li><a href="/game/One">One<li><a href="/game/User:X">X</a>
<li><a>no target</a><li><a href="Two">Two</a></ul></div>
<a href="/index.php?from=B">next page</a></div></body></html>
"""


def page_table(spark, *pages_):
    rows = [(i, url, html) for i, (url, html) in enumerate(pages_)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_category_links(spark):
    table = page_table(spark, ("https://w.example/game/Category:Teams", CATEGORY), ("u", "<a href=x>"))
    found = pages.page_links(table).collect()
    assert sorted((r.page_id, r.kind, r.link) for r in found) == [
        (0, "next", "https://w.example/index.php?from=B"),
        (0, "team", "https://w.example/game/One"),
        (0, "team", "https://w.example/game/Two"),
    ]
    every = pages.page_links(table, category=False)
    assert every.count() == 6


def player_row(nick="a", extra="", dates=(), href="/game/Nick_A"):
    cells = "".join(
        f'<td class="Date"><div class="MobileStuffDate">{k}</div><i>{v}</i></td>' for k, v in dates
    )
    return (
        f'<tr class="Player"><td class="ID"><span class="flag"><img title="Land"></span>'
        f'<a href="{href}"> {nick} </a>{extra}</td><td class="Name"><div class="LargeStuff"> Full '
        f'&eacute; </div></td><td class="Position"><i></i></td>{cells}</tr>'
    )


TEAM = """
<html><head><base href="https://w.example/game/"></head><body>
<h1 id="firstHeading"><span>Team &amp; Co</span></h1>
<div class="infobox"><div><div class="infobox-description">Games:</div><div>{games}</div></div></div>
<h2><span id="History">History</span></h2>
<div class="roster-card"><table>{ignored}</table></div>
<h2><span id="Player_Roster">Player Roster</span></h2>
<p>text</p>
<div><ul class="nav-tabs"><li class="tab1 active"><a>CS<b>2</b></a></li><li class="tab2">Other</li>
<li class="tab1">CS:GO</li></ul>
<div class="content1"><table class="roster-card">{first}</table></div>
<div class="content2"><table class="roster-card">{second}</table></div></div>
<h2><span>Untitled</span></h2>
<div><div class="plain"><table class="roster-card wide">{third}</table></div></div>
<h2><span id="Organization">Organization</span></h2>
<div><table class="roster-card">{ignored}</table></div>
</body></html>
"""


def team_page(games="<a>CS</a>", **rows):
    parts = {"first": "", "second": "", "third": "", "ignored": player_row("ignored")} | rows
    return TEAM.format(games=games, **parts)


def extract(spark, html, url="https://w.example/game/Team_%26_Co"):
    return pages.extract_feed(page_table(spark, (url, html))).collect()


def test_roster_extraction(spark):
    html = team_page(
        first=player_row(
            "a", '<i title="Captain"></i>',
            [("Join Date:", "2020-01-02"), ("Leave Date:", "<abbr>2021-??-??</abbr>")],
        ),
        second=player_row("b", href=""),
        third=player_row(
            "c", dates=[("Join Date:", "2020-02-03 [1]")],
            href="/index.php?title=Nick_C%5E&amp;action=edit&amp;redlink=1",
        ),
    )
    first, second, third = sorted(extract(spark, html), key=lambda r: r.player_id)
    assert first.asDict() == {
        "team_unique_name": "Team & Co", "team_name": "Team & Co",
        "team_url": "https://w.example/game/Team_%26_Co", "player_unique_id": "Nick A",
        "game_version": "CS2", "player_id": "a", "full_name": "Full é",
        "player_url": "https://w.example/game/Nick_A", "is_captain": True, "position": None,
        "flag_name": "Land", "join_date": D(2020, 1, 2), "inactive_date": None,
        "leave_date": D(2021, 12, 31), "join_date_raw": None, "inactive_date_raw": None,
        "leave_date_raw": "2021-??-??", "has_invalid_dates": True,
    }
    # no link: the nickname is the id; a tab that names no game gives no version
    assert (second.player_unique_id, second.player_url, second.game_version) == ("b", None, None)
    assert second.has_invalid_dates
    # outside tabs the infobox decides
    assert (third.player_unique_id, third.game_version) == ("Nick C^", "CS")
    assert third.join_date == D(2020, 2, 3) and not third.has_invalid_dates


def test_two_games_in_the_infobox(spark):
    (row,) = extract(spark, team_page("<a>CS</a><a>CS2</a>", third=player_row()))
    assert row.game_version is None


def test_pages_without_a_roster(spark):
    assert extract(spark, "<html><body><div class='roster-card'>x</div></body></html>") == []
    assert extract(spark, '<div><h2><span id="Player_Roster">x</span></h2></div>') == []


def test_extracted_columns(spark):
    assert pages.extract_feed(page_table(spark, ("u", "x"))).columns == ROSTER_FEED.names


def test_refresh(spark, tmp_path):
    table = page_table(spark, ("https://w.example/game/Team", team_page(first=player_row())))
    refresh(table, str(tmp_path), D(2024, 5, 6))
    teams, stints = snapshot.RosterTables(spark, str(tmp_path)).current()
    assert [r.unique_name for r in teams.collect()] == ["Team"]
    assert [r.player_uid for r in stints.collect()] == ["Nick A"]


def test_element_tree():
    page = parse("<ul><li class='a b'>x<li>y<p>z</ul><br/><b>t&amp;u</b>")
    items = select(page, lambda e: e.tag == "ul", lambda e: e.tag == "li")
    assert [("".join(e.all_texts()), list(e.classes)) for e in items] == [("x", ["a", "b"]), ("yz", [])]
    assert [e.own_texts() for e in select(page, lambda e: e.tag == "b")] == [["t&u"]]


def test_links_in_upper_case(spark):
    table = page_table(spark, ("https://w.example/a", "<A HREF='/x'>x</A>"))
    assert [r.link for r in pages.page_links(table, category=False).collect()] == [
        "https://w.example/x"
    ]


def test_publish_rejects_broken_constraints(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(snapshot.PublishRejected, match="nickname"):
        snapshot.publish(feed_of(spark, [{"player_id": None}] * 3), root, D(2024, 1, 1))
    assert snapshot.read_version(spark, root) is None


def test_damaged_version_raises(spark, tmp_path):
    (tmp_path / "commits").mkdir()
    (tmp_path / "commits" / "000000000001").write_text("soon")
    with pytest.raises(ValueError, match="no date"):
        snapshot.read_version(spark, str(tmp_path))


def test_readers_never_see_half_a_commit(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    snapshot.publish(feed_of(spark, [{}] * 10), root, D(2024, 1, 1))
    seen = []
    put = snapshot._Folder.put

    def look() -> None:
        tables = snapshot.RosterTables(spark, root)
        seen.append((tables.current()[1].count(), tables.version))

    def watched(self, name, text, replace):
        look()
        done = put(self, name, text, replace)
        look()
        return done

    monkeypatch.setattr(snapshot._Folder, "put", watched)
    snapshot.publish(feed_of(spark, [{}] * 12), root, D(2024, 1, 2))
    assert seen == [
        (10, D(2024, 1, 1)), (12, D(2024, 1, 2)), (12, D(2024, 1, 2)), (12, D(2024, 1, 2)),
    ]
    assert (tmp_path / "updated.txt").read_text() == "2024-01-02\n"
    assert not list(tmp_path.rglob("*.tmp"))
    # a file that is being written has no number yet
    (tmp_path / "commits" / "000000000003.abc.tmp").write_text("2024-")
    look()
    assert seen[-1] == (12, D(2024, 1, 2))


def test_one_of_two_publishers_is_rejected(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    snapshot.publish(feed_of(spark, [{}] * 10), root, D(2024, 1, 1))
    write, turns = snapshot._write_tables, []

    def other_first(feed, path):
        write(feed, path)
        if not turns:
            turns.append(path)
            snapshot.publish(feed_of(spark, [{}] * 11), root, D(2024, 1, 3))

    monkeypatch.setattr(snapshot, "_write_tables", other_first)
    with pytest.raises(snapshot.PublishConflict):
        snapshot.publish(feed_of(spark, [{}] * 15), root, D(2024, 1, 2))
    assert snapshot.latest(spark, root)[:2] == (2, D(2024, 1, 3))
    assert snapshot.RosterTables(spark, root).current()[1].count() == 11
    assert not list(tmp_path.glob("snapshot-2024-01-02*")) and not list(tmp_path.rglob("*.tmp"))


def test_older_version_is_not_loaded(spark, tmp_path):
    root = str(tmp_path)
    tables = snapshot.RosterTables(spark, root)
    snapshot.publish(feed_of(spark, [{}] * 10), root, D(2024, 1, 2))
    loaded = tables.current()
    snapshot.publish(feed_of(spark, [{}] * 11), root, D(2024, 1, 1))
    assert tables.current() is loaded and tables.version == D(2024, 1, 2)


def test_publish_computes_the_feed_once(spark, tmp_path):
    computed = spark.sparkContext.accumulator(0)

    def counted(rows):
        for batch in rows:
            computed.add(batch.num_rows)
            yield batch

    feed = feed_of(spark, [{}] * 40)
    feed = feed.repartition(4).mapInArrow(counted, feed.schema)
    snapshot.publish(feed, str(tmp_path), D(2024, 1, 1))
    assert computed.value == 40
    folder = next(tmp_path.glob("snapshot-*"))
    back = feeds.read_feed(spark, str(folder / "feed"))
    assert back.columns == ROSTER_FEED.names and back.count() == 40


def test_all_broken_rules_are_named(spark, tmp_path):
    rows = [{"player_id": None, "team_url": None}, {"team_unique_name": None}, {}]
    with pytest.raises(snapshot.PublishRejected) as error:
        snapshot.publish(feed_of(spark, rows), str(tmp_path), D(2024, 1, 1))
    assert "stints.nickname not null: 1" in str(error.value)
    assert "teams.unique_name not null: 1" in str(error.value)


def shown(spark, root) -> list:
    stints = snapshot.RosterTables(spark, root).current()[1]
    return sorted(map(repr, stints.drop("join_date").collect()))


def test_refresh_parses_changed_pages_only(spark, tmp_path):
    def table(*pages_):
        return page_table(spark, *[(f"https://w.example/game/{u}", h) for u, h in pages_])

    one, two, three = (team_page(first=player_row(nick)) for nick in ("A", "B", "C"))
    empty = "<html><body>no roster</body></html>"
    root = str(tmp_path / "steps")
    steps = [
        (table(("T1", one), ("T2", two), ("T3", empty)), 3, 3),
        # the same again, in another order and with other ids
        (table(("T3", empty), ("T2", two), ("T1", one)), 3, 0),
        # one changed, one new, one gone, one twice
        (table(("T1", one), ("T1", one), ("T2", three), ("T4", two)), 3, 2),
        (table(("T2", three), ("T4", two), ("T1", one), ("T1", one), ("T5", None)), 3, 0),
    ]
    for k, (pages_, contents, parsed) in enumerate(steps):
        day = D(2024, 1, 1 + k)
        done = refresh_incremental(pages_, root, day)
        assert (done.contents, done.parsed) == (contents, parsed)
        whole = str(tmp_path / f"whole{k}")
        refresh(pages_, whole, day)
        assert shown(spark, root) == shown(spark, whole)


def test_refresh_after_a_snapshot_without_contents(spark, tmp_path):
    table = page_table(spark, ("https://w.example/game/Team", team_page(first=player_row())))
    refresh(table, str(tmp_path), D(2024, 5, 6))
    done = refresh_incremental(table, str(tmp_path), D(2024, 5, 7))
    assert done.parsed == 1 and done.commit.number == 2


def test_window_reads_few_row_groups(spark, tmp_path):
    """Stints lie by team and join date, so a team's rows are in few files and row groups."""
    rows = [
        {"team_unique_name": f"t{i % 40:02}", "team_name": f"t{i % 40:02}",
         "join_date": D(2020, 1, 1) + dt.timedelta(days=i // 40)}
        for i in range(8000)
    ]
    root = str(tmp_path)
    snapshot.publish(feed_of(spark, rows).repartition(8), root, D(2024, 1, 1))
    folder = next(tmp_path.glob("snapshot-*"))
    held = [
        path.name
        for path in (folder / "stints").glob("*.parquet")
        if "t07" in set(pq.read_table(path, columns=["team_id"]).column(0).to_pylist())
    ]
    assert len(held) == 1
    for path in (folder / "stints").glob("*.parquet"):
        found = pq.read_table(path, columns=["team_id", "join_date"]).to_pylist()
        order = [(r["team_id"], r["join_date"]) for r in found]
        assert order == sorted(order)
    _, stints = snapshot.RosterTables(spark, root).current()
    window = stints.filter((F.col("team_id") == "t07") & (F.col("join_date") < D(2020, 2, 1)))
    assert window.count() == 31
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(team_id,t07)" in plan


def _lines(path):
    return sorted(
        line for p in path.glob("part-*.gz") for line in gzip.decompress(p.read_bytes()).splitlines()
    )


def test_feed_of_a_snapshot_is_compressed_and_sized_before(spark, tmp_path):
    rows = [{"player_id": f"é{i}", "join_date": D(2024, 1, 6)} for i in range(40)] + [{}]
    commit = snapshot.publish(feed_of(spark, rows), str(tmp_path), D(2024, 1, 1))
    feeds.write_feed(feed_of(spark, rows), str(tmp_path / "plain"))
    plain = b"".join(p.read_bytes() for p in (tmp_path / "plain").glob("part-*"))
    assert _lines(tmp_path / commit.folder / "feed") == sorted(plain.splitlines())
    noted = spark.read.text(f"{tmp_path}/{commit.folder}/feed_size").collect()
    assert [int(r.value) for r in noted] == [len(plain)]
    stored = sum(p.stat().st_size for p in (tmp_path / commit.folder / "feed").glob("part-*"))
    assert stored < len(plain) / 4


def test_size_of_a_feed_without_one_is_that_of_its_files(spark, tmp_path):
    """Snapshots from before compression have plain files, whose size is not noted."""
    root = str(tmp_path)
    feeds.write_feed(feed_of(spark, [{}] * 10), f"{root}/old/feed")
    (tmp_path / "commits").mkdir()
    (tmp_path / "commits" / f"{1:012d}").write_text("2024-01-01\nold\n")
    with pytest.raises(snapshot.PublishRejected, match="smaller"):
        snapshot.publish(feed_of(spark, [{}] * 8), root, D(2024, 1, 2))
    snapshot.publish(feed_of(spark, [{}] * 9), root, D(2024, 1, 2))
    with pytest.raises(snapshot.PublishRejected, match="smaller"):
        snapshot.publish(feed_of(spark, [{}] * 8), root, D(2024, 1, 3))


def test_compressed_feed_takes_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "RECORDS_PER_FILE", 3)
    feeds.write_feed(feed_of(spark, [{}] * 10).coalesce(1), str(tmp_path / "f"), compression="gzip")
    assert len(list((tmp_path / "f").glob("part-*.gz"))) == 4
    assert feeds.read_feed(spark, str(tmp_path / "f")).count() == 10


def _shape(element):
    return (element.tag, element.attrs, list(element.classes), element.begin, element.end,
            [c if isinstance(c, str) else _shape(c) for c in element.children])


def _parsed(text):
    parser = html._Parser()
    parser.feed(text)
    parser.close()
    return parser.tree.closed()


MARKS = [
    "<td>", "</td>", "<TR Class='a b'>", '<tr class="a b a">', "</tr>", "<br/>", "<br />", "<li>", "x",
    " &amp; ", "&lt", "&copy=1", '<a HREF="/i?a=1&amp;b=2">', '<a href="?a&copy=2">', "<a href=x>",
    "</a>", "</a >", "<", ">", "<!-- <td> -->", "<p>", '<i title="a>b">', '<i title="">', "<i a>",
    '<i id="n" id="m">', "<script>", "</script>", "<title>", "</p>", "é\n", '<a b="1"c="2">', "\0", "<1>",
    '<div id="n">', "</div>", '<img src="s">', "&", "<?x>", "</>", '<x-y z="1">', '<h1 id = "q">', "<td",
]


def test_plain_pages_have_the_tree_of_the_parser():
    rng = random.Random(5)
    plain = 0
    for _ in range(4000):
        some = rng.sample(MARKS, 6) if rng.random() < 0.5 else MARKS[:4:2] + MARKS[3:6]
        text = "".join(rng.choice(some) for _ in range(rng.randrange(12)))
        plain += html._plain_tree(text) is not None
        assert _shape(parse(text)) == _shape(_parsed(text)), text
    assert plain > 500


def test_select_looks_up_what_a_scan_finds():
    rng = random.Random(6)
    tests = {
        Has("tag", "td"): lambda e: e.tag == "td",
        Has("id", "n"): lambda e: e.attrs.get("id") == "n",
        Has("class", "a"): lambda e: "a" in e.classes,
        Has("class", "b", "tr"): lambda e: "b" in e.classes and e.tag == "tr",
        Has("tag", "div"): lambda e: e.tag == "div",
    }
    for _ in range(500):
        page = parse("".join(rng.choice(MARKS) for _ in range(20)))
        scope, path = rng.choice(page.page), rng.choices(list(tests), k=rng.randrange(1, 4))
        assert select(scope, *path) == select(scope, *[tests[t] for t in path])


def test_plain_pages_are_not_given_to_the_parser(spark, monkeypatch):
    """The HTML parser took most of the time of an extraction."""
    from stintbook import demo

    monkeypatch.setattr(html, "_Parser", None)
    for made in (demo.roster_pages, demo.team_pages, demo.category_pages):
        assert all(parse(r.html).page for r in made(spark, "/root/testdata/sf0.001").limit(50).collect())


def test_pages_are_spread_before_parsing(spark):
    from stintbook import demo

    for made in (demo.category_pages, demo.roster_pages):
        assert made(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 8


def _random_roster(rng):
    """A page with parts of a roster in any order and depth, sometimes written in an odd way."""
    texts = ["x", " y ", "", "Games: z", "CS2", "2020-01-02", "&amp;", "é　", "a > b", "\x1f", "&#1;"]
    classes = ["roster-card", "Player", "ID", "flag", "Name", "LargeStuff", "Position", "Date",
               "MobileStuffDate", "nav-tabs", "infobox-description", "content1", "content22 tab-x",
               "tab1", "tab2 active", "Player roster-card", "ID Date", "wide"]
    tags = ["div", "div", "h2", "td", "tr", "li", "a", "a", "i", "i", "abbr", "span", "img", "b", "br"]
    hrefs = ["/wiki/A", "b/../c", "", " /x ", "//h/x", "/a//b", "/w?title=T&amp;action=edit", "?q", "/é", "/a/.", "#"]

    if rng.random() < 0.7:  # nothing that is left to the tree
        classes = [c for c in classes if not c.startswith(("content", "Player", "roster"))]
        tags = [t for t in tags if t not in ("td", "tr", "li")]
        ids = ["firstHeading", "Organization"]
    else:
        ids = ["firstHeading", "Player_Roster", "Organization"]

    def element(depth):
        tag, attrs = rng.choice(tags), ""
        if rng.random() < 0.6:
            attrs += f' class="{rng.choice(classes)}"'
        if rng.random() < 0.08:
            attrs += f' id="{rng.choice(ids)}"'
        if tag in ("a", "div") and rng.random() < 0.7:
            attrs += f' href="{rng.choice(hrefs)}"'
        if tag in ("i", "img") and rng.random() < 0.7:
            attrs += f' title="{rng.choice(["Captain", "Land", ""])}"'
        if tag in ("img", "br"):
            return f"<{tag}{attrs}>"
        inside = "".join(
            element(depth + 1) if depth < 5 and rng.random() < 0.6 else rng.choice(texts)
            for _ in range(rng.randrange(4))
        )
        odd = rng.random()
        tag = tag.upper() if odd < 0.05 else tag
        return f"<{tag}{attrs}>{inside}" + ("" if odd > 0.999 else f"</{tag}>")

    def row():
        cells = [
            f'<td class="ID"><span class="flag"><img title="{rng.choice(["L", "M &amp; N"])}"></span>'
            f'<a href="{rng.choice(hrefs)}">{rng.choice(texts)}</a>{element(4)}</td>',
            f'<td class="Name"><div class="LargeStuff">{rng.choice(texts)}{element(4)}</div></td>',
            f'<td class="Position"><i>{rng.choice(texts)}</i></td>',
            f'<td class="Date"><div class="MobileStuffDate">Join Date:</div><i>{rng.choice(texts)}'
            f"<abbr>{rng.choice(texts)}</abbr></i>{element(4)}</td>",
        ]
        rng.shuffle(cells)
        return f'<tr class="Player">{"".join(cells[: rng.randrange(5)])}</tr>'

    def card():
        inside = "".join(row() for _ in range(rng.randrange(4)))
        held = f'<table class="roster-card">{inside}</table>{element(3)}'
        return f'<div class="content{rng.randrange(3)}">{held}</div>' if rng.random() < 0.6 else held

    tabs = '<ul class="nav-tabs"><li class="tab1">CS <b>2</b></li><li class="tab1">CS</li><li class="tab2"> CS:GO</li></ul>'
    parts = [f"<div>{tabs if rng.random() < 0.7 else ''}{card()}{card()}</div>" for _ in range(2)]
    end = rng.choice(["", '<h2><span id="Organization">S</span></h2>', '<div id="Organization"></div>'])
    page = (
        f'{rng.choice(texts)}<h1 id="firstHeading">{element(4)}<span>{rng.choice(texts)}</span></h1>'
        f'<div><div class="infobox-description">{rng.choice(texts)}</div><div><a>CS</a>{element(4)}</div></div>'
        f'<h3><span id="Player_Roster">P</span></h3>{parts[0]}{element(2)}{end}{parts[1]}{rng.choice(texts)}'
    )
    page = f"<body><main>{page}</main></body>" if rng.random() < 0.5 else page
    odd = rng.random()
    if odd < 0.1:
        place = rng.randrange(len(page))
        page = page[:place] + rng.choice(["<", ">", "\0", "<!-- c -->", "</div>", "<b", '"']) + page[place:]
    return page if odd < 0.97 else rng.choice(["", "text", "<p>", "b>", "<"])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pages_read_together_have_the_rows_of_the_tree(seed, monkeypatch):
    rng = random.Random(seed)
    urls = ["https://w.example/game/T", "HTTP://W.example", "https://w.example/a?b=/c", "x", None, ""]
    found = [(i, rng.choice(urls), _random_roster(rng)) for i in range(1_500)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.string(), pa.string()))],
        ["page_id", "url", "html"],
    )
    schema = pages._ROWS_ARROW
    expected = pages._page_job(pages._roster_rows, schema)(iter([batch]))
    expected = [row for part in expected for row in part.to_pylist()]
    monkeypatch.setattr(rosters, "_BYTES_AT_ONCE", 200_000)
    monkeypatch.setattr(rosters, "_MOST_SEEN", 100)
    given = pages._roster_job(schema)(iter([batch.slice(0, 700), batch.slice(700)]))
    rows = [row for part in given for row in part.to_pylist()]
    assert len(rows) > 1_000
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))
    parts = rosters.slices(batch)
    left = sum(len(rosters.roster_columns(p, schema)[1]) for p in parts)
    assert len(parts) > 3 and left < 0.75 * len(found)


def test_plain_rosters_are_read_together():
    html = team_page(first=player_row("a") * 3, third=player_row("c", dates=[("Join Date:", "x")]))
    html = html.replace('<base href="https://w.example/game/">', "")
    given = [{"page_id": 1, "url": "https://w.example/game/T", "html": h} for h in (html, html + "<b>")]
    (batch,) = pa.Table.from_pylist(given).to_batches()
    rows, left = rosters.roster_columns(batch, pages._ROWS_ARROW)
    assert rows.num_rows == 4 and left.tolist() == [1]


def test_pages_of_a_refresh_are_read_together(monkeypatch):
    """There the id of a page is its digest."""
    html = team_page(first=player_row("a"), third=player_row("b"))
    html = html.replace('<base href="https://w.example/game/">', "")
    given = [{"page_id": d, "url": "https://w.example/game/T", "html": html} for d in ("d1", "d2")]
    schema = pages._ROWS_ARROW.set(0, pa.field("page_id", pa.string()))
    expected = pages._page_job(pages._roster_rows, schema)(iter(pa.Table.from_pylist(given).to_batches()))
    expected = [row for part in expected for row in part.to_pylist()]

    def refuse(_):
        raise AssertionError("read page by page")

    monkeypatch.setattr(pages, "parse", refuse)
    found = pages._roster_job(schema)(iter(pa.Table.from_pylist(given).to_batches()))
    assert [row for part in found for row in part.to_pylist()] == expected
    assert [row["page_id"] for row in expected] == ["d1", "d1", "d2", "d2"]
