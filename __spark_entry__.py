"""

Every query reads whole tables. Dates leave as ISO text, so that they compare as text.
"""

from __future__ import annotations

import datetime as dt
import functools
import os
import sys
import warnings
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

import oracles  # noqa: E402
from stintbook import demo  # noqa: E402
from stintbook.demo import AS_OF  # noqa: E402
from stintbook.functions import dates, labels, predicates, text  # noqa: E402
from stintbook.operators import changes, lineups, lookups, merging, overlap, rankings, teammates  # noqa: E402
from stintbook.plans import main_report, player_page, refresh, team_page  # noqa: E402
from stintbook.schema import RECORD  # noqa: E402
from stintbook.sources import feed, pages, shared, snapshot  # noqa: E402

# The operators on training text are an optional part: a folder and a file at the top.
try:
    from stintbook.llm import queries as llm
except ImportError as missing:
    # Without the folder it is left out silently; a library it lacks is named.
    if missing.name not in {"stintbook.llm", "corpus_pipeline"}:
        warnings.warn(f"the operators on training text are left out: {missing}", stacklevel=1)
    llm = None

Query = Callable[[SparkSession, str], DataFrame]

# Before the first order date: the window that leaves nothing out.
ALL_FROM = dt.date(1990, 1, 1)
# A window inside the data.
SOME_FROM, SOME_TO = dt.date(1997, 1, 1), dt.date(1998, 12, 31)


def _iso(df: DataFrame) -> DataFrame:
    days = {f.name for f in df.schema if isinstance(f.dataType, T.DateType)}
    return df.select(
        *[F.col(c).cast("string").alias(c) if c in days else F.col(c) for c in df.columns]
    )


def _busiest(stints: DataFrame) -> DataFrame:
    """The players the main report links to under "most teams"."""
    return rankings.most_teams(stints, 10).select("player_uid")


def _on_stints(query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: _iso(query(demo.stints(spark, sf_dir)))


def _segments(stints: DataFrame) -> DataFrame:
    inside = lineups.team_window(stints, ALL_FROM, None, AS_OF)
    return lineups.lineup_segments(lineups.dated_records(inside))


def _shown(stints: DataFrame) -> DataFrame:
    inside = lineups.team_window(stints, SOME_FROM, SOME_TO, AS_OF)
    segments = lineups.lineup_segments(lineups.dated_records(inside))
    return lineups.shown_segments(segments, SOME_FROM, SOME_TO, AS_OF)


def _members(stints: DataFrame) -> DataFrame:
    inside = lineups.team_window(stints, ALL_FROM, None, AS_OF)
    records = lineups.dated_records(inside)
    shown = lineups.shown_segments(lineups.lineup_segments(records), ALL_FROM, None, AS_OF)
    return lineups.lineup_members(records, shown).select(
        "team_id", "segment_no", "player_uid", "position"
    )


def _lineup_versions(stints: DataFrame) -> DataFrame:
    return _segments(stints).groupBy("game_version").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("members").alias("members")
    )


def _lineup_pages(stints: DataFrame) -> DataFrame:
    """Pages of all teams in one window."""
    return team_page.team_lineups(stints, AS_OF, SOME_FROM, SOME_TO, "nick1")


def _label_days(stints: DataFrame) -> DataFrame:
    days = F.datediff("end", "start").cast("long")
    return overlap.clean_spans(stints, AS_OF).select(
        "player_uid",
        "team_id",
        "start",
        days.alias("days"),
        labels.days_text(days).alias("shown"),
        labels.days_tooltip(days).alias("tooltip"),
    )


def _label_dates(stints: DataFrame) -> DataFrame:
    start, end = predicates.period_start(), predicates.period_end()
    return stints.select(
        "player_uid",
        "team_id",
        labels.date_text(F.col("join_date"), AS_OF).alias("joined"),
        labels.date_text(F.col("inactive_date"), AS_OF).alias("inactive"),
        labels.date_text(F.col("leave_date"), AS_OF).alias("left"),
        labels.period_text(start, end, AS_OF).alias("period"),
    )


def _label_position(stints: DataFrame) -> DataFrame:
    label = labels.position_text(F.col("is_captain"), F.col("position"))
    return stints.groupBy("is_captain", "position", label.alias("label")).agg(
        F.count(F.lit(1)).alias("stints")
    )


def _label_version(stints: DataFrame) -> DataFrame:
    label = labels.version_text(F.col("game_version"))
    return stints.groupBy("game_version", label.alias("label")).agg(
        F.count(F.lit(1)).alias("stints")
    )


def _label_country(stints: DataFrame) -> DataFrame:
    flag = F.col("flag_name")
    return stints.groupBy(
        labels.country_text(flag).alias("country"), text.flag_path(flag).alias("flag_url")
    ).agg(F.count(F.lit(1)).alias("stints"))


def _slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = text.slugify(F.col("text"))
    return demo.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(slug).alias("slug_md5"),
        F.md5(text.unslugify(slug)).alias("back_md5"),
        F.md5(text.clean_id(slug)).alias("id_md5"),
    )


def _links(stints: DataFrame) -> DataFrame:
    return stints.select(
        text.player_link(F.col("player_uid")).alias("player"),
        text.team_link(F.col("team_id")).alias("team"),
        text.team_link(
            F.col("team_id"), F.col("join_date"), predicates.stored_end(), F.col("nickname")
        ).alias("team_filtered"),
    )


def _date_repair(spark: SparkSession, sf_dir: str, month_end: bool = False) -> DataFrame:
    date = dates.parsed_date(F.col("kind"), F.col("text"), month_end)
    return _iso(demo.date_cells(spark, sf_dir).withColumn("date", date))


def _raw_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.date_cells(spark, sf_dir).withColumn(
        "raw", dates.raw_date(F.col("kind"), F.col("text"))
    )


def _validity(stints: DataFrame) -> DataFrame:
    rules = {
        "valid": predicates.has_valid_dates(),
        "clean": predicates.is_clean(),
        "staying": predicates.not_left(),
        "ongoing": predicates.is_ongoing(),
        "invalid_flag": F.col("has_invalid_dates"),
    }
    return stints.groupBy("team_id").agg(
        *[F.count_if(rule).alias(name) for name, rule in rules.items()]
    )


def _constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = demo.feed(spark, sf_dir)
    return feed.constraint_report(feed.build_teams(records), feed.build_stints(records))


def _teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.build_teams(demo.feed(spark, sf_dir))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = demo.feed(spark, sf_dir)
    return lookups.entity_index(feed.build_teams(records), feed.build_stints(records))


def _routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).select(
        "item", text.resolve_query(F.col("item")).alias("path")
    )


def _page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_links(demo.table(spark, sf_dir, "pages"), category=False)


def _extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _iso(pages.extract_feed(demo.roster_pages(spark, sf_dir)))


def _team_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _iso(pages.extract_feed(demo.team_pages(spark, sf_dir)))


def _category_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_links(demo.category_pages(spark, sf_dir))


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.constraint_report(
        demo.broken_teams(spark, sf_dir), demo.broken_stints(spark, sf_dir)
    )


def _feed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.fresh_path(spark, "feed")
    feed.write_feed(demo.feed(spark, sf_dir), path, compression="gzip")
    return _iso(feed.read_feed(spark, path))


def _published(spark: SparkSession, sf_dir: str) -> str:
    """Two versions of the stays; the first one lacks some teams."""
    root = shared.fresh_path(spark, "snapshots")
    # kept, because each publication reads it
    records = shared.keep(demo.feed(spark, sf_dir), "records")
    fewer = records.filter(~F.col("team_unique_name").endswith("00"))
    snapshot.publish(fewer, root, SOME_FROM)
    snapshot.publish(records, root, SOME_TO)
    return root


def _snapshot_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = snapshot.RosterTables(spark, _published(spark, sf_dir))
    teams, stints = tables.current()
    named = teams.select(F.col("unique_name").alias("team_id"), "name", "wiki_url")
    return _iso(stints.join(named, "team_id"))


def _snapshot_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _iso(snapshot.version_table(spark, _published(spark, sf_dir)))


def _listed_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The teams the main report links to under "most players"."""
    records = demo.feed(spark, sf_dir)
    listed = rankings.teams_with_most_players(feed.build_stints(records), 10)
    return lookups.teams_of(feed.build_teams(records), listed)


def _player_page_order(stints: DataFrame) -> DataFrame:
    listed = player_page.player_teams(lookups.stints_of(stints, _busiest(stints)), AS_OF)
    placed = player_page.numbered(listed, "player_uid", player_page.reading_order_of_teams())
    return placed.select("player_uid", "place", "period_start", "team_id")


def _teammate_page_order(stints: DataFrame) -> DataFrame:
    mates = player_page.player_teammates(stints, _busiest(stints), AS_OF)
    placed = player_page.numbered(mates, "of_player", player_page.reading_order_of_mates())
    return placed.select(
        "of_player", "place", "player_uid", "total_days", "overlap_start", "team_id"
    )


def _reload_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader has loaded after each of three publications, the second of an older version."""
    root = shared.fresh_path(spark, "snapshots")
    # kept, because each publication reads it
    records = shared.keep(demo.feed(spark, sf_dir), "records")
    older = records.filter(~F.col("team_unique_name").endswith("00"))
    tables = snapshot.RosterTables(spark, root)
    steps = []
    for step, (feed_, version) in enumerate(
        [(older, SOME_TO), (records, SOME_FROM), (records, AS_OF)], 1
    ):
        held = tables.version
        snapshot.publish(feed_, root, version)
        teams, stints = tables.current()
        counted = stints.agg(F.count(F.lit(1)).alias("stints")).join(
            teams.agg(F.count(F.lit(1)).alias("teams"))
        )
        # a kept table, because the snapshot goes when it is no backup any more
        steps.append(
            shared.keep(
                counted.select(
                    F.lit(step).alias("step"),
                    F.lit(tables.version.isoformat()).alias("version"),
                    F.lit(tables.version != held).alias("loaded"),
                    "stints",
                    "teams",
                ),
                "step",
            )
        )
    return functools.reduce(DataFrame.unionByName, steps)


def _refresh_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed after a second refresh, and how many pages that one parsed.

    In the first one a tenth of the pages is missing, and another tenth says something else.
    """
    root = shared.fresh_path(spark, "snapshots")
    # kept, because the order of a page's rows is not fixed
    now = shared.keep(demo.team_pages(spark, sf_dir), "team-pages")
    kind = F.col("page_id") % 10
    other = F.when(kind == 4, F.replace("html", F.lit("Full "), F.lit("Fuller "))).otherwise(F.col("html"))
    refresh.refresh_incremental(now.filter(kind != 3).withColumn("html", other), root, SOME_FROM)
    done = refresh.refresh_incremental(now, root, SOME_TO)
    records = feed.read_feed(spark, f"{root}/{done.commit.folder}/feed")
    return _iso(records.withColumn("parsed_pages", F.lit(done.parsed).cast("bigint")))


def _stints_before(stints: DataFrame) -> DataFrame:
    """An earlier state: teams that end in 00 are not there yet, those in 3 lack their captains,
    and those in 7 have some other nicknames."""
    team = F.col("team_id")
    nickname = F.when(
        team.endswith("7") & (F.col("position") == "(Coach)"), F.lit("old")
    ).otherwise(F.col("nickname"))
    return stints.filter(
        ~team.endswith("00") & ~(team.endswith("3") & F.col("is_captain"))
    ).withColumn("nickname", nickname)


def _lineup_update(stints: DataFrame) -> DataFrame:
    """Line-ups brought up to date from those of an earlier state, and which were made anew."""
    now = shared.keep(stints, "stints")
    # not kept: made of one row each of what is kept, while that is read
    before = _stints_before(now)
    old = shared.keep(_segments(before).withColumn("made_anew", F.lit(False)), "lineups-before")
    changed = shared.keep(changes.changed_teams(before, now), "changed")
    return changes.bring_up_to_date(
        old, changed, now, lambda s: _segments(s).withColumn("made_anew", F.lit(True))
    )


def _lineup_nested(stints: DataFrame) -> DataFrame:
    """Nested line-ups in one window, with their players in a text, in the order of the array."""
    order = [c for c in RECORD if c not in ("team_id", "full_name", "player_url")]
    nested = team_page.nested_lineups(
        stints, AS_OF, SOME_FROM, SOME_TO, "nick1", entry_order=order, most_members=3
    )
    said = F.transform(
        "players", lambda p: F.concat_ws(":", p.nickname, p.player_uid, p.position, p.join_date)
    )
    return nested.select(
        "team_id", "lineup_no", "part", "period", "game_version",
        F.size("players").cast("bigint").alias("members"),
        F.array_join(said, ";").alias("players"),
    )


def _team_window_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window read from a published snapshot, where stints lie by team and join date."""
    root = shared.fresh_path(spark, "snapshots")
    snapshot.publish(demo.feed(spark, sf_dir), root, SOME_TO)
    _, stints = snapshot.RosterTables(spark, root).current()
    return _iso(lineups.team_window(stints, SOME_FROM, SOME_TO, AS_OF).select(*RECORD))


def _team_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of the listed teams, with a window that starts late, and without one."""
    records = demo.feed(spark, sf_dir)
    stints, teams = feed.build_stints(records), feed.build_teams(records)
    late = dt.date(1998, 10, 1)
    windows = [(None, None), (late, None), (SOME_FROM, SOME_TO)]
    parts = [
        team_page.team_headers(teams, stints, AS_OF, *w).withColumn("window_no", F.lit(i))
        for i, w in enumerate(windows)
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def _dates_shown(stints: DataFrame) -> DataFrame:
    shown = team_page.shown_dates(stints, AS_OF)
    flat = [
        F.col(f"{d}.{part}").alias(f"{d}_{part}")
        for d in ("join_date", "inactive_date", "leave_date")
        for part in ("display", "original")
    ]
    return shown.select("player_uid", "team_id", *flat)


def _version_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before anything is published, and after."""
    before = snapshot.version_shown(spark, shared.fresh_path(spark, "snapshots"))
    return before.unionByName(snapshot.version_shown(spark, _published(spark, sf_dir)))


def _player_days(stints: DataFrame, merge: str) -> DataFrame:
    spans = overlap.clean_spans(stints, AS_OF)
    return merging.covered_days(spans, ["player_uid"], merge)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the main report with its six ranked tables."""
    return queries()["main_report"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    found = _own_queries() | (llm.queries() if llm else {})
    return {name: _shipped(query) for name, query in found.items()}


def _shipped(query: Query) -> Query:
    """Workers may run where this repository is not on their path."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shared.ship(spark)
        return query(spark, sf_dir)

    return run


def _own_queries() -> dict[str, Query]:
    return {
        "most_teams": _on_stints(rankings.most_teams),
        "team_most_players": _on_stints(rankings.teams_with_most_players),
        "active_by_country": _on_stints(rankings.active_by_country),
        "top_tenure": _on_stints(lambda s: rankings.longest_current_tenure(s, AS_OF)),
        "current_tenure_lag": _on_stints(lambda s: rankings.current_tenure(s, AS_OF, "lag")),
        "current_tenure_exact": _on_stints(lambda s: rankings.current_tenure(s, AS_OF, "exact")),
        "player_days_lag": _on_stints(lambda s: _player_days(s, "lag")),
        "player_days_exact": _on_stints(lambda s: _player_days(s, "exact")),
        "most_teammates": _on_stints(lambda s: rankings.most_teammates(s, AS_OF)),
        "pair_time_lag": _on_stints(lambda s: rankings.pairs_with_most_time(s, AS_OF, "lag")),
        "pair_time_exact": _on_stints(lambda s: rankings.pairs_with_most_time(s, AS_OF, "exact")),
        "main_report": _on_stints(lambda s: main_report.main_report(s, AS_OF)),
        "team_window": _on_stints(
            lambda s: lineups.team_window(s, SOME_FROM, SOME_TO, AS_OF).select(*RECORD)
        ),
        "player_stints": _on_stints(lambda s: lookups.stints_of(s, _busiest(s))),
        "latest_stint": _on_stints(lookups.latest_stint),
        "player_headers": _on_stints(player_page.player_headers),
        "player_teams": _on_stints(lambda s: player_page.player_teams(s, AS_OF)),
        "teammates_merged_lag": _on_stints(
            lambda s: teammates.teammate_periods(s, _busiest(s), AS_OF)
        ),
        "teammates_merged_exact": _on_stints(
            lambda s: teammates.teammate_periods(s, _busiest(s), AS_OF, "exact")
        ),
        "teammates_rollup": _on_stints(
            lambda s: player_page.player_teammates(s, _busiest(s), AS_OF)
        ),
        "lineup_segments": _on_stints(_segments),
        "lineup_filtered": _on_stints(_shown),
        "lineup_members": _on_stints(_members),
        "lineup_invalid": _on_stints(lineups.undated_records),
        "lineup_game_version": _on_stints(_lineup_versions),
        "lineup_pages": _on_stints(_lineup_pages),
        "label_days": _on_stints(_label_days),
        "label_dates": _on_stints(_label_dates),
        "label_position": _on_stints(_label_position),
        "label_version": _on_stints(_label_version),
        "label_country": _on_stints(_label_country),
        "validity_rules": _on_stints(_validity),
        "links": _on_stints(_links),
        "slugs": _slugs,
        "date_repair": _date_repair,
        "date_repair_month_end": lambda spark, sf_dir: _date_repair(spark, sf_dir, True),
        "raw_rule": _raw_rule,
        "roster_extraction": _extraction,
        "roster_extraction_by_team": _team_extraction,
        "page_links": _page_links,
        "category_links": _category_links,
        "feed_round_trip": _feed_round_trip,
        "snapshot_reload": _snapshot_reload,
        "snapshot_version": _snapshot_version,
        "team_by_id": _listed_teams,
        "player_page_order": _on_stints(_player_page_order),
        "teammate_page_order": _on_stints(_teammate_page_order),
        "team_window_stored": _team_window_stored,
        "reload_gate": _reload_gate,
        "refresh_incremental": _refresh_incremental,
        "lineup_update": _on_stints(_lineup_update),
        "lineup_nested": _on_stints(_lineup_nested),
        "team_header": _team_header,
        "dates_shown": _on_stints(_dates_shown),
        "version_shown": _version_shown,
        "teams_dim": _teams,
        "stints_load": lambda spark, sf_dir: _iso(feed.build_stints(demo.feed(spark, sf_dir))),
        "constraint_report": _constraints,
        "constraint_violations": _violations,
        "entity_index": _entities,
        "query_routing": _routing,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql() | (llm.oracle_sql() if llm else {})
