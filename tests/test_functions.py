"""Rules for single values, as tables of input and output."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stintbook.functions import dates, labels, predicates, text

from conftest import AS_OF, frame, stint

D = dt.date


def apply(spark, schema, rows, *columns):
    """Evaluate columns over rows that are not constant-folded."""
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


MONTH_ENDS = [
    ("leave_date", "2017-02-??", D(2017, 2, 28)),
    ("leave_date", "2016-02", D(2016, 2, 29)),
    ("inactive_date", "2013-??-??", D(2013, 12, 31)),
    ("leave_date", "2017-02-03", D(2017, 2, 3)),
    ("leave_date", "2017-13", None),
    ("join_date", "2017-02-??", D(2017, 2, 1)),
    ("leave_date", None, None),
]


def test_month_end(spark):
    rows = [(kind, value) for kind, value, _ in MONTH_ENDS]
    kind, value = F.col("kind"), F.col("value")
    found = apply(
        spark, "kind string, value string", rows, kind, value,
        dates.parsed_date(kind, value, month_end=True),
    )
    assert set(found) == set(MONTH_ENDS)


DATE_CASES = [
    ("join_date", "2024-01-06", D(2024, 1, 6), None),
    ("join_date", "2024-01-06 [1]", D(2024, 1, 6), None),
    ("join_date", "20240106", D(2024, 1, 6), None),
    ("join_date", "20240230", None, "20240230"),
    ("join_date", "2003-08-??", D(2003, 8, 1), "2003-08-??"),
    ("join_date", "2009-??-??", D(2009, 1, 1), "2009-??-??"),
    ("join_date", "2009", D(2009, 1, 1), "2009"),
    ("join_date", "20??-??-??", None, "20??-??-??"),
    ("join_date", "", None, "unknown"),
    ("join_date", "  ", None, "unknown"),
    ("join_date", None, None, "unknown"),
    ("leave_date", "", None, "unknown"),
    ("leave_date", "2013-??-??", D(2013, 12, 31), "2013-??-??"),
    ("leave_date", "2013-", D(2013, 12, 31), "2013-"),
    ("leave_date", "2017-08-??", D(2017, 8, 12), "2017-08-??"),
    ("leave_date", "2017-08", D(2017, 8, 12), "2017-08"),
    ("leave_date", "2024-1-5", None, "2024-1-5"),
    ("leave_date", "2024-02-30", None, "2024-02-30"),
    ("leave_date", "2024/02/20", None, "2024/02/20"),
    ("leave_date", "0000-01-01", None, "0000-01-01"),
    ("leave_date", "9999-12-31", D(9999, 12, 31), None),
    ("leave_date", "unclear", None, "unclear"),
    ("inactive_date", "", None, None),
    ("inactive_date", "2013-??-??", D(2013, 12, 31), "2013-??-??"),
]


def test_date_parse_and_raw(spark):
    rows = [(i, kind, value) for i, (kind, value, _, _) in enumerate(DATE_CASES)]
    kind, value = F.col("kind"), F.col("value")
    found = apply(
        spark,
        "i int, kind string, value string",
        rows,
        "i",
        dates.parsed_date(kind, value),
        dates.raw_date(kind, value),
    )
    assert sorted(found) == [(i, case[2], case[3]) for i, case in enumerate(DATE_CASES)]


def test_iso_date_is_strict(spark):
    cases = [("2024-01-06", D(2024, 1, 6)), ("2024-1-6", None), ("2024", None), ("", None),
             ("2024-01-06T00", None), ("x2024-01-06", None), ("0001-01-01", D(1, 1, 1))]
    found = apply(spark, "v string", [(c[0],) for c in cases], "v", dates.iso_date(F.col("v")))
    assert sorted(found) == sorted(cases)


def test_date_type(spark):
    cases = [(" Join Date: ", "join_date"), ("LEAVE DATE", "leave_date"),
             ("Inactive Date:", "inactive_date"), ("New Team:", None), (None, None)]
    found = apply(spark, "v string", [(c[0],) for c in cases], "v", dates.date_type(F.col("v")))
    assert set(found) == set(cases)


@pytest.mark.parametrize(
    ("cells", "expected"),
    [
        ([], (None, None, None, None, None, None, True)),
        ([("Team:", "x")], (None, None, None, None, None, None, True)),
        ([("Join Date:", "2020-01-02")], (D(2020, 1, 2), None, None, None, None, None, False)),
        (
            [("Join Date:", "2020-??-??"), ("Join Date:", "2021-05-06")],
            (D(2021, 5, 6), "2020-??-??", None, None, None, None, True),
        ),
        (
            [("Leave Date:", "2020-01-02"), ("Leave Date:", "")],
            (None, None, None, None, None, "unknown", True),
        ),
        (
            [("Inactive Date:", ""), ("Join Date:", "2020-01-02")],
            (D(2020, 1, 2), None, None, None, None, None, False),
        ),
    ],
)
def test_date_cells_to_columns(spark, cells, expected):
    schema = "cells array<struct<label: string, text: string>>"
    columns = dates.date_columns(F.col("cells"))
    order = ["join_date", "join_date_raw", "inactive_date", "inactive_date_raw", "leave_date",
             "leave_date_raw", "has_invalid_dates"]
    assert apply(spark, schema, [(cells,)], *[columns[c] for c in order]) == [expected]


def test_days_text(spark):
    cases = [(0, "0 days", None), (31, "31 days", None), (32, "1 months", "32 days"),
             (371, "11 months", "371 days"), (372, "1 years", "372 days"),
             (403, "1 years, 1 months", "403 days"), (-5, "-5 days", None),
             (3045, "8 years, 2 months", "3045 days")]
    day = F.col("d")
    found = apply(spark, "d long", [(c[0],) for c in cases], "d", labels.days_text(day),
                  labels.days_tooltip(day))
    assert sorted(found) == sorted(cases, key=lambda c: c[0])


def test_version_and_position(spark):
    versions = [(None, "-"), ("", "-"), ("CS", "CS1.6"), ("cs", "CS1.6"), ("CS: Source", "CS:S"),
                ("CS:GO", "-"), ("CS2", "-"), ("CS1.6", "CS1.6"), (" Other ", "Other")]
    found = apply(spark, "v string", [(c[0],) for c in versions], "v",
                  labels.version_text(F.col("v")))
    assert set(found) == set(versions)
    positions = [(True, "(Coach)", "Captain, Coach"), (False, "(Trial)", "Player"),
                 (False, None, "Player"), (True, None, "Captain"), (False, "coach", "Coach")]
    found = apply(spark, "c boolean, p string", [c[:2] for c in positions], "c", "p",
                  labels.position_text(F.col("c"), F.col("p")))
    assert set(found) == set(positions)


def test_date_text(spark):
    cases = [(None, "-"), (D(1, 1, 1), "Unknown"), (D(9999, 12, 31), "Present"),
             (AS_OF, "Present"), (D(2024, 1, 5), "5 Jan 2024"), (D(2024, 11, 15), "15 Nov 2024")]
    found = apply(spark, "d date", [(c[0],) for c in cases], "d",
                  labels.date_text(F.col("d"), AS_OF))
    assert set(found) == set(cases)


def test_dates_with_their_text(spark):
    rows = [(D(2017, 8, 12), "2017-08-??"), (D(2017, 8, 12), ""), (None, "unknown")]
    shown = labels.date_text(F.col("d"), AS_OF)
    found = apply(spark, "d date, r string", rows, labels.dated_text(shown, F.col("r")),
                  labels.version_iso(F.col("d")))
    assert found == [
        (("12 Aug 2017", "2017-08-??"), "2017-08-12"), (("12 Aug 2017", None), "2017-08-12"),
        (("-", "unknown"), None),
    ]


def test_slugs(spark):
    cases = [("Mira (Nordic coach)", "Mira_(Nordic_coach)"), ("OddBall^", "OddBall%5E"),
             ("a*b~c/d+é", "a%2Ab~c/d%2B%C3%A9"), ("100%", "100%25"), ("a%2Fb", "a%252Fb")]
    slug = text.slugify(F.col("v"))
    found = apply(spark, "v string", [(c[0],) for c in cases], "v", slug, text.unslugify(slug))
    assert set(found) == {(v, s, v) for v, s in cases}


def test_clean_id(spark):
    cases = [(" a_b ", "a b"), ("a+b%20c", "a+b c"), ("OddBall%5E", "OddBall^"), ("50%", "50%"),
             ("%zz%41", "%zzA"), ("", "")]
    found = apply(spark, "v string", [(c[0],) for c in cases], "v", text.clean_id(F.col("v")))
    assert set(found) == set(cases)


def test_name_from_url(spark):
    cases = [
        (None, None),
        ("", None),
        ("https://w/game/Blue_Herons", "Blue Herons"),
        ("https://w/index.php?title=OddBall%5E&action=edit&redlink=1", "OddBall^"),
        ("https://w/index.php?action=edit&title=A+b&title=C", "A b"),
        ("https://w/game/", ""),
    ]
    found = apply(spark, "v string", [(c[0],) for c in cases], "v", text.name_from_url(F.col("v")))
    assert set(found) == set(cases)


def test_links(spark):
    rows = [("A b", D(2020, 1, 2), None, "x"), ("A b", None, None, ""), ("A b", None, D(2021, 3, 4), None)]
    link = text.team_link(F.col("t"), F.col("f"), F.col("u"), F.col("h"))
    found = apply(spark, "t string, f date, u date, h string", rows, link)
    assert [f[0] for f in found] == [
        "/teams/A_b/?from=2020-01-02&hl=x", "/teams/A_b/", "/teams/A_b/?to=2021-03-04",
    ]
    queries = [("", "/"), (None, "/"), ("player:A b", "/players/A_b/"), ("team:A b", "/teams/A_b/"),
               ("A b", "/teams/A_b/"), ("team:player:x", "/teams/player%3Ax/")]
    found = apply(spark, "v string", [(c[0],) for c in queries], "v",
                  text.resolve_query(F.col("v")))
    assert set(found) == set(queries)
    flags = [(None, "-"), ("", "-"), ("Czech Republic", "/img/f/Czech_Republic.svg")]
    found = apply(spark, "v string", [(c[0],) for c in flags], "v", text.flag_path(F.col("v")))
    assert set(found) == set(flags)


def test_validity_rules(spark):
    join, later = D(2020, 1, 1), D(2020, 2, 1)
    cases = [
        (stint("same day", "t", join, join), True, True),
        (stint("reversed", "t", later, join), False, True),
        (stint("reversed inactive", "t", later, None, join), False, True),
        (stint("repaired", "t", join, later, leave_date_raw="2020-??-??"), True, False),
        (stint("unread leave", "t", join, leave_date_raw="20??-??-??"), False, False),
        (stint("unread inactive", "t", join, inactive_date_raw="?"), False, False),
        (stint("no join", "t", None, later), False, False),
        (stint("empty raw", "t", join, later, join_date_raw=""), True, True),
    ]
    found = frame(spark, [c[0] for c in cases]).select(
        "player_uid", predicates.has_valid_dates(), predicates.is_clean()
    )
    assert {tuple(r) for r in found.collect()} == {(c[0]["player_uid"], c[1], c[2]) for c in cases}


def test_end_rules(spark):
    row = stint("p", "t", D(2020, 1, 1), leave=D(2025, 6, 1), inactive=D(2021, 1, 1))
    open_ = stint("q", "t", None)
    found = frame(spark, [row, open_]).select(
        "player_uid",
        predicates.stored_end(),
        predicates.period_start(),
        predicates.period_end(),
        predicates.overlap_end(AS_OF),
    )
    assert {tuple(r) for r in found.collect()} == {
        ("p", D(2021, 1, 1), D(2020, 1, 1), D(2021, 1, 1), D(2021, 1, 1)),
        ("q", None, D(1, 1, 1), D(9999, 12, 31), AS_OF),
    }


def test_window_is_closed_and_tolerates_nulls(spark):
    rows = [
        stint("ends on first day", "t", D(2019, 1, 1), D(2020, 1, 1)),
        stint("ends before", "t", D(2019, 1, 1), D(2019, 12, 31)),
        stint("starts on last day", "t", D(2020, 12, 31)),
        stint("starts after", "t", D(2021, 1, 1)),
        stint("unknown", "t"),
    ]
    found = frame(spark, rows).filter(predicates.in_window(D(2020, 1, 1), D(2020, 12, 31)))
    assert {r.player_uid for r in found.collect()} == {
        "ends on first day", "starts on last day", "unknown",
    }


def test_cells_are_read_as_by_the_single_rules(spark):
    """The kind of a cell, its date and its raw text, with their shared parts evaluated once."""
    labels = ["Join Date:", "Inactive Date:", "Leave Date:", " join date", "Team:", None]
    said = [None, "", " ", "2020-01-02", "20200102", "2020-1", "2020-??-??", "unknown", "2020/01/02 [1]",
            " 2020-01-02\u3000", "????-01-01", "2020-13-45", "0000-01-01", "A" * 20, "2020-02"]
    rows = [([(label, text)],) for label in labels for text in said]
    schema = "cells array<struct<label: string, text: string>>"
    first = F.get("cells", F.lit(0))
    kind, shown = dates.date_type(first["label"]), first["text"]
    single = F.when(
        kind.isNotNull(),
        F.array(F.struct(kind, dates.parsed_date(kind, shown), dates.raw_date(kind, shown))),
    ).otherwise(F.array())
    together, expected = zip(*apply(spark, schema, rows, dates.read_cells(F.col("cells")), single))
    as_rows = lambda found: [[tuple(c) for c in cells] for cells in found]
    assert as_rows(together) == as_rows(expected)
    assert sum(map(len, together)) == 4 * len(said)
