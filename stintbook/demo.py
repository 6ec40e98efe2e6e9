"""Stints derived from order tables, for queries over the driver's data.

A customer is a player, a part is a team, and an order line is a stay from the order date to
the ship date.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintbook.schema import STINTS

# After the last ship date.
AS_OF = dt.date(2001, 12, 31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table."""
    homes = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("flag_name"))
    )
    orders = table(spark, sf_dir, "orders").join(homes, "o_custkey")
    lines = table(spark, sf_dir, "lineitem").join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    )

    end = F.when(
        (F.col("l_shipdate") >= F.col("o_orderdate")) | (F.col("l_linenumber") == 7),
        F.col("l_shipdate").cast("date"),
    )
    returned = F.col("l_returnflag") == "R"
    priority = F.col("o_orderpriority")
    unread = F.col("l_quantity") == 1
    half_read = F.col("l_quantity") == 2
    derived = lines.select(
        F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("player_uid"),
        F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("team_id"),
        F.when(priority == "1-URGENT", F.lit("CS2"))
        .when(priority == "2-HIGH", F.lit("CS:GO"))
        .when(priority == "3-MEDIUM", F.lit("CS: Source"))
        .when(priority == "4-NOT SPECIFIED", F.lit("CS"))
        .alias("game_version"),
        F.concat(F.lit("nick"), F.col("o_custkey").cast("string")).alias("nickname"),
        F.lit(None).cast("string").alias("full_name"),
        F.lit(None).cast("string").alias("player_url"),
        (F.col("l_linenumber") == 1).alias("is_captain"),
        F.when(F.col("l_tax") >= 0.08, F.lit("(Coach)")).alias("position"),
        F.col("flag_name"),
        F.when(~unread, F.col("o_orderdate").cast("date")).alias("join_date"),
        F.when(returned, end).alias("inactive_date"),
        F.when(~returned, end).alias("leave_date"),
        end.alias("inactive_or_leave_date"),
        (unread | half_read).alias("has_invalid_dates"),
        F.when(unread, F.lit("unknown")).alias("join_date_raw"),
        F.lit(None).cast("string").alias("inactive_date_raw"),
        F.when(half_read, F.lit("20??-??-??")).alias("leave_date_raw"),
    )
    return derived.select(*STINTS.names)


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stays as feed records, with team names and URLs that differ by row."""
    lines = stints(spark, sf_dir)
    return lines.select(
        F.col("team_id").alias("team_unique_name"),
        F.concat(F.lit("Team "), F.col("team_id")).alias("team_name"),
        F.concat_ws(
            "", F.lit("https://wiki.example/"), "team_id", F.lit("?v="), "game_version"
        ).alias("team_url"),
        F.col("player_uid").alias("player_unique_id"),
        "game_version",
        F.col("nickname").alias("player_id"),
        "full_name",
        "player_url",
        "is_captain",
        "position",
        "flag_name",
        "join_date",
        "inactive_date",
        "leave_date",
        "join_date_raw",
        "inactive_date_raw",
        "leave_date_raw",
        "has_invalid_dates",
    )


def _cell_kind() -> Column:
    return (
        F.when(F.col("l_returnflag") == "A", "join_date")
        .when(F.col("l_returnflag") == "R", "inactive_date")
        .otherwise("leave_date")
    )


def _cell_text() -> Column:
    """The ship date in one of ten ways: exact, with unknown parts, missing, or odd."""
    day = F.date_format(F.col("l_shipdate").cast("date"), "yyyy-MM-dd")
    ways = [
        day,
        F.concat(F.left(day, F.lit(8)), F.lit("??")),
        F.concat(F.left(day, F.lit(5)), F.lit("??-??")),
        F.concat(F.left(day, F.lit(2)), F.lit("??-??-??")),
        F.lit(""),
        F.replace(day, F.lit("-"), F.lit("")),
        F.concat(day, F.lit(" [1]")),
        F.left(day, F.lit(4)),
        F.replace(day, F.lit("-"), F.lit("/")),
        F.left(day, F.lit(7)),
    ]
    return F.element_at(F.array(*ways), (F.col("l_quantity").cast("int") % 10) + 1)


def date_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One date cell per order line, ``(l_orderkey, l_linenumber, kind, text)``."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", _cell_kind().alias("kind"), _cell_text().alias("text")
    )


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Parsing is the costly part, so the still narrow rows are spread evenly before it. With a
    number, because adaptive execution would put such small rows together in a few tasks."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, key)


def roster_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wiki page with one roster row for each order line, as ``(page_id, url, html)``.

    Lines 1 to 3 stand in a tab; of these, tab 3 is not about a game. Other lines take the
    game from the infobox, which names two games on even lines.
    """
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("page_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").cast("string").alias("part"),
        F.col("l_suppkey").cast("string").alias("supplier"),
        F.when(F.col("l_tax") >= 0.05, "(Coach)").alias("position"),
        _cell_kind().alias("kind"),
        _cell_text().alias("text"),
    )
    rows = _spread(rows, "page_id")
    line, part, supplier = F.col("line"), F.col("part"), F.col("supplier")
    caption = (
        F.when(F.col("kind") == "join_date", "Join Date:")
        .when(F.col("kind") == "inactive_date", "Inactive Date:")
        .otherwise("Leave Date:")
    )
    html = F.concat_ws(
        "",
        F.lit('<html><body><h1 id="firstHeading"><span>Team '),
        part,
        F.lit('</span></h1><div><div class="infobox-description">Games:</div><div><a>CS</a>'),
        F.when(line % 2 == 0, "<a>CS2</a>"),
        F.lit('</div></div><h3><span id="Player_Roster">Player Roster</span></h3><div>'),
        F.lit('<ul class="nav-tabs"><li class="tab1 active">CS2</li><li class="tab2">CS:GO</li>'),
        F.lit('<li class="tab3">Notes</li></ul><div class="'),
        F.when(line <= 3, F.concat(F.lit("content"), line.cast("string"))).otherwise("plain"),
        F.lit('"><table class="roster-card"><tr class="Player"><td class="ID">'),
        F.lit('<span class="flag"><img title="Land '),
        supplier,
        F.lit('"></span><a href="'),
        F.when(line == 5, "/index.php?title=S%C3%A9_").otherwise("/wiki/S%C3%A9_"),
        supplier,
        F.when(line == 5, "&amp;action=edit&amp;redlink=1"),
        F.lit('"> s'),
        supplier,
        F.lit(" </a>"),
        F.when(line == 1, '<i title="Captain"></i>'),
        F.lit('</td><td class="Position"><i>'),
        F.col("position"),
        F.lit('</i></td><td class="Date"><div class="MobileStuffDate">'),
        caption,
        F.lit("</div><i>"),
        F.col("text"),
        F.lit('</i></td></tr></table></div></div><h2><span id="Organization">'),
        F.lit('Staff</span></h2><div><table class="roster-card"><tr class="Player"></tr>'),
        F.lit("</table></div></body></html>"),
    )
    return rows.select(
        "page_id",
        F.concat(F.lit("https://wiki.example/game/Team_"), part).alias("url"),
        html.alias("html"),
    )


def team_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wiki page for each order with a roster row for each of its lines.

    Lines 1 to 3 stand on a card in a tab, the others on a card outside. Every third line has no
    link. Even lines have a second date cell with the exact day, line 5 one without text.
    """
    kind, line = _cell_kind(), F.col("l_linenumber")
    supplier = F.col("l_suppkey").cast("string")
    caption = (
        F.when(kind == "join_date", "Join Date:")
        .when(kind == "inactive_date", "Inactive Date:")
        .otherwise("Leave Date:")
    )
    day = F.date_format(F.col("l_shipdate").cast("date"), "yyyy-MM-dd")
    again = F.when(line % 2 == 0, day).when(line == 5, "")

    def cell(label: Column, text: Column) -> Column:
        return F.concat(
            F.lit('<td class="Date"><div class="MobileStuffDate">'),
            label,
            F.lit("</div><i>"),
            text,
            F.lit("</i></td>"),
        )

    row = F.concat_ws(
        "",
        F.lit('<tr class="Player"><td class="ID"><span class="flag"><img title="Land '),
        supplier,
        F.lit('"></span><a href="'),
        F.when(line % 3 != 0, F.concat(F.lit("/wiki/S%C3%A9_"), supplier)),
        F.lit('">s'),
        supplier,
        F.lit('</a></td><td class="Name"><div class="LargeStuff"> Full '),
        supplier,
        F.lit("</div></td>"),
        cell(F.lit("Note:"), F.lit("2001-01-01")),
        cell(caption, _cell_text()),
        cell(caption, again),
        F.lit("</tr>"),
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", line, row.alias("row"))
    cards = rows.groupBy("l_orderkey").agg(
        F.array_join(F.collect_list(F.when(line <= 3, F.col("row"))), "").alias("inside"),
        F.array_join(F.collect_list(F.when(line > 3, F.col("row"))), "").alias("outside"),
    )
    order = F.col("l_orderkey").cast("string")
    html = F.concat(
        F.lit('<h1 id="firstHeading"><span>Team '),
        order,
        F.lit('</span></h1><div><div class="infobox-description">Games:</div><div><a>CS</a>'),
        F.lit("</div></div>"),
        F.lit('<h3><span id="Player_Roster">Player Roster</span></h3><div><ul class="nav-tabs">'),
        F.lit('<li class="tab1">CS2</li></ul><div class="content1"><table class="roster-card">'),
        F.col("inside"),
        F.lit('</table></div><table class="roster-card">'),
        F.col("outside"),
        F.lit('</table></div><h2><span id="Organization">Staff</span></h2>'),
    )
    return cards.select(
        F.col("l_orderkey").alias("page_id"),
        F.concat(F.lit("https://wiki.example/game/Order_"), order).alias("url"),
        html.alias("html"),
    )


def category_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category page for each part: a team, a user page, and on even parts a next page."""
    rows = _spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    part = F.col("p_partkey").cast("string")
    html = F.concat_ws(
        "",
        F.lit('<a href="/outside">x</a><div id="mw-pages">'),
        F.when(
            F.col("p_partkey") % 2 == 0,
            F.concat(F.lit('<a href="/index.php?from='), part, F.lit('">next page</a>')),
        ),
        F.lit('<div class="mw-content-ltr"><A HREF="/game/'),
        part,
        F.lit('">'),
        F.col("p_name"),
        F.lit('</A><a href="/game/User:'),
        part,
        F.lit('">x</a></div></div>'),
    )
    return rows.select(
        F.col("p_partkey").alias("page_id"),
        F.concat(F.lit("https://wiki.example/game/Category:"), part).alias("url"),
        html.alias("html"),
    )


def broken_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams from parts, some of them missing, listed twice, or without an id, name or URL."""
    size = F.col("p_size")
    parts = table(spark, sf_dir, "part").filter(size != 1)
    team_id = F.concat(F.lit("T"), F.col("p_partkey").cast("string"))
    return parts.unionAll(parts.filter(size == 2)).select(
        F.when(size != 3, team_id).alias("unique_name"),
        F.when(size != 4, F.col("p_name")).alias("name"),
        F.when(size != 5, F.col("p_brand")).alias("wiki_url"),
    )


def broken_stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table without some nicknames and flags."""
    return stints(spark, sf_dir).withColumns(
        {
            "nickname": F.when(F.col("position").isNull(), F.col("nickname")),
            "is_captain": F.when(F.col("game_version") != "CS2", F.col("is_captain")),
            "has_invalid_dates": F.when(
                F.col("join_date").isNotNull(), F.col("has_invalid_dates")
            ),
        }
    )
