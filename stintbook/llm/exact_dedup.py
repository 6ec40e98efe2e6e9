"""Exact duplicates with the frequent texts split off.

Texts are equal when identical after all white space of ASCII is deleted. Each row is reduced to a
digest once. Frequent digests are found by the counter method of Misra and Gries, which never
misses a digest above the support and names at most ``1 / SUPPORT`` of them; their groups are
counted exactly, and their verified winners are broadcast, so the rows of hot groups are decided
where they lie. All other digests are grouped by an ordinary shuffle. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintbook.sources.shared import keep

WHITE = " \t\n\x0b\x0c\r"
# Share of all rows above which a digest is surely found as frequent: at most 2,000 digests.
SUPPORT = 0.0005


def _text() -> F.Column:
    return F.coalesce(F.col("text"), F.lit(""))


def digest() -> F.Column:
    """Digest of the text without white space; null counts as empty."""
    return F.sha2(F.translate(_text(), WHITE, ""), 256)


def _winners(rows: DataFrame) -> DataFrame:
    """Per digest the row that stays and the size of the group."""
    best = F.min(F.struct((-F.col("n_chars")).alias("c"), F.isnull("doc_id"), "doc_id", "row"))
    return rows.groupBy("text_sha256").agg(
        best.alias("best"), F.count(F.lit(1)).alias("group_size")
    )


def duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in its own text stays, then the smallest
    doc_id (null last). Rows that repeat a doc_id and its text are decided each; one of them
    stays. Null text counts as empty; empty texts equal each other; other columns are left out.
    """
    rows = keep(
        docs.select(
            "doc_id",
            digest().alias("text_sha256"),
            F.char_length(_text()).cast("long").alias("n_chars"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    frequent = _frequent(rows, "text_sha256")
    # Bounded by the support, whatever the input.
    hot = keep(
        _winners(rows.join(F.broadcast(frequent), "text_sha256", "left_semi")).filter(
            "group_size > 1"
        ),
        "frequent",
    )
    marked = rows.join(F.broadcast(hot), "text_sha256", "left")
    decided = marked.filter("best IS NOT NULL")
    rest = rows.join(F.broadcast(hot), "text_sha256", "left_anti")
    ordinary = rest.join(_winners(rest), "text_sha256")
    return decided.unionByName(ordinary).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("best.row") == F.col("row")).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, one row of each group of equal texts.

    It is the row with the most code points in its own text, then the smallest doc_id (null last).
    Where rows are equal in these, any column may tell them apart: the one with the least hash of
    all its columns stays. Null text counts as empty; empty texts equal each other. Columns may
    have any name; an empty table gives an empty result.

    Losers of frequent texts go where they lie; all other rows are moved once, by the digest of
    their text.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # The caller's columns are in one struct, so no name can clash with these.
    keyed = docs.select(
        whole.alias("row"),
        F.col("doc_id").alias("id"),
        digest().alias("sha"),
        F.char_length(_text()).cast("long").alias("size"),
    )
    found = keep(keyed.select("id", "sha", "size"), "digests")
    alike = found.groupBy("sha", "size", "id").agg(F.count(F.lit(1)).alias("rows"))
    frequent = _frequent(found, "sha")
    # Bounded by the support, whatever the input.
    hot = keep(
        _best(alike.join(F.broadcast(frequent), "sha", "left_semi")).filter("rows > 1"), "frequent"
    )
    wins = (F.col("size") == F.col("best.size")) & F.col("id").eqNullSafe(F.col("best.id"))
    alone = F.col("best.rows") == 1
    marked = keyed.join(F.broadcast(hot), "sha", "left").withColumn("hot", F.col("best").isNotNull())
    # Frequent texts whose winner is a row of its own are decided here.
    open_ = marked.filter(~F.col("hot") | (wins & alone)).drop("best", "rows")
    ordinary = _best(alike.join(F.broadcast(hot.select("sha")), "sha", "left_anti"))
    joined = open_.join(ordinary, "sha", "left").filter(F.col("hot") | wins)
    hashed = F.when(alone, F.lit(0)).otherwise(F.xxhash64(F.to_json("row")))
    first = F.row_number().over(Window.partitionBy("sha").orderBy("hash"))
    kept = joined.withColumn("hash", hashed).withColumn("place", first).filter("place = 1")
    kept = kept.select("row.*")
    if hot.filter(~alone).isEmpty():
        return kept
    # Rows that repeat the winner of a frequent text are brought down to one before they move.
    tied = marked.filter(F.col("hot") & wins & ~alone)
    single = tied.groupBy("sha").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return kept.unionByName(single.select("row.*"))


def _best(alike: DataFrame) -> DataFrame:
    """Per digest what its winner is like, of how many rows that is true, and all its rows."""
    order = F.struct(
        (-F.col("size")).alias("minus"), F.isnull("id").alias("nameless"), "id", "size", "rows"
    )
    return alike.groupBy("sha").agg(F.min(order).alias("best"), F.sum("rows").alias("rows"))


def _frequent(rows: DataFrame, column: str) -> DataFrame:
    """Candidates for frequent values: all above the support are among them."""
    found = rows.stat.freqItems([column], SUPPORT).first()
    values = [(x,) for x in (found[0] if found and found[0] else [])]
    return rows.sparkSession.createDataFrame(values, f"{column} string")
