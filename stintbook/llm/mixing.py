"""Mixing sources to target weights by temperature.

Weights are the sources' token shares raised to an exponent: 1 keeps the shares, 0 makes all
sources equal. The exponent is bisected: as close to 1 as the target entropy allows, but so large
that no source is repeated more than the limit. The budget is the smallest that uses every
document, so the largest source is read once and others up to the limit.

The weights are realised by budgeted block permutations. The documents of a source lie in blocks
by a hash; each epoch reads the blocks in an order of its own. Full epochs read all blocks; the
last one reads blocks until the source's budget is spent, and in the block where that happens, its
documents by their hash. Tokens are estimated from the text alone, or given by the caller. Nothing is collected: the driver sees sums only. DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintbook.sources.shared import keep

# Of the entropy of equal weights; and how often a document may be read on average.
ENTROPY, REPEATS = 0.9, 1.5
BLOCKS = 1024
# Bits of a key that its range leaves open: 4,096 ranges.
KEY_BITS = 52
STEPS = 40

# Bytes of a token, where there is no vocabulary.
TOKEN_BYTES = 4


def tokens() -> Column:
    """An estimate of the text's token count by its bytes in UTF-8. It needs no vocabulary and holds
    for scripts without spaces, and shares depend on it only as far as sources differ."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return F.ceil(size / TOKEN_BYTES).cast("long")


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"))


def _block(key: Column) -> Column:
    return F.pmod(key, F.lit(BLOCKS)).cast("int")


def _place(block: Column, epoch: Column, source: Column) -> Column:
    """Where a block stands in the permutation of an epoch."""
    return F.xxhash64(block, epoch, source)


def exponent(sources: DataFrame, entropy: float, repeats: float) -> float:
    """For ``sources`` (tokens): the exponent nearest to 1 whose weights have the entropy, or the
    smallest that keeps to the repetition limit, whichever is larger."""
    row = sources.agg(
        F.count(F.lit(1)).alias("n"), F.max("tokens").alias("most"), F.min("tokens").alias("least")
    ).first()
    if row.n < 2:
        return 1.0

    def entropy_at(t: float) -> float:
        x = F.log(F.col("tokens") / F.lit(float(row.most)))
        sums = sources.agg(F.sum(F.exp(t * x)).alias("z"), F.sum(F.exp(t * x) * t * x).alias("a"))
        s = sums.first()
        return math.log(s.z) - s.a / s.z

    def bisect(meets) -> float:
        """The border between 0, where ``meets`` holds, and 1."""
        if meets(1.0):
            return 1.0
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (mid, high) if meets(mid) else (low, mid)
            if high - low < 1e-6:
                break
        return low

    by_entropy = bisect(lambda t: entropy_at(t) >= entropy * math.log(row.n))
    over = lambda t: (row.most / row.least) ** (1 - t) > repeats
    by_limit = bisect(over) + 1e-6 if over(0.0) else 0.0
    return min(1.0, max(by_entropy, by_limit))


def plan(rows: DataFrame, entropy: float, repeats: float) -> DataFrame:
    """One row per source: source, weight, tokens, full epochs, and where the last epoch ends.

    ``rows``: source, n_tokens, key. A source without tokens is read once and has no weight.
    """
    totals = keep(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    filled = totals.filter("tokens > 0")
    t = exponent(filled, entropy, repeats)
    sums = filled.agg(
        F.max("tokens").alias("most"), F.sum(F.pow("tokens", F.lit(t))).alias("z")
    ).first()
    times = F.pow(F.lit(float(sums.most or 1)) / F.col("tokens"), F.lit(1 - t))
    sources = keep(
        totals.select(
            "source",
            "tokens",
            F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(t)) / F.lit(sums.z or 1.0))
            .otherwise(0.0)
            .alias("weight"),
            F.when(F.col("tokens") > 0, times).otherwise(1.0).alias("times"),
        ).withColumns(
            {
                # A whole number of epochs may be missed by the last digit.
                "full": F.floor(F.col("times") + 1e-9).cast("int"),
                "budget": F.col("tokens") * F.greatest(F.col("times") % 1, F.lit(0.0)),
            }
        ),
        "weights",
    )
    block = _block(F.col("key"))
    blocks = rows.groupBy("source", block.alias("block")).agg(F.sum("n_tokens").alias("size"))
    own = blocks.withColumnRenamed("source", "_s").join(
        sources, F.col("_s").eqNullSafe(F.col("source"))
    )
    place = _place(F.col("block"), F.col("full") + 1, F.col("source"))
    upto = Window.partitionBy("source").orderBy("place", "block")
    running = own.withColumn("place", place).withColumn("upto", F.sum("size").over(upto))
    # The block in which the budget ends; earlier ones are read whole.
    last = running.filter("upto >= budget AND upto - size < budget").select(
        F.col("source").alias("_s"),
        F.col("block").alias("last_block"),
        F.col("place").alias("last_place"),
        (F.col("budget") - F.col("upto") + F.col("size")).alias("left"),
    )
    in_last = rows.withColumn("block", block).join(
        last, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("last_block"))
    )
    # That block may be large itself: by ranges of the key first, then within the range where the
    # budget ends. Rows with equal keys are taken together or not at all, and summed before.
    part = F.shiftright("key", KEY_BITS)
    keys = in_last.groupBy("source", "left", "key").agg(F.sum("n_tokens").alias("n_tokens"))
    parts = keys.groupBy("source", "left", part.alias("part")).agg(F.sum("n_tokens").alias("size"))
    by_part = Window.partitionBy("source").orderBy("part")
    parts = parts.withColumn("upto", F.sum("size").over(by_part))
    ends = parts.filter("upto > left AND upto - size <= left").select(
        F.col("source").alias("_p"), F.col("part").alias("end_part"),
        (F.col("upto") - F.col("size")).alias("before"),
    )
    whole = parts.filter("upto <= left").groupBy("source").agg(F.max("part").alias("part"))
    last_key = F.shiftleft("part", KEY_BITS).bitwiseOR(F.lit((1 << KEY_BITS) - 1))
    whole_cut = whole.select("source", last_key.alias("cut"))
    spent = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("key"))
    partly = keys.join(
        ends, F.col("source").eqNullSafe(F.col("_p")) & (part == F.col("end_part"))
    )
    partly = partly.withColumn("spent", spent + F.col("before")).filter("spent <= left")
    cut = (
        whole_cut.unionByName(partly.select("source", F.col("key").alias("cut")))
        .groupBy(F.col("source").alias("_c"))
        .agg(F.max("cut").alias("cut"))
    )
    out = sources.join(last.drop("left"), F.col("source").eqNullSafe(F.col("_s")), "left")
    out = out.join(cut, F.col("source").eqNullSafe(F.col("_c")), "left").drop("_s", "_c")
    return keep(out, "plan")


def _epochs(
    docs: DataFrame, entropy: float, repeats: float, counted: Column | None
) -> DataFrame:
    """A row for each time a document is read: row (its columns), source, n_tokens, block, epoch."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    n_tokens = tokens() if counted is None else F.coalesce(counted, F.lit(0)).cast("long")
    # The caller's columns are in one struct, so no name can clash with these.
    mine = docs.select(
        whole.alias("row"), F.col("source"), _key().alias("key"), n_tokens.alias("n_tokens")
    ).withColumn("block", _block(F.col("key")))
    rows = keep(mine.select("source", "n_tokens", "key"), "tokens")
    weights = plan(rows, entropy, repeats).select(
        F.col("source").alias("of"), "full", "last_block", "last_place", "cut"
    )
    joined = mine.join(weights, F.col("source").eqNullSafe(F.col("of")))
    place = _place(F.col("block"), F.col("full") + 1, F.col("source"))
    once_more = F.coalesce(
        F.when(F.col("block") == F.col("last_block"), F.col("key") <= F.col("cut")).otherwise(
            place < F.col("last_place")
        ),
        F.lit(False),
    )
    times = F.col("full") + once_more.cast("int")
    return joined.withColumn("epoch", F.explode(F.sequence(F.lit(1), times)))


def mix(
    docs: DataFrame,
    entropy: float = ENTROPY,
    repeats: float = REPEATS,
    counted: Column | None = None,
) -> DataFrame:
    """``docs`` with all its columns, each row as often as the mixture reads it, at least once.

    ``counted`` gives the tokens of a row where a vocabulary's counts are known, as those of
    ``token_counts``; without it they are estimated. A null source is a source of its own. Texts
    that are null or empty have no tokens; a source of only such texts is read once. Rows with the
    same doc_id are read equally often. Columns may have any name; an empty table gives an empty
    result.
    """
    return _epochs(docs, entropy, repeats, counted).select("row.*")


def schedule(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> DataFrame:
    """The mixture as an order of reading: doc_id, source, n_tokens, epoch, block, place.

    Within an epoch a source's blocks are read by ``place``; cases as for ``mix``.
    """
    epochs = _epochs(docs.select("doc_id", "source", "text"), entropy, repeats, None)
    place = _place(F.col("block"), F.col("epoch"), F.col("source"))
    return epochs.select(
        "row.doc_id", "source", "n_tokens", "epoch", "block", place.alias("place")
    )
