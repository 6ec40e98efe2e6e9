"""Quality by weak supervision: rules vote or abstain, and their accuracies are estimated.

Each rule looks at counts of one text and votes good, bad, or not at all. No rule is trusted in
advance: expectation maximisation over the vote patterns of all documents estimates how often a
rule's vote is right for good and for bad texts, and the posterior probability of a good text
replaces a list of tests that all must pass. DataFrame operations only; what reaches the driver is
two numbers per rule and step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintbook.sources.shared import keep

# White space and words.
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
MIN_WORDS = 50
STEPS, CLOSE = 40, 1e-6
# Right and wrong votes that a rule has before any is seen, over good and over bad texts. A fault
# is mostly seen by one rule alone, so rules miss bad texts more often than they blame good ones.
PRIOR_GOOD, PRIOR_BAD = (99.0, 1.0), (3.0, 7.0)
# A text is kept from this posterior probability on.
THRESHOLD = 0.5


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text; null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = lambda c: F.size(c).cast("long")
    chars = lambda pattern: F.length(F.regexp_replace("t", pattern, "")).cast("long")
    base = docs.select("doc_id", text.alias("t")).withColumn("w", _words(F.col("t")))
    base = base.select(
        "doc_id",
        "w",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        chars(SYMBOLS).alias("n_symbols"),
        chars(r"[^A-Z]+").alias("n_upper"),
        chars(r"[^!?]+").alias("n_shouts"),
        chars(r"[^0-9]+").alias("n_digits"),
        chars(r"[^\p{L}\p{N}]+").alias("n_letters"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    w = F.col("w")
    three = F.transform(
        F.sequence(F.lit(1), F.size(w) - 2),
        lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)),
    )
    base = base.select(
        "*",
        F.when(F.size(w) > 2, three).otherwise(F.array().cast("array<string>")).alias("three"),
        F.size(F.array_distinct("lines")).alias("_lines"),
        F.size(F.array_distinct("w")).alias("_words"),
    ).withColumn("again", F.size(F.array_distinct("three")) < F.size("three"))
    # Equal windows stand side by side once sorted. Texts without any need no sorting.
    placed = F.array_sort(F.transform("three", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    base = base.withColumn("sorted", F.when(F.col("again"), placed))
    sorted_ = F.col("sorted")
    near = lambda k: F.get(sorted_, k)["x"]
    same = F.transform(
        sorted_,
        lambda e, k: F.when(
            F.coalesce(near(k - 1) == e["x"], F.lit(False))
            | F.coalesce(near(k + 1) == e["x"], F.lit(False)),
            F.array(e["i"], e["i"] + 1, e["i"] + 2),
        ),
    )
    covered = F.size(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    return base.select(
        "doc_id",
        size("w").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.col("_lines")).cast("long").alias("n_dup_lines"),
        F.when(F.col("again"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        "n_upper",
        "n_shouts",
        "n_digits",
        "n_letters",
        size("lines").alias("n_lines"),
        F.col("_words").cast("long").alias("n_distinct_words"),
    )


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), -1).when(bad, 0).when(good, 1).otherwise(-1).cast("int")


def votes() -> dict[str, Column]:
    """Rules over the counts: 1 good, 0 bad, -1 no vote."""
    words = F.col("n_words")
    share = lambda c, of: F.when(of > 0, c / of)
    rules = {
        "symbols": (share(F.col("n_symbols"), words), 0.02, 0.20),
        "repeats": (share(F.col("n_repeat_words"), words), 0.10, 0.40),
        "lines": (share(F.col("n_dup_lines"), F.col("n_lines")), 0.05, 0.30),
        "upper": (share(F.col("n_upper"), F.col("word_chars")), 0.15, 0.40),
        "shouts": (share(F.col("n_shouts"), words), 0.05, 0.30),
        "digits": (share(F.col("n_digits"), F.col("word_chars")), 0.10, 0.35),
        "signs": (1 - share(F.col("n_letters"), F.col("word_chars")), 0.07, 0.11),
    }
    out = {k: _vote(v, v <= low, v >= high) for k, (v, low, high) in rules.items()}
    length = share(F.col("word_chars"), words)
    out["length"] = _vote(length, length.between(3, 12), (length < 2) | (length > 20))
    # Longer texts repeat words anyway, so only texts of some length are judged.
    variety = F.when(words.between(30, 1000), F.col("n_distinct_words") / words)
    out["variety"] = _vote(variety, variety >= 0.35, variety <= 0.2)
    return out


def _posterior(model: dict) -> Column:
    """Probability of a good text under the model, from the vote columns."""
    odds = F.lit(math.log(model["good"] / (1 - model["good"])))
    for name, (good, bad) in model["rules"].items():
        odds = odds + (
            F.when(F.col(name) == 1, math.log(good / (1 - bad)))
            .when(F.col(name) == 0, math.log((1 - good) / bad))
            .otherwise(0.0)
        )
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def _accuracies(
    bad_bad: float, bad_good: float, good_bad: float, good_good: float
) -> tuple[float, float]:
    """From the sums by vote and class: how often good texts get a good vote, bad ones a bad."""

    def rate(yes: float, no: float, prior: tuple[float, float]) -> float:
        return (yes + prior[0]) / (yes + no + sum(prior))

    good = min(rate(good_good, bad_good, PRIOR_GOOD), 0.9999)
    return good, max(min(rate(bad_bad, good_bad, PRIOR_BAD), 0.9999), 1 - good)


def estimate(voted: DataFrame, rules: list[str]) -> dict:
    """The share of good texts, and per rule how often its votes are right for good and for bad
    texts. ``voted`` has a column of votes per rule.

    At most ``3 ** len(rules)`` patterns occur, whatever the number of texts. Without texts the
    prior is returned. A rule blames bad texts at least as often as good ones, which fixes what
    "good" means.
    """
    patterns = keep(
        voted.groupBy(*rules).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "patterns"
    )
    start = tuple(right / (right + wrong) for right, wrong in (PRIOR_GOOD, PRIOR_BAD))
    model = {"good": 0.7, "rules": dict.fromkeys(rules, start)}
    for _ in range(STEPS):
        p, n = F.col("p"), F.col("n")
        sums = [F.sum(n * p).alias("good"), F.sum(n).alias("all")]
        for r in rules:
            for vote in (0, 1):
                own = F.when(F.col(r) == vote, n)
                sums.append(F.sum(own * p).alias(f"{r}_{vote}_1"))
                sums.append(F.sum(own * (1 - p)).alias(f"{r}_{vote}_0"))
        row = patterns.withColumn("p", _posterior(model)).agg(*sums).first()
        seen = {k: v or 0.0 for k, v in row.asDict().items()}
        new = {
            "good": (seen["good"] + 7) / (seen["all"] + 10),
            "rules": {
                r: _accuracies(*(seen[f"{r}_{v}_{y}"] for v in (0, 1) for y in (0, 1)))
                for r in rules
            },
        }
        moved = max(
            abs(new["good"] - model["good"]),
            *(
                abs(a - b)
                for r in rules
                for a, b in zip(new["rules"][r], model["rules"][r], strict=True)
            ),
        )
        model = new
        if moved < CLOSE:
            break
    return model


def quality(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts, base_failed, kept, and p_good.

    A text with fewer than 50 words, or more than half of them in repeated windows of three words,
    fails the base test; others are kept when their posterior reaches ``threshold``. Null and
    empty texts have zero counts and fail. Repeated rows are judged each, alike; other columns are
    left out. An empty table gives an empty result.
    """
    rules = votes()
    voted = keep(features(docs).withColumns(rules), "votes")
    model = estimate(voted, list(rules))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    )
    return voted.withColumn("p_good", _posterior(model)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("p_good") >= threshold)).alias("kept"),
        "p_good",
    )
