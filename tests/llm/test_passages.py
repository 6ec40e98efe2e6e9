"""Repeated passages against brute force."""

from __future__ import annotations

import random

import pytest

from stintbook.llm import repeated_passages

from .conftest import changed, prose

LAST = 1 << 62


def brute(rows: list[tuple]) -> list[tuple]:
    cut = [((LAST if i is None else i), (t or "").encode().split()) for i, t, *_ in rows]
    least: dict[tuple, int] = {}
    for i, w in cut:
        for a in range(len(w) - 49):
            key = tuple(w[a : a + 50])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in cut:
        gone = set()
        for a in range(len(w) - 49):
            if least[tuple(w[a : a + 50])] < i:
                gone.update(range(a, a + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        out.append((None if i == LAST else i, len(w), len(gone), kept))
    return sorted(out, key=repr)


def found(df, **how) -> list[tuple]:
    rows = repeated_passages.without_repeats(df, **how).collect()
    for r in rows:
        spans = [(s["from"], s["to"]) for s in r.spans]
        assert sum(b - a for a, b in spans) == r.n_removed and spans == sorted(spans)
        assert all(b - a >= 50 for a, b in spans)
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in rows), key=repr)


def texts(seed: int) -> list:
    rng = random.Random(seed)
    passages = [prose(rng, n) for n in (49, 50, 51, 60, 120, 300)]
    out = [prose(rng, rng.randint(0, 200)) for _ in range(20)]
    for _ in range(40):
        parts = [prose(rng, rng.randint(0, 40)) for _ in range(3)]
        parts[1:1] = rng.sample(passages, 2)
        out.append(" ".join(parts))
    out += [changed(rng, out[30], 0.01) for _ in range(10)]
    out += [out[25]] * 3 + ["w " * 400, "w " * 260, "a b " * 90, "a b c " * 200, "\x1c".join("ab" * 90)]
    out += [passages[3].replace(" ", " "), "é 漢 " * 60, " ".join(passages[4].split()[10:])]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("hot", [20_000, 3, 0])
def test_equal_brute_force(spark, make, hot):
    df = make(texts(hot))
    assert found(df, hot=hot) == brute([tuple(r) for r in df.collect()])


def test_rows_without_or_with_the_same_id(spark):
    rng = random.Random(9)
    a, b = prose(rng, 130), prose(rng, 130)
    both = f"{a} {b}"
    rows = [(None, a), (None, both), (None, a), (3, b), (3, f"x {b}"), (3, b), (7, both), (7, both)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert found(df) == brute(rows)
    only = [(None, a), (None, both), (None, None), (None, "")]
    assert found(spark.createDataFrame(only, "doc_id int, text string")) == brute(only)
    assert found(spark.createDataFrame([], "doc_id int, text string")) == []


def test_parts_of_long_texts():
    rng = random.Random(4)
    long = prose(rng, 3_000)
    for text in (long, "x" * 5_000 + " " + long, "y" * 9_000, " " * 3_000 + long):
        for size in (400, 1_000, 4_000):
            raw = text.encode()
            words, covered = raw.split(), []
            for at, part in repeated_passages._parts(raw, size):
                own = part.split()
                assert words[at : at + len(own)] == own
                covered += range(at, at + len(own) - 49)
            assert set(covered) >= set(range(len(words) - 49))


def test_text_longer_than_a_stretch(spark):
    rng = random.Random(5)
    words = [str(rng.randrange(10**6)) for _ in range(320_000)]
    long = " ".join(words)
    assert len(long) > repeated_passages.STRETCH
    middle = len(long[: repeated_passages.STRETCH].split())
    parts = words[middle - 60 : middle + 30] + ["x"] + words[middle - 10 : middle + 90]
    rows = [(2, long), (1, " ".join(parts)), (3, " ".join(words[100:])), (4, "z" * 3_000_000)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert found(df) == brute(rows)
