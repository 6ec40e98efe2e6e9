"""Hard negatives against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from stintbook.llm import hard_negatives

SCHEMA = "vec_id bigint, label int, embedding array<float>, score bigint, cell string"


def brute(rows: list[tuple], every: int, few: int = 5) -> list[tuple]:
    whole = {
        (i, lab, tuple(math.floor(256 * x) for x in v))
        for i, lab, v, *_ in rows
        if i is not None and lab is not None and v is not None
        and all(x is not None and math.isfinite(x) for x in v)
    }
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, lab, v in whole:
        if i % every:
            continue
        order = sorted((-dot(v, w), j, o) for j, o, w in whole)
        for p, j, o in [x for x in order if x[2] == lab and x[1] != i][:few]:
            fits = [x for x in order if x[2] != lab and 80 * -p <= 100 * -x[0] <= 100 * -p]
            out += [(i, j, k + 1, x[1], -p, -x[0]) for k, x in enumerate(fits[:few])]
    return sorted(out)


def clustered(rng: random.Random, size: int, dim: int, copies: int) -> list[tuple]:
    """Vectors in clusters that labels cut across, and many copies of one vector."""
    around = [[rng.uniform(-0.4, 0.4) for _ in range(dim)] for _ in range(8)]
    rows = []
    for i in range(size):
        v = [x + rng.gauss(0, 0.05) for x in rng.choice(around)]
        rows.append((i, rng.randrange(3), v, 7, "x"))
    hot = [0.25] * dim
    rows += [(size + i, i % 2, hot, 7, "x") for i in range(copies)]
    return rows


@pytest.mark.parametrize("chunk,batch", [(32_768, 65_536), (100, 7)])
def test_equal_brute_force(spark, chunk, batch):
    rng = random.Random(chunk)
    rows = clustered(rng, 600, 12, 300)
    rows += [
        (2000, None, rows[0][2], 1, "n"), (2001, 1, None, 1, "n"), (None, 1, rows[0][2], 1, "n"),
        (2010, 1, [float("nan")] * 12, 1, "n"), (2020, 1, [float("inf")] * 12, 1, "n"),
        (2030, 1, [None] * 12, 1, "n"), (2040, 1, [], 1, "n"), (2050, 2, [0.0] * 12, 1, "n"),
        (2060, 2, [0.5] * 3, 1, "n"), rows[10], rows[20], (20, 2, rows[30][2], 1, "same id"),
    ]
    found = hard_negatives.mine(
        spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, chunk=chunk, batch=batch
    )
    as_float = spark.createDataFrame(rows, SCHEMA).collect()
    expected = brute([tuple(r) for r in as_float], 10)
    assert sorted(map(tuple, found.collect())) == expected and len(expected) > 500


def test_cells_are_left_out(spark):
    """Far clusters are not looked at, and the answer stays the same."""
    rng = random.Random(2)
    rows = clustered(rng, 900, 3, 0)
    tree = hard_negatives.Upper(hard_negatives.Space(3, 200, 60_000.0), _whole(rows))
    tree.cells_of(_whole(rows), note=True)
    anchors = _whole(rows)[:50].astype(float)
    far = tree.space.radius(anchors, (anchors**2).sum(axis=1) * 0.98)
    near = tree.space.radius(anchors, (anchors**2).sum(axis=1) * 1.02)
    at, _ = tree.reached(anchors, near, far)
    assert tree.cells > 8 and len(at) < 0.7 * 50 * tree.cells
    found = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0)
    as_float = spark.createDataFrame(rows, SCHEMA).collect()
    assert sorted(map(tuple, found.collect())) == brute([tuple(r) for r in as_float], 50)


def _whole(rows):
    return hard_negatives.np.array([[math.floor(256 * x) for x in r[2]] for r in rows])


def test_large_numbers_and_empty(spark):
    rows = [(i, i % 2, [3e4 * i, -1e5, 2.0 * i], 0, "x") for i in range(40)]
    found = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    as_float = spark.createDataFrame(rows, SCHEMA).collect()
    assert sorted(map(tuple, found.collect())) == brute([tuple(r) for r in as_float], 10)
    empty = hard_negatives.mine(spark.createDataFrame([], SCHEMA), F.lit(True))
    assert empty.collect() == [] and empty.columns == found.columns
    lone = spark.createDataFrame(rows[:1], SCHEMA)
    assert hard_negatives.mine(lone, F.lit(True)).collect() == []
