"""Hard negatives by a multiway hyperplane tree with distance ranges (after GNAT).

Components are whole numbers, ``floor(256 * x)``, and a row's score is its inner product with the
anchor. Every vector gets one more component so that all have the same length; an anchor gets a
zero there. Then a score is a distance, and a window of scores is an annulus around the anchor.

1. The upper part of the tree is fitted on ``SAMPLE`` rows, the least by a hash: each node has up
   to ``FAN`` split points, and a row goes to the child of the nearest one. All rows are routed,
   and for each pair of split points the least and largest distance of the one to the rows under
   the other is found over all rows. The cells at its ends, cut into chunks of bounded size where
   they are large, are the groups that Spark deals out.
2. A task goes on with the tree below for the rows of its chunk, down to leaves that are scanned
   exactly. Both parts leave out a child when, for some sibling's split point, no row at its range
   of distances can lie in the annulus.
3. Positives: an anchor first looks in its own cell; what it finds there bounds the annulus for all
   others. Negatives: one annulus for each positive. Every chunk returns the few best per window,
   and the best of these are the result, so it is exact whatever the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintbook.sources.shared import keep

# Rows the upper part of the tree is fitted on, and split points of a node.
SAMPLE, FAN = 4_096, 16
# Rows of a cell of the sample, and of a leaf, that are not split further.
LEAF = 96
# Rows of a chunk and windows that meet in one task; windows, and rows of a leaf, at a time.
CHUNK, BATCH, AT_ONCE, SCAN = 32_768, 65_536, 2_048, 512
# Rounding, as a share of the largest length.
SLACK = 1e-6


class Space:
    """Distances between rows, and from anchors to rows."""

    def __init__(self, dim: int, peak: int, longest: float) -> None:
        # Sums of products that doubles hold exactly.
        self.exact = dim * peak * peak < 1 << 53
        self.square = longest * (1 + 1e-9)
        self.slack = SLACK * math.sqrt(self.square) + 1e-9

    def points(self, rows: np.ndarray) -> np.ndarray:
        """Rows with the component that gives all the same length."""
        rows = rows.astype(np.float64)
        rest = np.maximum(self.square - np.einsum("ij,ij->i", rows, rows), 0)
        return np.hstack([rows, np.sqrt(rest)[:, None]])

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 * (self.square - a @ b.T), 0))

    def from_anchors(self, anchors: np.ndarray, points: np.ndarray) -> np.ndarray:
        own = np.einsum("ij,ij->i", anchors, anchors)[:, None]
        return np.sqrt(np.maximum(own + self.square - 2 * (anchors @ points[:, :-1].T), 0))

    def radius(self, anchors: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distance at which a row has the score."""
        own = np.einsum("ij,ij->i", anchors, anchors)
        return np.sqrt(np.maximum(own + self.square - 2 * scores, 0))

    def scores(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.exact:
            return (anchors.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
        # Beyond 64 bits this raises.
        return (anchors.astype(object) @ rows.T.astype(object)).astype(np.int64)


class Node:
    """Split points, what lies under each, and their ranges of distances to it."""

    def __init__(self, space: Space, points: np.ndarray) -> None:
        self.points = points
        n = len(points)
        self.low, self.high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
        self.children: list[Node | np.ndarray | int] = []

    def route(self, space: Space, points: np.ndarray, note: bool = True) -> np.ndarray:
        """The child of each point; ``note`` widens the ranges by them."""
        apart = space.between(points, self.points)
        child = apart.argmin(axis=1)
        for j in np.unique(child) if note else ():
            own = apart[child == j]
            self.low[:, j] = np.minimum(self.low[:, j], own.min(axis=0))
            self.high[:, j] = np.maximum(self.high[:, j], own.max(axis=0))
        return child

    def open(self, space: Space, anchors: np.ndarray, near: np.ndarray, far: np.ndarray):
        """For each window and child, whether a row in the annulus can lie there."""
        d = space.from_anchors(anchors, self.points)
        least = np.zeros((len(d), len(self.points)))
        most = np.full((len(d), len(self.points)), np.inf)
        for i in range(len(self.points)):
            own = d[:, i, None]
            least = np.maximum(least, np.maximum(self.low[i] - own, own - self.high[i]))
            most = np.minimum(most, own + self.high[i])
        return (least <= far[:, None] + space.slack) & (most >= near[:, None] - space.slack)


def _split_points(space: Space, points: np.ndarray) -> np.ndarray:
    """Up to FAN points that are far from each other, from a few evenly spaced ones."""
    few = points[np.linspace(0, len(points) - 1, min(len(points), 4 * FAN)).astype(int)]
    chosen, apart = [0], space.between(few[:1], few)[0]
    while len(chosen) < min(FAN, len(few)):
        k = int(apart.argmax())
        if apart[k] <= space.slack:
            break
        chosen.append(k)
        apart = np.minimum(apart, space.between(few[k : k + 1], few)[0])
    return few[chosen]


def grow(space: Space, points: np.ndarray, members: np.ndarray) -> Node | np.ndarray:
    """The tree over some of the points; its leaves are their numbers. Points that can't be told
    apart stay in one leaf."""
    if len(members) <= LEAF:
        return members
    node = Node(space, _split_points(space, points[members]))
    if len(node.points) < 2:
        return members
    child = node.route(space, points[members])
    node.children = [grow(space, points, members[child == j]) for j in range(len(node.points))]
    return node


class Upper:
    """The upper part of the tree. Its nodes and cells are numbered."""

    def __init__(self, space: Space, sample: np.ndarray) -> None:
        self.space, self.nodes, self.cells = space, [], 0
        points = space.points(sample)
        self.root = self._number(grow(space, points, np.arange(len(points))))

    def _number(self, x: Node | np.ndarray) -> Node | int:
        if not isinstance(x, Node):
            self.cells += 1
            return self.cells - 1
        self.nodes.append(x)
        x.low[:], x.high[:] = np.inf, -np.inf
        x.children = [self._number(c) for c in x.children]
        return x

    def cells_of(self, rows: np.ndarray, note: bool = False) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        open_ = [(self.root, np.arange(len(rows)))]
        points = self.space.points(rows)
        while open_:
            node, at = open_.pop()
            if not isinstance(node, Node):
                out[at] = node
                continue
            child = node.route(self.space, points[at], note)
            open_ += [(node.children[j], at[child == j]) for j in np.unique(child)]
        return out

    def ranges(self) -> Iterator[tuple[int, int, int, float, float]]:
        for k, node in enumerate(self.nodes):
            for i, j in zip(*np.nonzero(node.high >= node.low), strict=True):
                yield k, int(i), int(j), float(node.low[i, j]), float(node.high[i, j])

    def reached(self, anchors: np.ndarray, near: np.ndarray, far: np.ndarray):
        """Windows and the cells they reach."""
        open_, found = [(self.root, np.arange(len(anchors)))], []
        while open_:
            node, at = open_.pop()
            if not isinstance(node, Node):
                found.append((at, np.full(len(at), node)))
                continue
            reach = node.open(self.space, anchors[at], near[at], far[at])
            open_ += [(c, at[reach[:, j]]) for j, c in enumerate(node.children) if reach[:, j].any()]
        return [np.concatenate(x) for x in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 2


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 0), np.int64)


class _Best:
    """The first few rows of each window: higher scores first, then smaller ids."""

    def __init__(self, windows: int, few: int) -> None:
        self.ids = np.zeros((windows, few), np.int64)
        self.scores = np.zeros((windows, few), np.int64)
        self.filled = np.zeros((windows, few), bool)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray, fits: np.ndarray) -> None:
        few = self.ids.shape[1]
        all_ids = np.hstack([self.ids[at], np.broadcast_to(ids, scores.shape)])
        all_scores = np.hstack([self.scores[at], scores])
        filled = np.hstack([self.filled[at], fits])
        order = np.lexsort((all_ids, -all_scores, ~filled), axis=1)[:, :few]
        for mine, new in ((self.ids, all_ids), (self.scores, all_scores), (self.filled, filled)):
            mine[at] = np.take_along_axis(new, order, axis=1)


def _search(space: Space, few: int):
    """The best rows of a chunk for each window."""

    def search(key: tuple, rows: pa.Table, windows: pa.Table) -> pa.Table:
        empty = pa.table({n: pa.array([], pa.int64()) for n in ("q", "vec_id", "score")})
        if not rows.num_rows or not windows.num_rows:
            return empty
        vectors, ids = _matrix(rows.column("point")), rows.column("vec_id").to_numpy()
        own = rows.column("label").to_pylist()
        wanted = windows.column("label").to_pylist()
        code = {x: i for i, x in enumerate(dict.fromkeys([*own, *wanted]))}
        own = np.array([code[x] for x in own])
        wanted = np.array([code[x] for x in wanted])
        anchors, mine = _matrix(windows.column("point")), windows.column("vec_id").to_numpy()
        same = windows.column("same").to_numpy(zero_copy_only=False)
        least, most = (windows.column(c).to_numpy().copy() for c in ("least", "most"))
        points = space.points(vectors)
        tree = grow(space, points, np.arange(len(points)))
        best = _Best(len(anchors), few)
        real = anchors.astype(np.float64)
        # Neighbours in the order of their first component reach much the same leaves.
        for a in range(0, len(anchors), AT_ONCE):
            part = np.arange(a, min(a + AT_ONCE, len(anchors)))
            open_ = [(tree, part)]
            while open_:
                node, at = open_.pop()
                if isinstance(node, Node):
                    near = space.radius(real[at], most[at].astype(np.float64))
                    far = space.radius(real[at], least[at].astype(np.float64))
                    reach = node.open(space, real[at], near, far)
                    open_ += [
                        (c, at[reach[:, j]])
                        for j, c in enumerate(node.children)
                        if reach[:, j].any()
                    ]
                    continue
                for b in range(0, len(node), SCAN):
                    leaf = node[b : b + SCAN]
                    scores = space.scores(anchors[at], vectors[leaf])
                    fits = (scores >= least[at, None]) & (scores <= most[at, None])
                    alike = own[leaf] == wanted[at, None]
                    other = ids[leaf] != mine[at, None]
                    fits &= np.where(same[at, None], alike & other, ~alike)
                    hit = fits.any(axis=1)
                    if not hit.any():
                        continue
                    best.add(at[hit], ids[leaf], scores[hit], fits[hit])
                    full = at[hit][best.filled[at[hit], -1]]
                    least[full] = np.maximum(least[full], best.scores[full, -1])
        at, place = np.nonzero(best.filled)
        return pa.table(
            {
                "q": windows.column("q").to_numpy()[at],
                "vec_id": best.ids[at, place],
                "score": best.scores[at, place],
            }
        )

    return search


class Index:
    """All rows under the tree, and searches in it."""

    def __init__(self, rows: DataFrame, space: Space, chunk: int, batch: int) -> None:
        self.spark: SparkSession = rows.sparkSession
        self.space, self._batch = space, batch
        first = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label").limit(SAMPLE)
        upper = Upper(space, np.array([r.point for r in first.select("point").collect()]))
        fitted = self.spark.sparkContext.broadcast(upper)

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                cell = fitted.value.cells_of(_matrix(part.column("point")))
                yield part.append_column("cell", pa.array(cell, pa.int64()))

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                fitted.value.cells_of(_matrix(part.column("point")), note=True)
            names = ["node", "i", "j", "low", "high"]
            found = list(zip(*fitted.value.ranges(), strict=True)) or [()] * len(names)
            kinds = [pa.int64()] * 3 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(found, kinds, strict=True)], names=names
            )

        schema = "row bigint, vec_id bigint, label string, point array<bigint>, cell bigint"
        rows = keep(rows.mapInArrow(routed, schema), "routed")
        # As many numbers as the tree has pairs of split points, and cells: bounded by SAMPLE.
        widest = (
            rows.mapInArrow(ranges, "node bigint, i bigint, j bigint, low double, high double")
            .groupBy("node", "i", "j")
            .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        )
        for r in widest.collect():
            node = upper.nodes[r.node]
            node.low[r.i, r.j], node.high[r.i, r.j] = r.low, r.high
        sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("chunks")).collect()
        self._chunks = np.zeros(upper.cells, np.int64)
        for r in sizes:
            self._chunks[r.cell] = r.chunks
        self._upper = self.spark.sparkContext.broadcast(upper)
        cells = self.spark.createDataFrame(
            [(k, int(n)) for k, n in enumerate(self._chunks)], "cell bigint, chunks bigint"
        )
        mine = F.pmod(F.xxhash64("row"), F.col("chunks"))
        self.rows = rows.join(F.broadcast(cells), "cell").withColumn("chunk", mine)

    def search(self, windows: DataFrame, few: int, home: bool | None = None) -> DataFrame:
        """The first ``few`` rows (q, vec_id, score) of each window (q, vec_id, label, point, home,
        same, least, most) in each chunk. ``home``: only in the anchor's own cell, or only
        elsewhere."""
        upper, chunks, space = self._upper, self._chunks, self.space
        batches = max(1, -(-windows.count() // self._batch))

        def sent(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for a in range(0, part.num_rows, AT_ONCE):
                    yield from deal(part.slice(a, AT_ONCE))

        def deal(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            anchors = _matrix(part.column("point")).astype(np.float64)
            own = part.column("home").to_numpy()
            if home:
                at, cell = np.arange(len(own)), own
            else:
                least, most = (part.column(c).to_numpy().astype(float) for c in ("least", "most"))
                at, cell = upper.value.reached(
                    anchors, space.radius(anchors, most), space.radius(anchors, least)
                )
                if home is not None:
                    at, cell = at[cell != own[at]], cell[cell != own[at]]
            times = chunks[cell]
            ends = np.cumsum(times)
            chunk = np.arange(times.sum()) - np.repeat(ends - times, times)
            at, cell = np.repeat(at, times), np.repeat(cell, times)
            out = part.take(pa.array(at)).append_column("cell", pa.array(cell))
            yield out.append_column("chunk", pa.array(chunk))

        names = [f.simpleString().replace(":", " ", 1) for f in windows.schema]
        dealt = windows.mapInArrow(sent, ", ".join([*names, "cell bigint", "chunk bigint"]))
        dealt = dealt.withColumn("batch", F.pmod(F.xxhash64("q"), F.lit(batches)))
        rows = self.rows.select("cell", "chunk", "vec_id", "label", "point")
        rows = rows.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
        rows = rows.withColumn("batch", F.col("batch").cast("bigint"))
        by = ["cell", "chunk", "batch"]
        return (
            rows.groupBy(*by)
            .cogroup(dealt.groupBy(*by))
            .applyInArrow(_search(space, few), "q bigint, vec_id bigint, score bigint")
        )


def _first(found: DataFrame, few: int) -> DataFrame:
    """The first rows of each window over all chunks, numbered by ``rank``."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= few)


# Scores no row is under or over; kept within what a double tells apart.
_NONE = 1 << 62


def _clean(rows: DataFrame) -> DataFrame:
    finite = lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    return (
        rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
        .filter(F.forall("embedding", finite))
        .select(
            F.col("vec_id").cast("bigint").alias("vec_id"),
            F.col("label").cast("string").alias("label"),
            whole.alias("point"),
        )
        .distinct()
    )


_RESULT = (
    "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
    "negative_score bigint"
)


def mine(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    least: int = 80,
    most: int = 100,
    chunk: int = CHUNK,
    batch: int = BATCH,
) -> DataFrame:
    """Per anchor and positive the first negatives: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    ``rows``: vec_id, label, embedding; ``anchors`` is a condition on vec_id. Positives are the
    anchor's first rows of its label with another vec_id; negatives are rows of other labels whose
    score is from ``least`` to ``most`` percent of the positive's. Higher scores come first, ties
    by vec_id. ``chunk`` and ``batch`` only steer the work.

    Rows without a vec_id, a label or a vector, or with a component that is null or not finite,
    take no part. Equal rows (vec_id, label, vector) count once; rows that share a vec_id only are
    rows of their own. Shorter vectors are filled up with zeros. Scores beyond 64 bits raise.
    Other columns are left out; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    clean = _clean(rows).withColumn("row", F.monotonically_increasing_id())
    clean = keep(clean.select("row", "vec_id", "label", "point"), "vectors")
    peak = F.array_max(F.transform("point", lambda x: F.abs(x)))
    square = F.aggregate("point", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    sizes = clean.agg(
        F.max(F.size("point")).alias("dim"), F.max(peak).alias("peak"), F.max(square).alias("square")
    ).first()
    if sizes.dim is None:
        return spark.createDataFrame([], _RESULT)
    dim = max(sizes.dim, 1)
    missing = F.array_repeat(F.lit(0).cast("bigint"), F.lit(dim) - F.size("point"))
    clean = clean.withColumn("point", F.concat("point", missing))
    index = Index(clean, Space(dim, sizes.peak or 0, max(sizes.square, 1.0)), chunk, batch)

    asked = index.rows.filter(anchors).select(
        F.col("row").alias("q"), "vec_id", "label", "point", F.col("cell").alias("home")
    )
    none = F.lit(_NONE).cast("bigint")
    window = lambda df, same, low, high: df.select(
        "q", "vec_id", "label", "point", "home", F.lit(same).alias("same"), low.alias("least"),
        high.alias("most"),
    )
    near = keep(_first(index.search(window(asked, True, -none, none), positives, True), positives), "near")
    bound = near.filter(F.col("rank") == positives).select("q", F.col("score").alias("bound"))
    further = asked.join(bound, "q", "left")
    further = window(further, True, F.coalesce("bound", -none), none)
    found = near.drop("rank").unionByName(index.search(further, positives, False))
    pairs = keep(
        _first(found, positives).select(
            F.col("q").alias("anchor_row"),
            (F.col("q") * positives + F.col("rank") - 1).alias("q"),
            F.col("vec_id").alias("positive_id"),
            F.col("score").alias("positive_score"),
        ),
        "positives",
    )
    # Whole numbers of the window: rounded up, and down.
    down = lambda x: f"({x} - pmod({x}, 100)) div 100"
    low, high = f"(-{least} * positive_score)", f"({most} * positive_score)"
    windows = asked.withColumnRenamed("q", "anchor_row").join(pairs, "anchor_row")
    windows = windows.withColumns({"low": F.expr(f"-({down(low)})"), "high": F.expr(down(high))})
    windows = window(windows.filter("low <= high"), False, F.col("low"), F.col("high"))
    best = _first(index.search(windows, negatives), negatives)
    named = asked.select(F.col("q").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    return (
        best.select("q", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(pairs, "q")
        .join(named, "anchor_row")
        .select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int").alias("rank"),
            "negative_id",
            "positive_score",
            "negative_score",
        )
    )
