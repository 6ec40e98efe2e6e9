"""All pairs of documents with a shingle Jaccard of 0.8 or more, as components.

Parity-sketch join. A set of shingles is dealt into parts by a hash; a part's sketch is the XOR of
its shingles' hashes. A shingle that only one of two sets has spoils one part, so sets that link
differ in at most ``(|A| + |B|) / 9`` parts, and with more parts than that at least one is equal
(pigeonhole). Sets of similar size (a band, sizes up to twice the least) share a number of parts,
and equal parts are joined by their sketch. A bit sketch of parities, whose Hamming distance is a
lower bound of the symmetric difference, drops false candidates; the rest is verified on sets.

- Equal sets are one class from the start; copies are never paired.
- A part shared by more than ``GROUP`` sets is frequent and makes no pairs. A set with enough
  other parts is still sure to meet each partner in one of them. Sets that are not (near copies
  in large numbers) are linked as candidates to one of their kind per frequent part; no pair is
  lost, and none is written out.
- Candidates form clusters; each cluster is verified by comparing sketches, then sets, of those
  not yet connected. Large clusters are split into blocks, and all pairs of blocks are compared.

Sets are named by 64-bit hashes, and shingles too; equal hashes are taken as equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stintbook.llm.components import connected
from stintbook.llm.shingles import mix, set_ids, shingle_sets
from stintbook.llm.units import stretches
from stintbook.sources.shared import keep

# Sets that share a part and are paired directly; more make the part frequent.
GROUP = 24
# Sets of a cluster that are compared in one task.
BLOCK = 2_000
# Characters of text that are worked on at a time.
STRETCH = 2_000_000
# Copies of a set are sent on once by a task, as far as it remembers.
REMEMBERED = 200_000


def most_apart(n: np.ndarray) -> np.ndarray:
    """The largest symmetric difference to a set that links with one of ``n`` shingles."""
    return (n + 5 * n // 4) // 9


def _parts_of_band(band: int) -> int:
    return 4 * (1 << band) // 5 + 8


def _bands(n: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Bands and the sets in them. A set also joins the band below if a partner can be there."""
    home = np.frexp(n)[1] - 1
    for band in range(int(home.max(initial=-1)) + 1):
        top = (1 << (band + 1)) - 1
        inside = (home == band) | ((home == band + 1) & (4 * n <= 5 * top))
        if inside.any():
            yield band, np.flatnonzero(inside)


def _sketched(
    hashes: np.ndarray, bounds: np.ndarray, sets: np.ndarray, band: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the parts of each set; the set of each key; how many frequent parts each set can
    bear. Sets that have too few parts with shingles also send their empty ones."""
    parts = _parts_of_band(band)
    sizes = (bounds[sets + 1] - bounds[sets]).astype(np.int64)
    ends = np.cumsum(sizes)
    at = np.repeat(bounds[sets] - (ends - sizes), sizes) + np.arange(ends[-1])
    own = hashes[at]
    place = np.repeat(np.arange(len(sets)), sizes) * parts
    place += (mix(own, 21) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    place = place[order]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    values = np.bitwise_xor.reduceat(mix(own[order], 22), first)
    place = place[first]
    filled = np.bincount(place // parts, minlength=len(sets))
    spare = filled - most_apart(sizes)
    thin = np.flatnonzero(spare <= 0)
    if len(thin):
        all_ = (thin[:, None] * parts + np.arange(parts)).ravel()
        empty = np.setdiff1d(all_, place, assume_unique=True)
        place = np.concatenate([place, empty])
        values = np.concatenate([values, np.zeros(len(empty), np.uint64)])
    salt = mix((place % parts).astype(np.uint64), 1000 + band)
    return mix(values ^ salt, 23), place // parts, spare


_SENT = "bucket int, hot boolean, keys binary, sets binary, counts binary, spare binary"


def _send(buckets: int, group: int):
    """Parts of each set, packed by bucket of their key."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for turn, (_, texts) in enumerate(stretches(batches, STRETCH)):
            hashes, bounds = shingle_sets(texts)
            ids = set_ids(hashes, bounds)
            _, first = np.unique(ids, return_index=True)
            fresh = np.array([i for i in first.tolist() if int(ids[i]) not in seen], np.int64)
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.update(ids[fresh].tolist())
            out: list[tuple] = []
            n = np.diff(bounds)
            for band, among in _bands(n[fresh]):
                sets = fresh[among]
                keys, of, spare = _sketched(hashes, bounds, sets, band)
                out += _packed(keys, ids[sets], of, spare, buckets, turn, group)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c, k)
                        for c, k in zip(
                            zip(*out, strict=True),
                            [pa.int32(), pa.bool_(), *[pa.binary()] * 4],
                            strict=True,
                        )
                    ],
                    names=["bucket", "hot", "keys", "sets", "counts", "spare"],
                )

    return send


def _packed(
    keys: np.ndarray,
    ids: np.ndarray,
    of: np.ndarray,
    spare: np.ndarray,
    buckets: int,
    turn: int,
    group: int,
) -> list[tuple]:
    """Rows by bucket. Of a key that is frequent here already, only as many as show that go to
    the key's own bucket; the rest is spread over all."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    sizes = np.diff([*first, len(keys)])
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys)) - np.repeat(first, sizes)
    hot = rank > group
    bucket[hot] = (mix(ids[of[hot]].view(np.uint64), 24 + turn) % np.uint64(buckets)).astype(
        np.int64
    )
    target = bucket * 2 + hot
    order = np.lexsort((of, target))
    keys, of, target = keys[order], of[order], target[order]
    cuts = np.flatnonzero(np.diff(target, prepend=-1)).tolist()
    rows = []
    for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
        own, counts = np.unique(of[a:b], return_counts=True)
        rows.append(
            (
                int(target[a]) // 2,
                bool(target[a] % 2),
                keys[a:b].tobytes(),
                ids[own].tobytes(),
                counts.astype(np.uint32).tobytes(),
                spare[own].astype(np.int32).tobytes(),
            )
        )
    return rows


# frequent: key, set and how many frequent parts the set can bear; otherwise two sets.
_MET = "frequent boolean, a bigint, b bigint, spare int"


def _meet(rows: pa.Table, group: int) -> pa.Table:
    """One bucket: pairs of sets with an equal part, and members of frequent parts."""

    def column(name: str, kind: type, hot: bool) -> np.ndarray:
        chosen = [x for x, h in zip(raw[name], raw["hot"], strict=True) if h == hot]
        return np.frombuffer(b"".join(chosen), kind)

    raw = rows.to_pydict()
    parts = {}
    for hot in (False, True):
        counts = column("counts", np.uint32, hot)
        parts[hot] = (
            column("keys", np.int64, hot),
            np.repeat(column("sets", np.int64, hot), counts),
            np.repeat(column("spare", np.int32, hot), counts),
        )
    keys, sets, spare = parts[False]
    order = np.lexsort((sets, keys))
    keys, sets, spare = keys[order], sets[order], spare[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])
    keys, sets, spare = keys[new], sets[new], spare[new]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
    sizes = np.diff([*first, len(keys)])
    size = np.repeat(sizes, sizes)
    left, right = [], []
    small = np.flatnonzero((size > 1) & (size <= group))
    k, s = keys[small], sets[small]
    for step in range(1, group):
        same = np.flatnonzero(k[step:] == k[:-step])
        if not len(same):
            break
        left.append(s[same])
        right.append(s[same + step])
    pairs = np.zeros((0, 2), np.int64)
    if left:
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
    large = np.flatnonzero(size > group)
    hot_keys, hot_sets, hot_spare = parts[True]
    a = np.concatenate([pairs[:, 0], keys[large], hot_keys])
    b = np.concatenate([pairs[:, 1], sets[large], hot_sets])
    bears = np.concatenate([np.zeros(len(pairs), np.int32), spare[large], hot_spare])
    return pa.table(
        {
            "frequent": np.arange(len(a)) >= len(pairs),
            "a": a,
            "b": b,
            "spare": bears.astype(np.int32),
        }
    )


def _bits(n: int) -> int:
    """Size of a set's bit sketch, a power of two."""
    return max(256, 1 << (2 * n - 1).bit_length()) if n else 256


def _parities(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Packed parities: how many hashes fall on each bit, odd or even."""
    counts = np.bincount((mix(hashes, 31) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in stretches(batches, STRETCH):
        hashes, bounds = shingle_sets(texts)
        sketches = [
            _parities(hashes[a:b], _bits(b - a)).tobytes()
            for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)
        ]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": rows.column("doc_id"),
                "n_shingles": pa.array(np.diff(bounds), pa.int64()),
                "set_id": pa.array(set_ids(hashes, bounds), pa.int64()),
                "sketch": pa.array(sketches, pa.binary()),
            }
        )


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches allow a link."""
    for batch in batches:
        stay = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True)
        for na, nb, sa, sb in rows:
            x, y = np.frombuffer(sa, np.uint8), np.frombuffer(sb, np.uint8)
            stay.append(_apart(x, y) <= (na + nb) // 9)
        yield batch.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """Hamming distance; a longer sketch is folded, which keeps the parities. A bit's place is
    its hash modulo the size, so halves lie on each other."""
    size = min(len(x), len(y))
    x = np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)
    y = np.bitwise_xor.reduce(y.reshape(-1, size), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _verified(rows: pa.Table) -> pa.Table:
    """Sets of one cluster (or of two blocks of it), each with the root of its component."""
    wanted = rows.column("set_id").to_numpy()
    hashes, bounds = shingle_sets([t or "" for t in rows.column("text").to_pylist()])
    # Where a doc_id repeats with other texts, only the text of the set counts, once.
    right = np.flatnonzero(set_ids(hashes, bounds) == wanted)
    ids, at = np.unique(wanted[right], return_index=True)
    at = right[at]
    sets = [hashes[bounds[i] : bounds[i + 1]] for i in at]
    n = np.array([len(s) for s in sets])
    if not len(ids):
        return pa.table({"a": ids, "b": ids})
    bits = 1024
    sketches = np.stack([_parities(s, bits) for s in sets]).view(np.uint64)
    root = np.arange(len(ids))
    for i in range(len(ids)):
        others = np.flatnonzero((root[i + 1 :] != root[i])) + i + 1
        others = others[
            (5 * np.minimum(n[others], n[i]) >= 4 * np.maximum(n[others], n[i]))
        ]
        if not len(others):
            continue
        apart = np.bitwise_count(sketches[others] ^ sketches[i]).sum(axis=1)
        for j in others[apart <= (n[others] + n[i]) // 9].tolist():
            if root[j] == root[i]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= 80 * (n[i] + n[j] - both):
                a, b = sorted((root[i], root[j]))
                root[root == b] = a
    return pa.table({"a": ids, "b": ids[root]})


def _candidates(docs: DataFrame, described: DataFrame, group: int) -> DataFrame:
    """Edges (a, b) between sets; sets that link are connected by them."""
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.select("text").mapInArrow(_send(buckets, group), _SENT)
    met = keep(sent.groupBy("bucket").applyInArrow(lambda rows: _meet(rows, group), _MET), "met")
    sets = described.filter("n_shingles > 0").groupBy("set_id").agg(
        F.first("n_shingles").alias("n"), F.first("sketch").alias("s")
    )
    sets = keep(sets, "sets")
    side = lambda x: sets.select(
        F.col("set_id").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}")
    )
    pairs = met.filter("NOT frequent").select("a", "b").distinct()
    sized = sets.select("set_id", "n")
    fitting = (
        pairs.join(sized.toDF("a", "na"), "a")
        .join(sized.toDF("b", "nb"), "b")
        .filter("5 * least(na, nb) >= 4 * greatest(na, nb)")
        .select("a", "b")
    )
    near = fitting.join(side("a"), "a").join(side("b"), "b").mapInArrow(_near, "a bigint, b bigint")
    members = keep(
        met.filter("frequent").select("a", "b", "spare").dropDuplicates(["a", "b"]), "frequent"
    )
    # A set with more rare parts than it can lose meets its partners in one of them. Others need
    # so many frequent ones, taken in one order by all sets, that two that link share one. The
    # number of spare parts tells the two bands of a set apart; where it does not, more are taken.
    own = Window.partitionBy("b", "spare")
    rest = members.withColumns(
        {"n": F.count(F.lit(1)).over(own), "k": F.row_number().over(own.orderBy("a"))}
    ).filter("n >= spare AND k <= n - spare + 1")
    leader = rest.groupBy("a").agg(F.min("b").alias("leader"))
    hung = rest.join(leader, "a").select(F.col("b").alias("a"), F.col("leader").alias("b"))
    return near.unionByName(hung.distinct())


def components(docs: DataFrame, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id.

    Two documents link when the Jaccard similarity of their sets of five-word shingles is at least
    0.8; ``group`` and ``block`` only steer the work. ``component_id`` is the smallest doc_id
    reachable by links. A text with fewer than five words has its whole sequence as one shingle;
    texts that are null or without words link with nothing. Rows that repeat a doc_id have the component of their text. Sets that only stand in
    rows without a doc_id link with nothing but themselves. Other columns are left out; an empty
    table gives an empty result.
    """
    return _found(docs, group, block).select("doc_id", "n_shingles", "component_id")


def _found(docs: DataFrame, group: int, block: int) -> DataFrame:
    """``components`` with the set_id of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    described = keep(
        texts.mapInArrow(
            _described, f"doc_id {kind}, n_shingles bigint, set_id bigint, sketch binary"
        ),
        "described",
    )
    clusters = keep(connected(_candidates(texts, described, group)), "clusters")
    # One text for each set of a cluster.
    first = described.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    sizes = clusters.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    mine = F.pmod(F.xxhash64("set_id"), F.col("blocks"))
    blocks = (
        clusters.withColumnRenamed("node", "set_id")
        .join(sizes, "root")
        .withColumn("own", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .select(
            "set_id", "root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")
        )
        .join(first, "set_id")
    )
    links = (
        blocks.join(texts, "doc_id")
        .select("root", "x", "y", "set_id", "text")
        .groupBy("root", "x", "y")
        .applyInArrow(_verified, "a bigint, b bigint")
    )
    roots = connected(links)
    found = described.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    lone = F.when(F.col("n_shingles") == 0, F.struct(F.lit(1), F.col("doc_id").cast("string")))
    group = F.coalesce(
        lone, F.struct(F.lit(0), F.coalesce("root", "set_id").cast("string"))
    )
    found = keep(found.select("doc_id", "n_shingles", "set_id", group.alias("g")), "found")
    least = found.groupBy("g").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "g").select("doc_id", "n_shingles", "set_id", "component_id")


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in stretches(batches, STRETCH):
        ids = set_ids(*shingle_sets(texts))
        yield rows.append_column("set_id", pa.array(ids, pa.int64()))


def _in_sets(docs: DataFrame) -> DataFrame:
    """The rows as a struct ``row``, with ``id`` and ``set_id`` beside it."""
    # Any name may be taken, so all columns but the text go by their place.
    named = {c: "text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()])
    schema = T.StructType([*plain.schema.fields, T.StructField("set_id", T.LongType())])
    whole = F.struct(*[F.col(n).alias(c) for c, n in named.items()])
    rows = plain.mapInArrow(_with_sets, schema)
    return rows.select(whole.alias("row"), F.col(named["doc_id"]).alias("id"), "set_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, of each component only the smallest doc_id.

    A doc_id that stands for one set names one document: rows that repeat it stay or go together.
    Where a doc_id has texts of several sets, each is decided by its own component. Rows without a
    doc_id go where their set stands in a row with a doc_id, else one row of each set stays, the
    one with the smallest text. Their texts without words all stay, as they link with nothing. As
    in ``components``, sets that only stand in such rows have no near copies. Columns may have any
    name.
    """
    found = keep(_found(docs, GROUP, BLOCK), "classes")
    real = found.filter("doc_id IS NOT NULL")
    first = real.filter("doc_id = component_id").select("doc_id", "set_id").distinct()
    several = (
        real.groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b"))
        .filter("a <> b")
        .select("doc_id")
    )
    several = keep(several, "several")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    plain = first.select("doc_id").distinct().join(several, "doc_id", "left_anti")
    named = docs.join(plain, "doc_id", "left_semi").select(*columns)
    # Only rows that doc_ids don't decide are hashed again.
    unclear = _in_sets(
        docs.join(several, "doc_id", "left_semi").select(*columns).unionByName(
            docs.filter("doc_id IS NULL")
        )
    )
    mine = (F.col("id") == F.col("doc_id")) & (F.col("own_set") == F.col("set_id"))
    kept = first.withColumnRenamed("set_id", "own_set")
    each = unclear.filter("id IS NOT NULL").join(kept, mine, "left_semi").select("row.*")
    nameless = unclear.filter("id IS NULL")
    elsewhere = real.select("set_id").distinct()
    # Texts without words have the number 0.
    single = (
        nameless.filter("set_id <> 0")
        .join(elsewhere, "set_id", "left_anti")
        .groupBy("set_id")
        .agg(F.min_by("row", "row.text").alias("row"))
        .select("row.*")
    )
    empty = nameless.filter("set_id = 0").select("row.*")
    return named.unionByName(each).unionByName(single).unionByName(empty)
