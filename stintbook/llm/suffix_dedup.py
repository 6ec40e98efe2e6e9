"""Removal of repeated byte strings by suffix arrays.

Each byte goes that is covered by a 50-byte string which also starts in a document with a smaller
doc_id. Strings are judged on the input, and never reach over documents.

1. Documents lie in blocks (a table bucketed by block, so that no later step moves the texts).
2. Each 50-byte window is named by the smallest hash of its 20-byte strings. Neighbouring windows
   mostly share that name, and equal windows always do. Windows whose name occurs in one document
   only can't repeat; for the others, the bytes under each run of windows of one name are sent to
   the bucket of the name. So equal windows meet, and nothing else needs to be sorted.
3. A bucket is cut into shards of bounded size, by name, so that equal windows meet in one shard; a
   name with more bytes than that has several. Each shard is indexed by a suffix array, built by
   doubling (Larsson and Sadakane): suffixes are ranked by their first 8 bytes, then unsorted
   groups are refined by the ranks 8, 16 and 32 bytes further on. Common prefixes of neighbours
   follow by Kasai's rule, and windows with 50 bytes in common form a class. Shards of one name are
   merged range by range, found by binary search, as runs of their sorted windows.
4. The smallest document of each class goes back to the blocks, which cut their texts.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintbook.llm.shingles import mix
from stintbook.llm.units import ranges
from stintbook.sources.shared import keep, keep_bucketed

WINDOW, GRAM = 50, 20
# Bytes in a shard, and windows that are merged at a time.
SHARD, RANGE = 1 << 20, 200_000
# Bytes of text in a block, as far as there may be so many blocks.
BLOCK, MOST_BLOCKS = 16 << 20, 20_000
# Bytes of text that are named at a time; few enough for the processor's cache.
STRETCH = 100_000
# The part of a name that goes with a piece. Where two names share it, they are sorted together.
_TAG = (1 << 32) - 1
# Rows without a doc_id count as the largest.
LAST = np.iinfo(np.int64).max

_VALUES = np.random.default_rng(3).integers(1, 1 << 63, 256, np.uint64)
_STEP = 0x9E3779B97F4A7C15


def names(text: np.ndarray) -> np.ndarray:
    """For each window of the text, the smallest hash of its 20-byte strings."""
    power = lambda k: np.uint64(pow(_STEP, k, 1 << 64))
    one = _VALUES[text]
    two = one[:-1] * power(1) + one[1:]
    four = two[:-2] * power(2) + two[2:]
    eight = four[:-4] * power(4) + four[4:]
    sixteen = eight[:-8] * power(8) + eight[8:]
    least = mix(sixteen[:-4] * power(4) + four[16:])
    # Minimum over the 31 strings of a window, by doubling.
    for k in (1, 2, 4, 8, 15):
        least = np.minimum(least[:-k], least[k:])
    return least


def _runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of one name: text, first window, windows, and the name."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    sizes = np.array([len(t) for t in texts], np.int64)
    part = (np.cumsum(sizes) - sizes) // STRETCH
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        if len(data) < WINDOW:
            continue
        name = names(data)
        ends = np.cumsum(sizes[a:b])
        owner = np.repeat(np.arange(a, b), sizes[a:b])[: len(name)]
        # Windows that reach into the next text are none.
        whole = ends[owner - a] - np.arange(len(name)) >= WINDOW
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1]) | ~whole[:-1]
        first = np.flatnonzero(new & whole)
        # Within a text, windows that are whole come first, so a run ends with them.
        stop = np.append(np.flatnonzero(new | ~whole), len(name))
        length = stop[np.searchsorted(stop, first, side="right")] - first
        begin = ends[owner[first] - a] - sizes[owner[first]]
        for x, y in zip(out, (owner[first], first - begin, length, name[first]), strict=True):
            x.append(y)
    kinds = (np.int64, np.int64, np.int64, np.uint64)
    return tuple(np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds))


class _Block:
    """The documents of a block; equal texts are looked at once, for the smallest doc_id."""

    def __init__(self, rows: pa.Table) -> None:
        ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
        if ids.dtype.kind == "f":
            ids = pc.fill_null(rows.column("doc_id"), LAST).to_numpy()
        order = np.argsort(ids, kind="stable")
        texts = rows.column("text").to_pylist()
        self.ids = ids[order].astype(np.int64)
        self.texts = [(texts[i] or "").encode() for i in order]
        self.first: dict[bytes, int] = {}
        for i, text in enumerate(self.texts):
            self.first.setdefault(text, i)
        self.own = sorted(self.first.values())

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        owner, first, length, name = _runs([self.texts[i] for i in self.own])
        return np.array(self.own, np.int64)[owner], first, length, name

    def pieces(self, shared: np.ndarray) -> Iterator[tuple[int, int, bytes, int]]:
        """Document, first window, bytes under the run, and name, of runs with a shared name."""
        owner, first, length, name = self.runs()
        if not len(shared) or not len(name):
            return
        at = np.minimum(np.searchsorted(shared, name), len(shared) - 1)
        chosen = shared[at] == name
        for i, a, n, x in zip(
            owner[chosen].tolist(), first[chosen].tolist(), length[chosen].tolist(),
            name[chosen].tolist(), strict=True,
        ):
            yield i, a, self.texts[i][a : a + n + WINDOW - 1], x


_NAMES = "bucket int, block int, names binary, several binary"


def _name(buckets: int):
    """Names in each block, and whether more than one document of the block has them."""

    def name(key: tuple, rows: pa.Table) -> pa.Table:
        block = _Block(rows)
        owner, _, _, found = block.runs()
        order = np.lexsort((owner, found))
        owner, found = owner[order], found[order]
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        first = first[: len(found)]
        last = np.append(first[1:], len(found)) - 1
        several = owner[first] != owner[last] if len(found) else np.zeros(0, bool)
        found = found[first]
        bucket = (mix(found, 41) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, found, several = bucket[order], found[order], several[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        # A block of short texts has none.
        spans = list(zip(cuts, [*cuts[1:], len(bucket)][: len(cuts)], strict=True))
        return pa.table(
            {
                "bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int32()),
                "block": pa.array([key[0].as_py()] * len(spans), pa.int32()),
                "names": pa.array([found[a:b].tobytes() for a, b in spans], pa.binary()),
                "several": pa.array([several[a:b].tobytes() for a, b in spans], pa.binary()),
            }
        )

    return name


def _share(rows: pa.Table) -> pa.Table:
    """One bucket: for each block, its names that occur in another document too."""
    blocks = rows.column("block").to_pylist()
    each = [np.frombuffer(x, np.uint64) for x in rows.column("names").to_pylist()]
    found = np.concatenate(each)
    several = np.frombuffer(b"".join(rows.column("several").to_pylist()), bool)
    _, back, count = np.unique(found, return_inverse=True, return_counts=True)
    times = count[back] > 1
    shared = times | several
    cuts = np.cumsum([0, *map(len, each)])
    names_ = [x[shared[a:b]].tobytes() for x, a, b in zip(each, cuts, cuts[1:], strict=False)]
    stay = [i for i, x in enumerate(names_) if x]
    return pa.table(
        {
            "block": pa.array([blocks[i] for i in stay], pa.int32()),
            "names": pa.array([names_[i] for i in stay], pa.binary()),
        }
    )


_PIECES = "bucket int, block int, sizes binary, bytes binary, ids binary, tags binary"


def _send(buckets: int):
    """Distinct pieces of a block under shared names, each with its smallest document."""

    def send(rows: pa.Table, shared: pa.Table) -> pa.Table:
        out: dict[int, dict[bytes, tuple[int, int]]] = {}
        if rows.num_rows and shared.num_rows:
            block = _Block(rows)
            ids = block.ids.tolist()
            for i, _, piece, name in block.pieces(_sorted_names(shared)):
                # Documents come by rising doc_id.
                own = out.setdefault((name >> 20) % buckets, {})
                if piece not in own:
                    own[piece] = ids[i], name & _TAG
        number = shared.column("block")[0].as_py() if out else 0
        pack = lambda x, kind: np.fromiter(x, kind).tobytes()
        return pa.table(
            {
                "bucket": pa.array(list(out), pa.int32()),
                "block": pa.array([number] * len(out), pa.int32()),
                "sizes": pa.array([pack(map(len, p), np.int32) for p in out.values()], pa.binary()),
                "bytes": pa.array([b"".join(p) for p in out.values()], pa.binary()),
                "ids": pa.array([pack((i for i, _ in p.values()), np.int64) for p in out.values()], pa.binary()),
                "tags": pa.array([pack((t for _, t in p.values()), np.uint32) for p in out.values()], pa.binary()),
            }
        )

    return send


def _sorted_names(shared: pa.Table) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(shared.column("names").to_pylist()), np.uint64))


def eights(text: np.ndarray) -> np.ndarray:
    """The next 8 bytes at each place as a number; zeros beyond the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[:-1].copy().view(">u8")[:, 0].astype(
        np.uint64
    )


def suffix_array(key: np.ndarray) -> np.ndarray:
    """Suffixes in the order of their first 64 bytes, by doubling, from ``eights``."""
    n = len(key)
    order = np.argsort(key)
    key = key[order]
    first = np.ones(n, bool)
    first[1:] = key[1:] != key[:-1]
    # A suffix's rank is the place of the first of its group; beyond the end it is -1.
    rank = np.full(n + 64, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    for step in (8, 16, 32):
        alone = first & np.append(first[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        at = order[open_]
        # The group first, so groups keep their places and never mix.
        both = rank[at] * (n + 1) + rank[at + step] + 1
        turn = np.argsort(both)
        at, both = at[turn], both[turn]
        order[open_] = at
        new = np.ones(len(at), bool)
        new[1:] = both[1:] != both[:-1]
        first[open_] = new
        rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    return order


def common_prefixes(text: np.ndarray, key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place in ``order``, the bytes in common with the place before (at most 64 count).

    Kasai: one suffix further on in the text, the common prefix is one shorter, as long as both
    neighbours are preceded by the same byte. So only the others are compared, by 8 bytes each.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    known = (before > 0) & (place > 0)
    known[known] = text[place[known] - 1] == text[before[known] - 1]
    # The neighbour of the suffix before must also be the suffix before the neighbour.
    known[1:] &= before[1:] == before[:-1] + 1
    todo = np.flatnonzero(~known & (before >= 0))
    size = np.zeros(n, np.int64)
    x, y = todo, before[todo]
    while len(x):
        differ = key[x] ^ key[y]
        more = differ == 0
        step = np.full(len(x), 8, np.int64)
        for k in range(8):
            step -= differ >> np.uint64(8 * k) != 0
        size[todo] += step
        todo, x, y = todo[more], x[more] + 8, y[more] + 8
        inside = np.maximum(x, y) < n
        todo, x, y = todo[inside], x[inside], y[inside]
    # Zeros beyond the end are no bytes in common.
    size = np.minimum(size, n - np.maximum(place, before))
    # A run of known ones counts down from the one before it.
    start = np.maximum.accumulate(np.where(known, 0, place))
    size = np.where(known, size[start] - (place - start), size)
    return np.minimum(size, 64)[order]


class _Shard:
    """Distinct pieces with their suffix array."""

    def __init__(self, pieces: list[bytes], ids: list[int]) -> None:
        self.text = np.frombuffer(b"".join(pieces), np.uint8)
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        windows = self.sizes - WINDOW + 1
        begin = np.cumsum(self.sizes) - self.sizes
        key = eights(self.text)
        order = suffix_array(key)
        common = common_prefixes(self.text, key, order)
        # Places that begin a window.
        self.is_window = is_window = np.arange(len(self.text)) - np.repeat(begin, self.sizes) < np.repeat(
            windows, self.sizes
        )
        doc = np.where(is_window, np.repeat(np.array(ids, np.int64), self.sizes), LAST)
        self.first = np.flatnonzero(common < WINDOW)
        self.least = np.minimum.reduceat(doc[order], self.first)
        # One window of each class stands for it; classes without a window are dropped.
        masked = np.where(is_window[order], order, len(self.text))
        self.sample = np.minimum.reduceat(masked, self.first)
        self.class_of = np.empty(len(order), np.int64)
        self.class_of[order] = np.repeat(
            np.arange(len(self.first)), np.diff(np.append(self.first, len(order)))
        )
        self.real = np.flatnonzero(self.sample < len(self.text))

    def windows(self, a: int, b: int) -> np.ndarray:
        """The windows of some of the classes, sorted."""
        at = self.sample[self.real[a:b]]
        return self.text[at[:, None] + np.arange(WINDOW)].reshape(-1).view(f"V{WINDOW}")

    def at(self, k: int) -> bytes:
        i = int(self.sample[self.real[k]])
        return self.text[i : i + WINDOW].tobytes()

    def find(self, window: bytes) -> int:
        """How many classes stand before the window."""
        lo, hi = 0, len(self.real)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.at(mid) < window else (lo, mid)
        return lo


    def answers(self) -> list[bytes]:
        """For each piece, runs of windows with one smallest document: place and document."""
        smallest = self.least[self.class_of]
        begin = np.cumsum(self.sizes) - self.sizes
        new = np.ones(len(smallest), bool)
        new[1:] = smallest[1:] != smallest[:-1]
        new[begin] = True
        new &= self.is_window
        first = np.flatnonzero(new)
        piece = np.searchsorted(begin, first, side="right") - 1
        raw = np.stack([first - begin[piece], smallest[first]], axis=1).tobytes()
        cuts = (16 * np.searchsorted(piece, np.arange(len(begin) + 1))).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _merge(shards: list[_Shard]) -> None:
    """Give equal classes of several shards their smallest document, range by range."""
    if len(shards) < 2:
        return
    largest = max(shards, key=lambda s: len(s.real))
    ranges = max(1, sum(len(s.real) for s in shards) // RANGE)
    marks = [largest.at(len(largest.real) * k // ranges) for k in range(1, ranges)]
    cuts = [[0, *(s.find(m) for m in marks), len(s.real)] for s in shards]
    for k in range(ranges):
        spans = [(c[k], c[k + 1]) for c in cuts]
        # As text: fixed width, so the order is that of the bytes.
        words = np.concatenate(
            [s.windows(a, b).view(f"S{WINDOW}") for s, (a, b) in zip(shards, spans, strict=True)]
        )
        if not len(words):
            continue
        least = np.concatenate([s.least[s.real[a:b]] for s, (a, b) in zip(shards, spans, strict=True)])
        # Sorted runs, one after the other: a stable sort merges them.
        order = np.argsort(words, kind="stable")
        words = words[order]
        first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        best = np.empty(len(order), np.int64)
        best[order] = np.repeat(
            np.minimum.reduceat(least[order], first), np.diff(np.append(first, len(order)))
        )
        done = 0
        for s, (a, b) in zip(shards, spans, strict=True):
            s.least[s.real[a:b]] = best[done : done + b - a]
            done += b - a


def _shards(sizes: np.ndarray, tags: np.ndarray, shard: int) -> list[list[np.ndarray]]:
    """The pieces of each shard, in groups of shards that have to be merged.

    Equal windows have one name, so pieces of one name stay together, and a group is one shard. Only
    where a name makes a group much larger than a shard, the group is cut into several.
    """
    order = np.argsort(tags, kind="stable")
    sizes, tags = sizes[order], tags[order]
    begin = np.cumsum(sizes) - sizes
    new = np.concatenate([[True], tags[1:] != tags[:-1]])[: len(tags)]
    part = np.maximum.accumulate(np.where(new, begin, 0)) // shard
    out = []
    cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        within = (begin[a:b] - begin[a]) // (2 * shard)
        inner = np.flatnonzero(np.diff(within)) + 1
        out.append(np.split(order[a:b], inner))
    return out


def _digest(piece: bytes) -> bytes:
    return xxhash.xxh3_128_digest(piece)


def _classes(shard: int):
    """One bucket: for each block's pieces, the smallest document of each of their windows."""

    def classes(rows: pa.Table) -> pa.Table:
        least: dict[bytes, int] = {}
        tag_of: dict[bytes, int] = {}
        holders: list[list[bytes]] = []
        for sizes, raw, ids, tags in zip(
            *(rows.column(c).to_pylist() for c in ("sizes", "bytes", "ids", "tags")), strict=True
        ):
            ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
            own = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            holders.append(own)
            tag_of.update(zip(own, np.frombuffer(tags, np.uint32).tolist(), strict=True))
            for piece, i in zip(own, np.frombuffer(ids, np.int64).tolist(), strict=True):
                known = least.get(piece)
                if known is None or i < known:
                    least[piece] = i
        pieces = list(least)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tags = np.fromiter((tag_of[p] for p in pieces), np.uint32, len(pieces))
        answer: dict[bytes, bytes] = {}
        for parts in _shards(lengths, tags, shard):
            groups = [[pieces[k] for k in part.tolist()] for part in parts]
            shards = [_Shard(g, [least[p] for p in g]) for g in groups]
            _merge(shards)
            for group, made in zip(groups, shards, strict=True):
                answer.update(zip(group, made.answers(), strict=True))
        out = [
            (b"".join(map(_digest, own)), b"".join(answer[p] for p in own),
             np.array([len(answer[p]) for p in own], np.int32).tobytes())
            for own in holders
        ]
        return pa.table(
            {
                "block": rows.column("block"),
                "pieces": pa.array([x for x, _, _ in out], pa.binary()),
                "least": pa.array([x for _, x, _ in out], pa.binary()),
                "sizes": pa.array([x for _, _, x in out], pa.binary()),
            }
        )

    return classes


def _mark(begin: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    change = np.bincount(begin, minlength=size + 1)
    change -= np.bincount(end, minlength=size + 1)
    return np.cumsum(change[:-1]) > 0


def _covered(block: _Block, found: pa.Table) -> dict[int, np.ndarray]:
    """Which bytes go, of documents of the block that lose any to another text."""
    number: dict[bytes, int] = {}
    pieces = itertools.count()
    runs, many = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
    for digests, least, sizes in zip(
        *(found.column(c).to_pylist() for c in ("pieces", "least", "sizes")), strict=True
    ):
        for k in range(0, len(digests), 16):
            number[digests[k : k + 16]] = next(pieces)
        runs.append(np.frombuffer(least, np.int64).reshape(-1, 2))
        many.append(np.frombuffer(sizes, np.int32) // 16)
    if not number:
        return {}
    place, smallest = np.concatenate(runs).T
    many = np.concatenate(many).astype(np.int64)
    last = np.cumsum(many) - 1
    known: dict[bytes, int] = {}
    met = []
    for i, at, piece, _ in block.pieces(_names_of(found)):
        k = known.get(piece)
        if k is None:
            k = known[piece] = number.get(_digest(piece), -1)
        if k >= 0:
            met.append((i, at, k, len(piece)))
    if not met:
        return {}
    owner, at, piece, size = np.array(met, np.int64).T
    # Each run of windows of each piece, wherever it stands.
    of = np.repeat(np.arange(len(piece)), many[piece])
    row = ranges(last[piece] + 1 - many[piece], many[piece])
    stop = np.where(
        row == last[piece[of]], size[of] - WINDOW + 1, place[np.minimum(row + 1, len(place) - 1)]
    )
    gone = smallest[row] < block.ids[owner[of]]
    of, begin, end = of[gone], place[row[gone]], stop[gone] + WINDOW - 1
    owner, begin, end = owner[of], begin + at[of], end + at[of]
    # Documents come one after the other.
    first = np.flatnonzero(np.diff(owner, prepend=-1)).tolist()
    out = {}
    for a, b in zip(first, [*first[1:], len(owner)], strict=False):
        i = int(owner[a])
        out[i] = _mark(begin[a:b], end[a:b], len(block.texts[i]))
    return out


_CUT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _cut(rows: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of a block without their repeated bytes."""
    block = _Block(rows)
    covered = _covered(block, found)
    out = []
    for i, text in enumerate(block.texts):
        original = block.first[text]
        if block.ids[original] < block.ids[i] and len(text) >= WINDOW:
            gone = np.ones(len(text), bool)
        elif original in covered:
            gone = covered[original]
        else:
            gone = np.zeros(0, bool)
        spans = int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=np.int8(0)) == 1))
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if len(gone) else text
        out.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    ids = pa.array(block.ids, pa.int64())
    ids = pc.if_else(pc.equal(ids, LAST), pa.scalar(None, pa.int64()), ids)
    columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
    return pa.table(
        {
            "doc_id": ids,
            "n_bytes": pa.array(columns[0], pa.int64()),
            "n_removed": pa.array(columns[1], pa.int64()),
            "n_spans": pa.array(columns[2], pa.int64()),
            "kept_sha256": pa.array(columns[3], pa.string()),
        }
    )


def _names_of(found: pa.Table) -> np.ndarray:
    return _sorted_names(found.filter(pc.is_valid(found.column("names"))))


def repeated_bytes(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null text counts as empty; texts under 50 bytes lose nothing. Rows with the same doc_id take
    nothing from each other; rows without a doc_id count as the largest. doc_id is a whole number,
    and returned as a bigint. Other columns are left out; an empty table gives an empty result. ``shard`` only steers the work.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    count = min(MOST_BLOCKS, size // BLOCK + 1)
    # By row, so that neither a repeated doc_id nor a missing one fills a block.
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count)).cast("int")
    doc_id = F.col("doc_id").cast("bigint").alias("doc_id")
    blocks = keep_bucketed(
        docs.select(doc_id, "text", block.alias("block")), "blocks", "block", count
    )
    named = blocks.groupBy("block").applyInArrow(_name(4 * count), _NAMES)
    shared = keep(
        named.groupBy("bucket").applyInArrow(_share, "block int, names binary"), "shared"
    )
    both = lambda other: blocks.groupBy("block").cogroup(other.groupBy("block"))
    pieces = both(shared).applyInArrow(_send(4 * count), _PIECES)
    found = pieces.groupBy("bucket").applyInArrow(
        _classes(shard), "block int, pieces binary, least binary, sizes binary"
    )
    back = found.withColumn("names", F.lit(None).cast("binary")).unionByName(
        shared.select(
            "block",
            F.lit(b"").alias("pieces"),
            F.lit(b"").alias("least"),
            F.lit(b"").alias("sizes"),
            "names",
        )
    )
    return keep(both(back).applyInArrow(_cut, f"doc_id bigint, {_CUT}"), "cut")
