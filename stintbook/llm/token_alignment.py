"""Alignment of two tokenizers by merge path, and how often their tokens meet.

Tokens of A (byte-level pairs) and B (sentence pieces) are runs of bytes of the same text, a space
before it. Where a token of A and one of B both end, a group ends; all tokens of A in a group are
linked with all of B.

- Merge path: the ends of A and B are two sorted lists. Evenly spaced diagonals of their merge are
  found by binary search, all at once, and cut it into pieces of equal work that know nothing of
  each other. Each piece finds the ends its two parts have in common; an end whose two tokens fall
  into neighbouring pieces is found where these are stitched.
- Both tokenizers cut at a single space between two words, so a text is aligned unit by unit, and
  units that come back are answered from a store. A unit is never split, however long.
- How many documents hold a pair linked: each block of documents counts its distinct pairs, and
  Spark sums the blocks' counts by pair. The sums go back to the blocks that hold the pair, where
  each document's pairs lie as numbers into the block's list; so no document's pairs are joined one
  by one, and nothing is broadcast.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stintbook.llm.token_counts import byte_of
from stintbook.llm.units import Units, ranges, stretches
from stintbook.sources.shared import keep

SPACE = "▁"
# Ends in a piece of a merge.
PIECE = 1 << 16
# Characters of new units that are encoded together, and of a block of documents.
TOGETHER, BLOCK = 400_000, 32_000_000
# Characters of texts that are aligned at a time, and of units and bytes of answers in each store.
# Every task of an executor holds as much; a longer text is still aligned as a whole.
STRETCH, STORED = 1_000_000, 32_000_000
# Links of a group that are written out; larger groups are multiplied by their distinct tokens.
WRITTEN = 4_096

# A space between two characters that are no white space.
_CUT = re.compile(r" (?<=\S )(?=\S)")


def merge_path(a: np.ndarray, b: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``a`` and ``b`` (sorted) lie before each diagonal of their merge, the first at
    0, the last behind both; equal ones of ``a`` come first."""
    total = len(a) + len(b)
    diagonal = np.append(np.arange(0, total, every), total)
    low, high = np.maximum(diagonal - len(b), 0), np.minimum(diagonal, len(a))
    while (low < high).any():
        mid = (low + high) >> 1
        # Is a[mid] merged before the element of b that stands across it?
        across = np.clip(diagonal - mid - 1, 0, max(len(b) - 1, 0))
        before = (low < high) & (a[np.minimum(mid, max(len(a) - 1, 0))] <= b[across])
        low, high = np.where(before, mid + 1, low), np.where(before, high, mid)
    return low, diagonal - low


def common_ends(a: np.ndarray, b: np.ndarray, every: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` (both strictly rising) of the ends they have in common."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = merge_path(a, b, every)
    found = []
    for k in range(len(i) - 1):
        x, y = a[i[k] : i[k + 1]], b[j[k] : j[k + 1]]
        if len(x) and len(y):
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            same = np.flatnonzero(y[at] == x)
            found.append((same + i[k], at[same] + j[k]))
        # The end of A closes this piece, the same end of B opens the next one.
        if k + 2 < len(i) and 0 < i[k + 1] and j[k + 1] < len(b) and a[i[k + 1] - 1] == b[j[k + 1]]:
            found.append((i[k + 1 : k + 2] - 1, j[k + 1 : k + 2]))
    at_a, at_b = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in zip(*found or [((), ())]))
    at_a, keep_ = np.unique(at_a.astype(np.int64), return_index=True)
    return at_a, at_b.astype(np.int64)[keep_]


class _Answers(NamedTuple):
    """Of distinct units: counts, links and the groups as text."""

    counts: np.ndarray  # rows: whole, n_a, n_b, n_groups, n_links
    first: np.ndarray  # of the unit's links
    many: np.ndarray
    links: np.ndarray  # token of A in the high 32 bits, token of B in the low ones
    times: np.ndarray
    groups: list[str]


_HEAD = 7


class Aligner:
    def __init__(self, path_a: str, path_b: str) -> None:
        # One thread per task.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._a = Tokenizer.from_file(path_a)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        known = byte_of()
        with open(path_a, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        self._bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for shown, i in vocabulary.items():
            if all(c in known for c in shown):
                self._bytes_a[i] = bytes(known[c] for c in shown)
        self._bytes_b = []
        for i in range(self._b.get_piece_size()):
            piece = self._b.id_to_piece(i)
            if re.search(f"[^{SPACE}]{SPACE}", piece):
                raise ValueError("pieces that reach over words are not supported")
            real = not (self._b.is_control(i) or self._b.is_unknown(i))
            shown = piece.replace(SPACE, " ").encode() if real else b""
            self._bytes_b.append(bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else shown)
        self._size_a = np.array([len(x) for x in self._bytes_a], np.int64)
        self._size_b = np.array([len(x) for x in self._bytes_b], np.int64)
        self._shown = [str(i) for i in range(max(len(self._bytes_a), len(self._bytes_b)))]
        self._units = Units(self._solve, stored=STORED)

    def _solve(self, units: list[str]) -> list[bytes]:
        out: list[bytes] = []
        sizes = np.cumsum([0, *map(len, units)])
        inner = np.searchsorted(sizes, np.arange(TOGETHER, sizes[-1], TOGETHER))
        cuts = np.unique([0, *inner.tolist(), len(units)]).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            out += self._solve_some(units[a:b])
        return out

    def _solve_some(self, units: list[str]) -> list[bytes]:
        spaced = [" " + u for u in units]
        a = [x.ids for x in self._a.encode_batch_fast(spaced, add_special_tokens=False)]
        b = self._b.encode(units, num_threads=1)
        show_a, show_b = self._bytes_a.__getitem__, self._bytes_b.__getitem__
        whole = [
            b"".join(map(show_a, x)) == raw and b"".join(map(show_b, y)) == raw
            for x, y, raw in zip(a, b, (s.encode() for s in spaced), strict=True)
        ]
        empty: list[int] = []
        a = [x if w else empty for x, w in zip(a, whole, strict=True)]
        b = [x if w else empty for x, w in zip(b, whole, strict=True)]
        ids_a = np.fromiter((i for x in a for i in x), np.int64)
        ids_b = np.fromiter((i for x in b for i in x), np.int64)
        close_a, close_b = common_ends(np.cumsum(self._size_a[ids_a]), np.cumsum(self._size_b[ids_b]))
        n_a, n_b = np.diff(close_a, prepend=-1), np.diff(close_b, prepend=-1)
        begin_a, begin_b = close_a + 1 - n_a, close_b + 1 - n_b
        # Units end with a group, and so have whole groups.
        last = np.cumsum([len(x) for x in a])
        groups = np.searchsorted(close_a, np.concatenate([[0], last]))
        links = np.concatenate([[0], np.cumsum(n_a * n_b)])
        codes, times, sizes = _links(ids_a, ids_b, begin_a, n_a, begin_b, n_b)
        first = np.concatenate([[0], np.cumsum(sizes)])
        shown = self._shown
        sa = [shown[i] for i in ids_a.tolist()]
        sb = [shown[i] for i in ids_b.tolist()]
        text = [
            f"{sa[i]}|{sb[j]}" if m == n == 1 else f"{','.join(sa[i:i + m])}|{','.join(sb[j:j + n])}"
            for i, m, j, n in zip(
                begin_a.tolist(), n_a.tolist(), begin_b.tolist(), n_b.tolist(), strict=True
            )
        ]
        out = []
        low, high = groups[:-1].tolist(), groups[1:].tolist()
        for k, (g, h) in enumerate(zip(low, high, strict=True)):
            said = ";".join(text[g:h]).encode()
            c = codes[first[g] : first[h]]
            head = (whole[k], len(a[k]), len(b[k]), h - g, links[h] - links[g], len(c), len(said))
            out.append(
                np.array(head, np.int64).tobytes() + c.tobytes() + times[first[g] : first[h]].tobytes()
                + said + bytes(-len(said) % 8)
            )
        return out

    def answers(self, texts: list[str]) -> tuple[_Answers, np.ndarray, np.ndarray]:
        """Answers for the distinct units, the unit of each place, and where each text begins."""
        units: list[str] = []
        bounds = [0]
        for text in texts:
            if text:
                units += _CUT.split(text)
            bounds.append(len(units))
        codes, packed = self._units(units)
        pool = np.frombuffer(b"".join(packed), np.int64)
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 8
        first = np.cumsum(sizes) - sizes
        head = pool[first[:, None] + np.arange(_HEAD)] if len(first) else np.zeros((0, _HEAD), np.int64)
        many = head[:, 5]
        begins = ((_HEAD + 2 * many) * 8).tolist()
        groups = [
            x[a : a + n].decode() for x, a, n in zip(packed, begins, head[:, 6].tolist(), strict=True)
        ]
        found = _Answers(
            head[:, :5].T,
            np.cumsum(many) - many,
            many,
            pool[ranges(first + _HEAD, many)],
            pool[ranges(first + _HEAD + many, many)],
            groups,
        )
        return found, codes, np.array(bounds)


def _links(ids_a, ids_b, begin_a, n_a, begin_b, n_b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of tokens of each group, how often each stands for a link, and pairs per group."""
    product = n_a * n_b
    small = np.flatnonzero(product <= WRITTEN)
    sizes = np.where(product <= WRITTEN, product, 0)
    of = np.repeat(small, product[small])
    within = ranges(np.zeros(len(small), np.int64), product[small])
    codes = ids_a[begin_a[of] + within // n_b[of]] << 32 | ids_b[begin_b[of] + within % n_b[of]]
    times = np.ones(len(codes), np.int64)
    large = np.flatnonzero(product > WRITTEN).tolist()
    if large:
        more_of, more_codes, more_times = [of], [codes], [times]
        for g in large:
            a, k = np.unique(ids_a[begin_a[g] : begin_a[g] + n_a[g]], return_counts=True)
            b, m = np.unique(ids_b[begin_b[g] : begin_b[g] + n_b[g]], return_counts=True)
            more_codes.append((a[:, None] << 32 | b).ravel())
            more_times.append((k[:, None] * m).ravel())
            more_of.append(np.full(len(a) * len(b), g))
            sizes[g] = len(a) * len(b)
        of, codes, times = map(np.concatenate, (more_of, more_codes, more_times))
        order = np.argsort(of, kind="stable")
        codes, times = codes[order], times[order]
    return codes, times, sizes


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker process."""
    return Aligner(path_a, path_b)


def _sums(found: _Answers, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """n_a, n_b, n_groups, n_links of each text, zeros where a unit's bytes differ."""
    running = np.zeros((5, len(codes) + 1), np.int64)
    np.cumsum(found.counts[:, codes], axis=1, out=running[:, 1:])
    sums = running[:, bounds[1:]] - running[:, bounds[:-1]]
    return np.where(sums[0] == np.diff(bounds), sums[1:], 0)


def _texts(found: _Answers, codes: np.ndarray, bounds: np.ndarray, real: np.ndarray) -> Iterator[str]:
    said = found.groups
    for a, b, own in zip(bounds.tolist(), bounds[1:].tolist(), real.tolist(), strict=False):
        yield ";".join([said[c] for c in codes[a:b].tolist()]) if own else ""


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of ``docs``: doc_id, groups: ``a1,a2|b1;a3|b2,b3``, the ids of A and B in order.
    Cases as for ``link_counts``."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in stretches(batches, STRETCH):
            found, codes, bounds = aligner(path_a, path_b).answers(texts)
            real = _sums(found, codes, bounds)[0] > 0
            said = pa.array(_texts(found, codes, bounds, real), pa.string())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), said], names=["doc_id", "groups"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(aligned, f"doc_id {kind}, groups string")


class _Pairs:
    """The distinct pairs of a block, numbered as they come, and their documents."""

    def __init__(self) -> None:
        self.codes, self.numbers = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.docs = np.zeros(0, np.int64)

    def number(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of the pairs."""
        distinct, back = np.unique(codes, return_inverse=True)
        at = np.searchsorted(self.codes, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.codes):
            known = self.codes[np.minimum(at, len(self.codes) - 1)] == distinct
        number = np.empty(len(distinct), np.int64)
        number[known] = self.numbers[at[known]]
        number[~known] = len(self.codes) + np.arange(np.count_nonzero(~known))
        self.codes = np.insert(self.codes, at[~known], distinct[~known])
        self.numbers = np.insert(self.numbers, at[~known], number[~known])
        self.docs = np.append(self.docs, np.zeros(np.count_nonzero(~known), np.int64))
        return number[back]


_NAMES = ["n_a", "n_b", "n_groups", "n_links"]


class _Rows:
    """Record batches of one schema whose columns may be left out."""

    def __init__(self, doc_kind: pa.DataType) -> None:
        long, text = pa.int64(), pa.string()
        self.kinds = {"block": long, "doc_id": doc_kind} | dict.fromkeys(_NAMES, long)
        self.kinds |= {"groups_sha256": text, "pairs": pa.list_(pa.int32()), "times": pa.list_(long)}
        self.kinds |= {"codes": pa.list_(long), "docs": pa.list_(long)}

    def batch(self, rows: int, **columns) -> pa.RecordBatch:
        arrays = [columns.get(c, pa.nulls(rows, k)) for c, k in self.kinds.items()]
        return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(self.kinds))

    def closed(self, block: int, pairs: _Pairs) -> pa.RecordBatch:
        order = np.argsort(pairs.numbers)
        return self.batch(
            1,
            block=pa.array([block], pa.int64()),
            codes=pa.array([pairs.codes[order]], self.kinds["codes"]),
            docs=pa.array([pairs.docs], self.kinds["docs"]),
        )


def _counted(path_a: str, path_b: str):
    """Documents with the numbers of their pairs; and a row with the pairs of each block."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, pairs, out = TaskContext.get().partitionId() << 32, 0, _Pairs(), None
        for rows, texts in stretches(batches, STRETCH):
            out = out or _Rows(rows.schema.field("doc_id").type)
            found, codes, bounds = aligner(path_a, path_b).answers(texts)
            sums = _sums(found, codes, bounds)
            real = sums[0] > 0
            digests = [
                hashlib.sha256(x.encode()).hexdigest() if x else ""
                for x in _texts(found, codes, bounds, real)
            ]
            # Links of each document: sorted, so that equal ones stand together.
            number = pairs.number(found.links)
            doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
            own = codes[real[doc]]
            doc = np.repeat(doc[real[doc]], found.many[own])
            at = ranges(found.first[own], found.many[own])
            keys = doc * len(pairs.docs) + number[at]
            times = found.times[at]
            if (times == 1).all():
                keys = np.sort(keys)
                first = np.flatnonzero(np.diff(keys, prepend=-1))
                times = np.diff(np.append(first, len(keys)))
            else:
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                first = np.flatnonzero(np.diff(keys, prepend=-1))
                times = np.add.reduceat(times[order], first)
            doc, number = np.divmod(keys[first], max(len(pairs.docs), 1))
            pairs.docs += np.bincount(number, minlength=len(pairs.docs))
            cuts = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
            yield out.batch(
                len(texts),
                block=pa.array(np.full(len(texts), block), pa.int64()),
                doc_id=rows.column("doc_id"),
                **{n: pa.array(x) for n, x in zip(_NAMES, sums, strict=True)},
                groups_sha256=pa.array(digests, pa.string()),
                pairs=pa.ListArray.from_arrays(cuts, pa.array(number.astype(np.int32))),
                times=pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64())),
            )
            size += sum(map(len, texts))
            if size >= BLOCK:
                yield out.closed(block, pairs)
                block, size, pairs = block + 1, 0, _Pairs()
        if out:
            yield out.closed(block, pairs)

    return counted


def _finished(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """One block: sums over each document's links."""
    at = counts.column("number").to_numpy()
    total = np.zeros((2, len(at)), np.int64)
    total[0, at], total[1, at] = counts.column("best").to_numpy(), counts.column("docs").to_numpy()
    lists = docs.column("pairs").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy()
    number = lists.flatten().to_numpy()
    times = docs.column("times").combine_chunks().flatten().to_numpy()
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    running = np.zeros(len(number) + 1, np.int64)
    sums = []
    # one after the other, in one array: a block has millions of links
    for each in total:
        np.multiply(each[number], times, out=running[1:])
        np.cumsum(running[1:], out=running[1:])
        sums.append(running[bounds[1:]] - running[bounds[:-1]])
    out = docs.select(["doc_id", *_NAMES])
    out = out.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))
    return out.append_column("groups_sha256", docs.column("groups_sha256"))


def link_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link is a token of A and one of B in the same group; a pair of ids counts the rows that hold
    it linked. ``n_best`` are the links whose pair has the highest count of its A id, ``count_sum``
    adds up the counts of all links.

    Texts that are null or empty, or whose tokens do not spell them (a space before), have no
    tokens: zeros, and '' for the digest. Repeated rows count each, and are aligned each. Strings of
    special tokens are ordinary text. Other columns are left out; an empty table gives an empty
    result.
    """
    kind = docs.schema["doc_id"].dataType
    schema = (
        f"block bigint, doc_id {kind.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, "
        "n_links bigint, groups_sha256 string, pairs array<int>, times array<bigint>, "
        "codes array<bigint>, docs array<bigint>"
    )
    found = keep(
        docs.select("doc_id", "text").mapInArrow(_counted(path_a, path_b), schema), "aligned"
    )
    zipped = F.posexplode(F.arrays_zip("codes", "docs")).alias("number", "pair")
    each = found.filter("codes IS NOT NULL").select("block", zipped)
    each = each.select("block", "number", F.col("pair.codes").alias("code"), F.col("pair.docs").alias("docs"))
    total = each.groupBy("code").agg(F.sum("docs").alias("docs"))
    # At most as many rows for an A id as the vocabulary of B has.
    of_a = Window.partitionBy(F.shiftright("code", 32))
    total = total.withColumn("best", (F.col("docs") == F.max("docs").over(of_a)).cast("bigint"))
    counts = each.drop("docs").join(total, "code").select(
        F.col("block").alias("of_block"), "number", "docs", "best"
    )
    rows = found.filter("codes IS NULL").drop("codes", "docs")
    return (
        rows.groupBy("block")
        .cogroup(counts.groupBy("of_block"))
        .applyInArrow(
            _finished,
            f"doc_id {kind.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, "
            "n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
        )
    )
