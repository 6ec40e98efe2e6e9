"""Removal of repeated passages of words by seed and extension.

Each word goes that is covered by a window of 50 words which also starts in a document with a
smaller doc_id. Windows are judged on the input, and never reach over documents.

1. Seeds: of the 20-word strings in a window, the one with the least hash (the leftmost of equals)
   is its anchor, so equal windows have equal anchors at equal places. Neighbouring windows mostly
   share one; the windows with one anchor are a run, the words under it a piece. Of texts that are
   equal as a whole only the first is looked at, the others go.
2. Anchors of one text only can't repeat. The texts are joined with their shared anchors, and
   pieces meet by anchor, equal ones as one, with their smallest document.
3. Extension: pieces of one anchor are lined up at it and classed by their words to the left, then
   to the right, one word further at a time. Two windows are equal when the words on both sides
   agree; each class of windows has its smallest document. No pairs of pieces are formed, so a
   group costs as much as its pieces.
4. Windows whose class begins in a smaller document are a repeat; overlapping ones are one maximal
   repeat, which is cut.

An anchor of more than ``HOT`` texts makes no group: each of its windows is a key by itself (128
bits of its words) and is counted by an ordinary aggregation. Texts are moved once, into a table
bucketed by row; later joins with it move small rows only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintbook.llm.shingles import mix, word_places
from stintbook.llm.units import stretches
from stintbook.sources.shared import keep, keep_bucketed

WINDOW, SEED = 50, 20
# Texts with one anchor up to which its pieces are one group.
HOT = 20_000
# Bytes of a bucket of texts, of pieces that a task holds, of pieces in a group, and of text worked
# on at a time.
BUCKET, HELD, GROUP, STRETCH = 32 << 20, 16 << 20, 8 << 20, 2_000_000
MOST_BUCKETS = 20_000
# Rows without a doc_id count as the largest.
LAST = np.iinfo(np.int64).max

_PLACES = WINDOW - SEED + 1


def _power(k: int) -> np.uint64:
    return np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64))


def _parts(raw: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    """A long text in parts that share all but one word of a window; and their first word."""
    at, words, long = 0, 0, size
    while len(raw) - at > long:
        cut = at + long
        while cut < len(raw) and raw[cut] not in b" \t\n\x0b\x0c\r":
            cut += 1
        starts = word_places([raw[at:cut]])[2]
        if len(starts) < WINDOW:
            # Too few long words.
            long *= 2
            continue
        yield words, raw[at:cut]
        words += len(starts) - WINDOW + 1
        at += int(starts[1 - WINDOW])
        long = size
    yield words, raw[at:]


def _runs(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text, first window, windows, place of the anchor after the
    first window, and the anchor's hash."""
    words, text, _ = word_places(raw)
    n = len(words) - WINDOW + 1
    if n <= 0:
        return (*[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint64))
    # Strings of 20 words from 16 and 4.
    two = words[:-1] * _power(1) + words[1:]
    four = two[:-2] * _power(2) + two[2:]
    eight = four[:-4] * _power(4) + four[4:]
    sixteen = eight[:-8] * _power(8) + eight[8:]
    least = mix(sixteen[:-4] * _power(4) + four[16:])
    place = np.arange(len(least))
    # Least of 31 neighbours with its place, by doubling.
    for k in (1, 2, 4, 8, 15):
        right = least[k:] < least[:-k]
        place = np.where(right, place[k:], place[:-k])
        least = np.where(right, least[k:], least[:-k])
    whole = text[:n] == text[WINDOW - 1 :]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    stop = np.append(np.flatnonzero(new | ~whole), n)
    size = stop[np.searchsorted(stop, first, side="right")] - first
    begin = np.searchsorted(text, text[first])
    return text[first], first - begin, size, place[first] - first, least[first]


def _batches(batches: Iterator[pa.RecordBatch]):
    """Rows of a stretch; parts of their texts with the row and first word of each; their runs."""
    for rows, texts in stretches(batches, STRETCH):
        owner, offset, raw = [], [], []
        for i, t in enumerate(texts):
            for word, part in _parts(t.encode(), STRETCH):
                owner.append(i)
                offset.append(word)
                raw.append(part)
        yield rows, texts, owner, offset, raw, _runs(raw)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts, owner, _, _, (text, _, _, _, name) in _batches(batches):
        own = np.array(owner, np.int64)[text]
        order = np.lexsort((name, own))
        own, name = own[order], name[order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (name[1:] != name[:-1])
        own, name = own[new], name[new].view(np.int64)
        cuts = np.searchsorted(own, np.arange(len(texts) + 1)).astype(np.int32)
        digest = np.frombuffer(
            b"".join(xxhash.xxh3_128_digest(t.encode()) for t in texts), np.int64
        ).reshape(-1, 2)
        yield pa.RecordBatch.from_pydict(
            {
                "row": rows.column("row"),
                "doc": rows.column("doc"),
                "high": digest[:, 0],
                "low": digest[:, 1],
                "anchors": pa.ListArray.from_arrays(cuts, name),
            }
        )


_SENT = (
    "id binary, key bigint, left int, piece binary, row bigint, doc bigint, most bigint, first int"
)
_SENT_KINDS = {
    "id": pa.binary(), "key": pa.int64(), "left": pa.int32(), "piece": pa.binary(),
    "row": pa.int64(), "doc": pa.int64(), "most": pa.int64(), "first": pa.int32(),
}
# Left of a window of a hot anchor, which has no piece.
_ALONE = -1


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences (id, row, doc, first) of pieces, and the pieces (id, key, left, piece, smallest
    and largest document), each once as long as the task can hold it."""
    held: dict[bytes, list] = {}
    size = 0
    for rows, _, owner, offset, raw, (text, first, many, left, name) in _batches(batches):
        ids = rows.column("row").to_pylist()
        docs = rows.column("doc").to_pylist()
        chosen, hot = (
            _listed(np.array(owner, np.int64)[text], name, rows.column(c)) for c in ("shared", "hot")
        )
        out: list[tuple] = []
        words: list[bytes] = []
        at = -1
        for k in np.flatnonzero(chosen | hot).tolist():
            if text[k] != at:
                at = int(text[k])
                words = raw[at].split()
            a, n = int(first[k]), int(many[k])
            row, doc, begin = ids[owner[at]], docs[owner[at]], offset[at] + a
            if hot[k]:
                for b in range(n):
                    window = b" ".join(words[a + b : a + b + WINDOW])
                    id_ = xxhash.xxh3_128_digest(window)
                    out.append((id_, None, _ALONE, None, row, doc, None, begin + b))
                continue
            piece, key, before = b" ".join(words[a : a + n + WINDOW - 1]), int(name[k]), int(left[k])
            id_ = xxhash.xxh3_128_digest(b"%d %d " % (key, before) + piece)
            out.append((id_, None, None, None, row, doc, None, begin))
            known = held.get(id_)
            if known is None:
                signed = key - (key >> 63 << 64)
                held[id_] = [id_, signed, before, piece, None, doc, doc, None]
                size += len(piece)
            else:
                known[5], known[6] = min(known[5], doc), max(known[6], doc)
        yield _batch(out)
        if size > HELD:
            yield _batch(held.values())
            held, size = {}, 0
    yield _batch(held.values())


def _batch(rows) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_SENT_KINDS)
    arrays = [pa.array(c, k) for c, k in zip(columns, _SENT_KINDS.values(), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=list(_SENT_KINDS))


def _listed(owner: np.ndarray, name: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each name stands in the list of its owner."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    wanted = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    # Owner and name as one sortable pair.
    both = np.zeros(len(wanted), [("o", np.int64), ("n", np.uint64)])
    both["o"], both["n"] = of, wanted
    asked = np.zeros(len(name), both.dtype)
    asked["o"], asked["n"] = owner, name
    return np.isin(asked, both)


def _refined(classes: np.ndarray, codes: np.ndarray, kinds: int) -> np.ndarray:
    """Classes told apart by one more code."""
    return np.unique(classes * kinds + codes, return_inverse=True)[1]


def _extended(rows: pa.Table) -> pa.Table:
    """For each piece, runs of its windows that begin in several documents, with the smallest."""
    ids = rows.column("id").to_pylist()
    number: dict[bytes, int] = {}
    of = np.fromiter((number.setdefault(x, len(number)) for x in ids), np.int64, len(ids))
    # Equal pieces as one.
    low, high = np.full(len(number), LAST), np.full(len(number), -LAST)
    np.minimum.at(low, of, rows.column("doc").to_numpy())
    np.maximum.at(high, of, rows.column("most").to_numpy())
    rows = rows.take(pa.array(np.unique(of, return_index=True)[1]))
    pieces = [p.split() for p in rows.column("piece").to_pylist()]
    left = rows.column("left").to_numpy().astype(np.int64)
    n, sizes = len(pieces), np.array([len(p) for p in pieces], np.int64)
    code: dict[bytes, int] = {}
    flat = np.fromiter(
        (code.setdefault(w, len(code)) for p in pieces for w in p), np.int64, int(sizes.sum())
    )
    begin = np.cumsum(sizes) - sizes
    kinds = len(code) + n
    alone = len(code) + np.arange(n)

    def column(j: int) -> np.ndarray:
        """Codes of the words ``j`` places after the anchors; beyond a piece, like no other."""
        inside = (left + j >= 0) & (left + j < sizes)
        return np.where(inside, flat[np.where(inside, begin + left + j, 0)], alone)

    same = np.unique(rows.column("key").to_numpy(), return_inverse=True)[1]
    before = [same]
    for a in range(1, _PLACES):
        before.append(_refined(before[-1], column(-a), kinds))
    after = {}
    for j in range(WINDOW):
        same = _refined(same, column(j), kinds)
        after[j + 1] = same
    windows = sizes - WINDOW + 1
    least = np.full((n, _PLACES), LAST)
    most = np.full((n, _PLACES), -LAST)
    for a in range(_PLACES):
        start = left - a
        real = np.flatnonzero((start >= 0) & (start < windows))
        if not len(real):
            continue
        both = before[a][real] * n + after[WINDOW - a][real]
        order = np.argsort(both, kind="stable")
        cuts = np.flatnonzero(np.diff(both[order], prepend=-1))
        times = np.diff([*cuts, len(order)])
        own = real[order]
        least[own, start[own]] = np.repeat(np.minimum.reduceat(low[own], cuts), times)
        most[own, start[own]] = np.repeat(np.maximum.reduceat(high[own], cuts), times)
    hit = least < most
    new = hit.copy()
    new[:, 1:] &= ~hit[:, :-1] | (least[:, 1:] != least[:, :-1])
    piece, start = np.nonzero(new)
    ends = hit.copy()
    ends[:, :-1] &= ~hit[:, 1:] | (least[:, 1:] != least[:, :-1])
    stop = np.nonzero(ends)[1]
    chosen = np.unique(piece)
    cuts = np.append(np.searchsorted(piece, chosen), len(piece)).astype(np.int32)
    runs = pa.StructArray.from_arrays(
        [
            pa.array(start.astype(np.int32)),
            pa.array((stop - start + 1).astype(np.int32)),
            pa.array(least[piece, start]),
        ],
        names=["start", "windows", "least"],
    )
    return pa.table(
        {
            "id": rows.column("id").take(pa.array(chosen)),
            "runs": pa.ListArray.from_arrays(pa.array(cuts), runs),
        }
    )


_RUNS = "array<struct<start:int,windows:int,least:bigint>>"
_SPANS = "array<struct<from:int,to:int>>"


def _cut(doc_kind: str):
    """Texts without the words under their spans."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in stretches(batches, STRETCH):
            out = [
                _without(t.encode().split(), gone, spans)
                for t, gone, spans in zip(
                    texts, *(rows.column(c).to_pylist() for c in ("gone", "spans")), strict=True
                )
            ]
            columns = list(zip(*out, strict=True))
            span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
            kinds = [pa.int64(), pa.int64(), span, pa.string()]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)),
                ],
                names=["doc_id", "n_words", "n_removed", "spans", "text"],
            )

    return cut, f"doc_id {doc_kind}, n_words bigint, n_removed bigint, spans {_SPANS}, text string"


def _without(words: list[bytes], gone: bool | None, spans: list[dict] | None) -> tuple:
    n = len(words)
    if gone and n >= WINDOW:
        return n, n, [(0, n)], ""
    merged: list[list[int]] = []
    for a, b in sorted((s["from"], s["to"]) for s in spans or []):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    kept, at = [], 0
    for a, b in merged:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return n, n - len(kept), [tuple(s) for s in merged], b" ".join(kept).decode()


def without_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, spans (removed words, from and to), text
    (the words that stay, one space between them).

    Words are cut at ASCII white space and unchanged. Null text counts as empty; texts under 50
    words lose nothing. Rows with the same doc_id take nothing from each other; rows without a
    doc_id count as the largest. doc_id is a whole number. Other columns are left out; an empty
    table gives an empty result. ``hot`` only steers the work.
    """
    row = F.monotonically_increasing_id()
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    texts = keep_bucketed(
        docs.select(row.alias("row"), "doc_id", doc.alias("doc"), "text"),
        "texts",
        "row",
        min(MOST_BUCKETS, size // BUCKET + 1),
    )
    seeds = keep(
        texts.select("row", "doc", "text").mapInArrow(
            _seeds, "row bigint, doc bigint, high bigint, low bigint, anchors array<bigint>"
        ),
        "seeds",
    )
    # Rows with a text that stands elsewhere, and the row that is looked at for them.
    equal = seeds.groupBy("high", "low").agg(
        F.min(F.struct("doc", "row")).alias("of"), F.count(F.lit(1)).alias("n")
    )
    copies = keep(
        seeds.select("row", "doc", "high", "low")
        .join(equal.filter("n > 1").drop("n"), ["high", "low"])
        .filter("row <> of.row")
        .select("row", F.col("of.row").alias("of_row"), (F.col("of.doc") < F.col("doc")).alias("gone")),
        "copies",
    )
    anchors = seeds.join(copies.select("row"), "row", "left_anti").select(
        "row", F.explode("anchors").alias("anchor")
    )
    times = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    each = anchors.join(times, "anchor")
    # As many as a text has; nulls are left out.
    listed = each.groupBy("row").agg(
        F.collect_list(F.when(F.col("n") <= hot, F.col("anchor"))).alias("shared"),
        F.collect_list(F.when(F.col("n") > hot, F.col("anchor"))).alias("hot"),
    )
    sent = keep(
        texts.select("row", "doc", "text").join(listed, "row").mapInArrow(_sent, _SENT), "pieces"
    )
    pieces = sent.filter("piece IS NOT NULL")
    moved = pieces.agg(F.sum(F.octet_length("piece")).alias("n")).first().n or 0
    groups = F.pmod(F.xxhash64("key"), F.lit(moved // GROUP + 1))
    extended = (
        pieces.select(groups.alias("group"), "id", "key", "left", "piece", "doc", "most")
        .groupBy("group")
        .applyInArrow(_extended, f"id binary, runs {_RUNS}")
    )
    seen = sent.filter("piece IS NULL").select("id", "left", "row", "doc", "first")
    alone = (
        seen.filter(F.col("left") == _ALONE)
        .groupBy("id")
        .agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
        .filter("least < most")
        .select("id", F.expr("array(named_struct('start', 0, 'windows', 1, 'least', least))"))
        .toDF("id", "runs")
    )
    answers = extended.unionByName(alone)
    # Not a repeat where the document itself is the smallest.
    spans = F.expr(
        "transform(filter(runs, r -> r.least < doc), "
        "r -> named_struct('from', first + r.start, "
        f"'to', first + r.start + r.windows + {WINDOW - 1}))"
    )
    repeats = seen.join(answers, "id").select("row", spans.alias("spans")).filter("size(spans) > 0")
    repeats = keep(
        repeats.groupBy("row").agg(F.flatten(F.collect_list("spans")).cast(_SPANS).alias("spans")),
        "repeats",
    )
    again = copies.filter("NOT gone").join(repeats.withColumnRenamed("row", "of_row"), "of_row")
    found = (
        repeats.select("row", F.lit(False).alias("gone"), "spans")
        .unionByName(again.select("row", "gone", "spans"))
        .unionByName(
            copies.filter("gone").select("row", "gone", F.lit(None).cast(_SPANS).alias("spans"))
        )
    )
    cut, schema = _cut(docs.schema["doc_id"].dataType.simpleString())
    joined = texts.select("row", "doc_id", "text").join(found, "row", "left")
    return joined.select("doc_id", "text", "gone", "spans").mapInArrow(cut, schema)
