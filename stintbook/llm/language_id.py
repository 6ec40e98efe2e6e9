"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's vector is the mean of the embeddings of its character sequences (2 to 4 bytes), hashed
into a fixed number of buckets. Embeddings and softmax are trained together by stochastic gradient
descent on a bounded sample of labelled texts; all other work runs over whole texts.

Scores are calibrated by a temperature. A text is rejected when too few of its sequences occur in
the learned texts of the language it was given; the posterior can't tell that, as it is shared out
among the learned languages. Both are fitted on texts that the model in use has not seen: the
sample is cut into ``FOLDS``, and each is scored by a model of the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintbook.llm.units import ranges, stretches
from stintbook.sources.shared import keep

UNKNOWN = "und"
# The training sample: texts per language and in all, and different sequences of a text (the most
# frequent). This bounds what the driver holds: 2,000 texts of at most 96 KB. Of more than 2,000
# languages some are never learned.
PER_LANGUAGE, IN_ALL, OF_A_TEXT = 400, 2_000, 16_384
# Times PER_LANGUAGE that pass the hash before they are ranked.
ROOM = 3
BUCKETS, SIZES, DIM = 1 << 16, (2, 3, 4), 16
EPOCHS, RATE, SEED = 8, 2.0, 11
# Folds of the calibration, and right answers that it may reject. Below LEAST texts none is.
FOLDS, REJECT_SHARE, LEAST = 3, 0.002, 50

_LETTER = regex.compile(r"\p{L}")
# Bytes of ASCII that are no letters count as spaces.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray  # each bucket's part of the scores
    bias: np.ndarray
    temperature: float
    seen: np.ndarray  # whether a bucket occurs in the learned texts, by language
    least: float  # share of seen sequences below which a text is rejected


def held_out() -> Column:
    """Rows that are never learned from. A null doc_id is not held out, nor learned from."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(4)) == 2, F.lit(False))


def _buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all texts, one row per sequence size, and where each text begins."""
    raw = [b" " + t.lower().encode().translate(_FOLD) + b" \0\0\0" for t in texts]
    starts = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw) + b"\0\0\0", np.uint8).astype(np.uint32)
    n = len(data) - 3
    code, out = data[:n], []
    for size in range(2, max(SIZES) + 1):
        code = code << np.uint32(8) | data[size - 1 : size - 1 + n]
        if size in SIZES:
            mixed = (code + np.uint32(size)) * np.uint32(0x9E3779B1)
            out.append((mixed >> np.uint32(16)).astype(np.uint16))
    return np.stack(out), starts


def _sample(docs: DataFrame) -> DataFrame:
    """Labelled texts, spread over the languages, by the order of a hash of doc_id: one row per
    doc_id and language, with the smallest of its texts."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    labelled = labelled.filter("text <> ''").select("doc_id", "lang", "text")
    order = F.xxhash64("doc_id")
    ids = keep(labelled.select("doc_id", "lang").distinct(), "labelled")
    # The least hashes of a language are among those below a bound, so few rows of a large one
    # are ranked.
    sizes = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("of_lang"))
    # Of more languages than texts, only the first by name can have one.
    sizes = F.broadcast(sizes.orderBy("lang").limit(IN_ALL))
    below = (order / F.lit(2.0**64) + 0.5) * F.col("of_lang") <= ROOM * PER_LANGUAGE
    few = ids.join(sizes, "lang").filter(below)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    chosen = (
        few.select("doc_id", "lang", rank.alias("rank"))
        .filter(F.col("rank") <= PER_LANGUAGE)
        .orderBy("rank", "lang")
        .limit(IN_ALL)
        .select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    )
    match = (F.col("_id") == F.col("doc_id")) & (F.col("_lang") == F.col("lang"))
    rows = labelled.join(F.broadcast(chosen), match, "left_semi")
    return rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text its buckets and their counts, so that texts themselves stay on the executors."""
    for rows, texts in stretches(batches):
        buckets, starts = _buckets(texts)
        own = [_frequent(buckets[:, a:b]) for a, b in zip(starts, starts[1:])]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": rows.column("doc_id").cast(pa.string()),
                "lang": rows.column("lang"),
                "buckets": [k.tobytes() for k, _ in own],
                "counts": [c.astype(np.float32).tobytes() for _, c in own],
            }
        )


def _frequent(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, counts = np.unique(buckets, return_counts=True)
    most = np.sort(np.argsort(-counts, kind="stable")[:OF_A_TEXT])
    return distinct[most], counts[most]


class _Text(NamedTuple):
    buckets: np.ndarray
    share: np.ndarray
    answer: int


def train(docs: DataFrame) -> Model:
    """Learn from the sample of ``docs`` (doc_id, text, lang).

    A document counts once, however often its row is repeated; where a doc_id has several texts
    under one language, the smallest; null and empty texts teach nothing. Without labelled texts the model knows no language.
    """
    rows = _sample(docs).mapInArrow(
        _counted, "doc_id string, lang string, buckets binary, counts binary"
    )
    rows = sorted(rows.collect(), key=lambda r: (r.doc_id, r.lang))
    languages = sorted({r.lang for r in rows})
    if not languages:
        none = np.zeros((BUCKETS, 0), np.float32)
        return Model([], none, np.zeros(0), 1.0, none.astype(bool), 0.0)
    number = {x: i for i, x in enumerate(languages)}
    data = []
    for r in rows:
        counts = np.frombuffer(r.counts, np.float32)
        buckets = np.frombuffer(r.buckets, np.uint16)
        data.append(_Text(buckets, counts / counts.sum(), number[r.lang]))
    table, bias = _fit(data, len(languages))
    temperature, least = _calibrated(data, len(languages))
    return Model(languages, table, bias, temperature, _seen(data, len(languages)), least)


def _fit(data: list[_Text], languages: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    vectors = random.normal(0, 0.5, (BUCKETS, DIM)).astype(np.float32)
    weights = np.zeros((DIM, languages), np.float32)
    bias = np.zeros(languages, np.float32)
    steps = EPOCHS * len(data)
    for step in range(steps):
        if step % len(data) == 0:
            turn = random.permutation(len(data))
        rate = np.float32(RATE * (1 - step / steps))
        buckets, share, answer = data[turn[step % len(data)]]
        mean = share @ vectors[buckets]
        error = _softmax((mean @ weights + bias)[None, :])[0]
        error[answer] -= 1
        back = weights @ error
        weights -= rate * np.outer(mean, error)
        bias -= rate * np.float32(0.1) * error
        vectors[buckets] -= (rate * share)[:, None] * back
    return vectors @ weights, bias


def _seen(data: list[_Text], languages: int) -> np.ndarray:
    out = np.zeros((BUCKETS, languages), bool)
    for text in data:
        out[text.buckets, text.answer] = True
    return out


def _calibrated(data: list[_Text], languages: int) -> tuple[float, float]:
    """The temperature, and the share of seen sequences that all but REJECT_SHARE of the right
    answers reach, on texts of the folds a model was not fitted on."""
    if len(data) < LEAST:
        return 1.0, 0.0
    fold = np.random.default_rng(SEED).permutation(len(data)) % FOLDS
    logits, answers, shares = [], [], []
    for f in range(FOLDS):
        learn = [t for t, k in zip(data, fold, strict=True) if k != f]
        aside = [t for t, k in zip(data, fold, strict=True) if k == f]
        table, bias = _fit(learn, languages)
        seen = _seen(learn, languages)
        for text in aside:
            own = text.share @ table[text.buckets] + bias
            logits.append(own)
            answers.append(text.answer)
            shares.append(float(text.share @ seen[text.buckets, own.argmax()]))
    logits, answers = np.stack(logits), np.array(answers)
    right = np.sort(np.array(shares)[logits.argmax(axis=1) == answers])
    # The rank that a new text falls below with at most that probability, or the lowest there is.
    rank = max(int(REJECT_SHARE * (len(right) + 1)), 1)
    least = float(right[rank - 1]) if len(right) else 0.0
    return _temperature(logits, answers), least


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _temperature(logits: np.ndarray, answers: np.ndarray) -> float:
    """The one of a grid with the best likelihood of the answers."""

    def loss(t: float) -> float:
        p = _softmax(logits / t)[np.arange(len(answers)), answers]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    return float(min(np.geomspace(0.1, 10, 41), key=loss))


def _predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score, and whether the text is rejected, of each text."""
    score, share = np.zeros(len(texts)), np.zeros(len(texts))
    names = [UNKNOWN] * len(texts)
    spoken = [i for i, t in enumerate(texts) if model.languages and _LETTER.search(t)]
    if spoken:
        buckets, starts = _buckets([texts[i] for i in spoken])
        sizes = np.diff(starts) * len(SIZES)
        logits = np.empty((len(spoken), len(model.languages)))
        for k in range(len(model.languages)):
            logits[:, k] = _sums(np.ascontiguousarray(model.table[:, k]), buckets, starts) / sizes
        p = _softmax((logits + model.bias) / model.temperature)
        best = p.argmax(axis=1)
        score[spoken] = p.max(axis=1)
        for k in np.unique(best).tolist():
            seen = np.ascontiguousarray(model.seen[:, k]).astype(np.float32)
            own = np.flatnonzero(best == k)
            # Neighbouring texts mostly share few languages; each is looked up on its own texts.
            at = ranges(starts[:-1][own], np.diff(starts)[own])
            begins = np.concatenate([[0], np.cumsum(np.diff(starts)[own])])
            share[np.array(spoken)[own]] = _sums(seen, buckets[:, at], begins) / sizes[own]
        for i, k in zip(spoken, best.tolist(), strict=True):
            names[i] = model.languages[k]
    known = np.array([n != UNKNOWN for n in names], bool)
    return names, score, ~known | (share < model.least)


def _sums(values: np.ndarray, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the buckets' values over each text."""
    part = values[buckets[0]]
    for row in buckets[1:]:
        part += values[row]
    return np.add.reduceat(part, starts[:-1], dtype=np.float64)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score, rejected.

    Only the text decides; its language label and other columns are never read. Null texts and
    texts without a letter are ``und`` with score 0 and rejected. Repeated rows get the same
    answer; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in stretches(batches):
            names, score, rejected = _predict(shared.value, texts)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": rows.column("doc_id"),
                    "held_out": rows.column("held_out"),
                    "lang_pred": pa.array(names, pa.string()),
                    "score": pa.array(score, pa.float64()),
                    "rejected": pa.array(rejected),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        answer,
        f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean",
    )


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with all columns, without the rows that ``identify`` rejects."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in stretches(batches):
            rejected = _predict(shared.value, texts)[2]
            yield rows.filter(pc.invert(pa.array(rejected)))

    return docs.mapInArrow(stay, docs.schema)
