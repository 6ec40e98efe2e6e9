"""SentencePiece encoding and decoding over a suffix array of the batch.

No piece holds a space after another character, so a text's tokens are the tokens of its words,
each word with the spaces before it. The distinct words of a batch are joined and indexed by a
suffix array; a binary search finds the range of suffixes that begin with each piece, so all
occurrences of all pieces are known at once. These are the edges of a lattice over the text.
Sorted by position they are relaxed from left to right. The vocabulary is of the pair-merging
kind: a path holds only neighbours that the merges leave apart (see ``lattice``), so exactly one
path reaches each place, and it is the library's own result.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from stintbook.llm.lattice import Pairs, relax
from stintbook.llm.units import Units, joined_places, ranges, stretches

SPACE = "▁"
# Characters of new words that are indexed together.
TOGETHER = 400_000


class SuffixIndex:
    """Suffixes of a text of small numbers, in order of their first ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        bits = max(1, int(text.max()).bit_length())
        per = 63 // bits
        padded = np.concatenate([text.astype(np.int64), np.zeros(depth + per, np.int64)])
        words = np.zeros(len(text) + depth, np.int64)
        for k in range(per):
            words = words << bits | padded[k : k + len(words)]
        # Keys of ``per`` symbols each; more than one where the pieces are longer.
        self._bits, self._per = bits, per
        keys = [words[k : k + len(text)] for k in range(0, depth, per)]
        self.order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
        self._keys = [k[self.order] for k in keys]

    def find(self, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of symbols, padded with zeros, the range of suffixes that begin with it."""
        low, high = [], []
        for k in range(len(self._keys)):
            lo = np.zeros(len(pieces), np.int64)
            hi = np.zeros(len(pieces), np.int64)
            for j in range(k * self._per, (k + 1) * self._per):
                symbol = pieces[:, j] if j < pieces.shape[1] else np.zeros(len(pieces), np.int64)
                lo = lo << self._bits | symbol
                hi = hi << self._bits | np.where(j < lengths, symbol, (1 << self._bits) - 1)
            low.append(lo)
            high.append(hi)
        return self._bisect(low, False), self._bisect(high, True)

    def _bisect(self, want: list[np.ndarray], after: bool) -> np.ndarray:
        """How many suffixes stand before (or, with ``after``, not after) each key."""
        lo = np.zeros(len(want[0]), np.int64)
        hi = np.full(len(want[0]), len(self.order), np.int64)
        for _ in range(len(self.order).bit_length()):
            open_ = lo < hi
            mid = np.minimum((lo + hi) >> 1, len(self.order) - 1)
            less = np.zeros(len(lo), bool)
            same = np.ones(len(lo), bool)
            for keys, w in zip(self._keys, want, strict=True):
                own = keys[mid]
                less |= same & (own < w)
                same &= own == w
            right = open_ & (less | same if after else less)
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        return lo


class Codec:
    """Encodes and decodes with the model file at ``path``."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        self._bytes = np.zeros(256, np.int32)
        self._shown: list[bytes] = [b""] * count
        texts, ids, score = [], [], {}
        for i in range(count):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self._bytes[int(piece[3:5], 16)] = i
                self._shown[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                texts.append(piece)
                ids.append(i)
                score[piece] = -model.get_score(i)
                self._shown[i] = piece.replace(SPACE, " ").encode()
        if any(re.search(f"[^{SPACE}]{SPACE}|[\n ]", t) for t in texts):
            raise ValueError("pieces that reach over words are not supported")
        # Characters that are no piece themselves but may merge into one.
        known = set(texts)
        self._plain = len(texts)
        texts += sorted({c for t in texts for c in t} - known)
        self._ids = np.array(ids, np.int32)
        self._pairs = Pairs(texts, lambda pair: score.get(pair[0] + pair[1]))
        self._symbol = {c: i + 1 for i, c in enumerate(sorted({c for t in texts for c in t}))}
        self._longest = max(map(len, texts))
        self._lengths = np.array([len(t) for t in texts])
        self._pieces = np.zeros((len(texts), self._longest), np.int64)
        for i, t in enumerate(texts):
            self._pieces[i, : len(t)] = [self._symbol[c] for c in t]
        top = max(map(ord, self._symbol)) + 1
        self._symbol_of = np.zeros(top + 1, np.int32)
        for c, i in self._symbol.items():
            self._symbol_of[ord(c)] = i
        self._word = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self._units = Units(self._solve)

    def _solve(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        sizes = np.cumsum([0, *map(len, words)])
        inner = np.searchsorted(sizes, np.arange(TOGETHER, sizes[-1], TOGETHER))
        cuts = np.unique([0, *inner.tolist(), len(words)]).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            out += self._solve_some(words[a:b])
        return out

    def _solve_some(self, words: list[str]) -> list[bytes]:
        """Token ids of each word, as 32-bit numbers."""
        first, lengths = joined_places(words)
        joined = "\n".join(words) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le"), np.int32)
        symbol = self._symbol_of[np.minimum(code, len(self._symbol_of) - 1)]
        start, token = self._occurrences(symbol)
        # What no piece knows stands for itself; its bytes are put in below.
        lone = np.flatnonzero(symbol == 0)
        inside = np.ones(len(code), bool)
        inside[first + lengths] = False
        lone = lone[inside[lone]]
        begin = np.repeat(first, lengths + 1)
        length = self._lengths[token]
        cut = self._cut(first, lengths, lone)
        last, back, _ = relax(
            len(code) + 1, cut, start, length, token, start + length - begin[start], self._pairs
        )
        return self._paths(joined, first, lengths, symbol, last, back)

    def _occurrences(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Fewer symbols need fewer bits; only pieces of symbols that are here can occur.
        here = np.unique(symbol)
        dense = np.zeros(len(self._symbol) + 1, np.int64)
        dense[here] = np.arange(len(here)) if here[0] == 0 else np.arange(1, len(here) + 1)
        can = np.flatnonzero(((dense[self._pieces] > 0) | (self._pieces == 0)).all(axis=1))
        index = SuffixIndex(dense[symbol], self._longest)
        low, high = index.find(dense[self._pieces[can]], self._lengths[can])
        found = np.flatnonzero(high > low)
        times = high[found] - low[found]
        return index.order[ranges(low[found], times)], np.repeat(can[found], times)

    @staticmethod
    def _cut(first: np.ndarray, lengths: np.ndarray, lone: np.ndarray) -> np.ndarray:
        """Places where a path may begin: at words and after characters that merge with none."""
        return np.unique(np.concatenate([first[lengths > 0], lone + 1]))

    def _paths(
        self,
        joined: str,
        first: np.ndarray,
        lengths: np.ndarray,
        symbol: np.ndarray,
        last: np.ndarray,
        back: np.ndarray,
    ) -> list[bytes]:
        """Walk all words back from their ends at once; tokens of a word in order."""
        place = first + lengths
        words = np.flatnonzero(lengths > 0)
        place = place[words]
        got_word, got_place, got_token = [], [], []
        while len(words):
            lone = symbol[place - 1] == 0
            token = np.where(lone, -1, last[place])
            got_word.append(words)
            got_place.append(place)
            got_token.append(token)
            place = np.where(lone, place - 1, back[place])
            more = place > first[words]
            words, place = words[more], place[more]
        if not got_word:
            return [b""] * len(first)
        word, place, token = map(np.concatenate, (got_word, got_place, got_token))
        order = np.argsort(place)
        word, place, token = word[order], place[order], token[order]
        spelled = token < 0
        spelled |= token >= self._plain
        if not spelled.any():
            ids = self._ids[token]
        else:
            parts: list[np.ndarray] = []
            sizes = np.ones(len(token), np.int64)
            for i in np.flatnonzero(spelled).tolist():
                raw = joined[place[i] - 1].encode()
                sizes[i] = len(raw)
                parts.append(self._bytes[np.frombuffer(raw, np.uint8)])
            ids = np.empty(int(sizes.sum()), np.int32)
            many = np.repeat(spelled, sizes)
            ids[many] = np.concatenate(parts)
            ids[~many] = self._ids[token[~spelled]]
            word = np.repeat(word, sizes)
        cuts = np.searchsorted(word, np.arange(len(first) + 1)).tolist()
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts after each other, and where each text's ids begin (and the end)."""
        words: list[str] = []
        bounds = [0]
        for text in texts:
            if text:
                words += self._word.findall(SPACE + text.replace(" ", SPACE))
            bounds.append(len(words))
        codes, answers = self._units(words)
        sizes = np.fromiter(map(len, answers), np.int64, len(answers)) // 4
        pool = np.frombuffer(b"".join(answers), np.int32)
        each = sizes[codes]
        ids = pool[ranges((np.cumsum(sizes) - sizes)[codes], each)]
        return ids, np.concatenate([[0], np.cumsum(each)])[bounds]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self._shown.__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@functools.cache
def codec(path: str) -> Codec:
    """One per worker process."""
    return Codec(path)


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids. ``path`` names the model file.

    Null text counts as empty and gives no ids; repeated rows are encoded each; other columns are
    left out; an empty table gives an empty result. Characters without a piece become the pieces
    of their bytes, so any text can be encoded.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in stretches(batches):
            ids, bounds = codec(path).encode(texts)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": rows.column("doc_id"),
                    "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                    "ids": pa.ListArray.from_arrays(
                        pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())
                    ),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(
        encoded, f"doc_id {_kind(docs)}, n_tokens bigint, ids array<int>"
    )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Per row of ``encoded`` (doc_id, ids): doc_id, text. Null ids give an empty text.

    Bytes that are no UTF-8 become replacement characters. The text of an encoded text is that
    text, but for the piece for spaces itself (U+2581), which comes back as a space.
    """

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            texts = [codec(path).decode(x.as_py() or []) for x in ids]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": texts})

    return encoded.select("doc_id", "ids").mapInArrow(
        decoded, f"doc_id {_kind(encoded)}, text string"
    )


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256 (of 32-bit little-endian ids),
    decoded_sha256, same (whether decoding gives the text back).

    Encodes and decodes each text in one pass; the cases are those of the two parts.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in stretches(batches):
            ids, bounds = codec(path).encode(texts)
            out: dict[str, list] = {"ids_sha256": [], "decoded_sha256": [], "same": []}
            for text, a, b in zip(texts, bounds.tolist(), bounds[1:].tolist(), strict=False):
                decoded = codec(path).decode(ids[a:b].tolist())
                out["ids_sha256"].append(hashlib.sha256(ids[a:b].tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                out["same"].append(decoded == text)
            counts = pa.array(np.diff(bounds), pa.int64())
            yield pa.RecordBatch.from_pydict(
                {"doc_id": rows.column("doc_id"), "n_tokens": counts} | out
            )

    return docs.select("doc_id", "text").mapInArrow(
        digest,
        f"doc_id {_kind(docs)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, "
        "same boolean",
    )
