"""Exact token counts at every prefix, for byte-level byte-pair vocabularies.

A text is cut into words by the vocabulary's own pattern; tokens never reach over words, so a
text's count is the sum over its words. For each distinct word a dynamic program over its
prefixes keeps the exact count at every prefix. Where a text must be cut for a budget, the cut is
read from the counts of the word that crosses it. Only where a shorter text falls into other words
(inside a special string or a contraction, after white space) are a few characters taken anew.

Counts are those of the tokenizer library for the whole text, without added special tokens. The
vocabulary's special strings inside a text count one token each, as the library has it.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintbook.llm.lattice import Pairs, relax
from stintbook.llm.units import Units, joined_places, ranges, stretches

LIMIT = 1024
# White space as the vocabulary's word pattern has it (the Unicode property).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The word pattern of this vocabulary family, a fixed value.
WORD = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+"
    rf"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
# Those of its contractions that fall apart when the last letter is missing.
CONTRACTIONS = frozenset(["'re", "'ve", "'ll"])
# Characters of new words that are solved together.
TOGETHER = 400_000


def byte_of() -> dict[str, int]:
    """The vocabulary file writes bytes as visible characters: itself where a byte is one in
    Latin-1, else the next free character from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounts:
    """Counts for the vocabulary at ``path`` (a ``tokenizer.json`` of byte-level pairs)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        known = byte_of()
        plain = lambda s: "".join(chr(known[c]) for c in s)
        # Special strings are no merge results; only merges and single bytes make words.
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        rank = {(plain(a), plain(b)): i for i, (a, b) in enumerate(merges)}
        texts = sorted({*map(chr, range(256)), *(a + b for a, b in rank)})
        self._pairs = Pairs(texts, rank.get)
        specials = [x["content"] for x in spec["added_tokens"]]
        self._one = np.int32(1).tobytes()
        self._specials = frozenset(specials)
        special = "|".join(re.escape(x) for x in sorted(specials, key=len, reverse=True))
        self._special = re.compile(f"({special})") if specials else None
        self._white = re.compile(f"[{WHITE}]")
        self._word = regex.compile(WORD)
        self._index(texts)
        self._words = Units(self._solve_words)

    def _index(self, texts: list[str]) -> None:
        """Hash tables from a token's bytes to its number. What finds its place taken goes to
        the next table."""
        self._longest = max(map(len, texts))
        hashes = np.zeros(len(texts), np.uint64)
        for i, text in enumerate(texts):
            h = 0
            for b in text.encode("latin-1"):
                h = (h * self.STEP + b + 1) & 0xFFFFFFFFFFFFFFFF
            hashes[i] = h
        self._hashes, self._tables, left = hashes, [], np.arange(len(texts))
        while len(left):
            salt = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self._tables))
            table = np.zeros(1 << 18, np.int32)
            slot = (hashes[left] * salt >> np.uint64(46)).astype(np.int64)
            table[slot] = left
            self._tables.append((salt, table))
            left = left[table[slot] != left]

    STEP = 0x100000001B3

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Token numbers, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int32)
        for salt, table in self._tables:
            at = table[(hashes * salt >> np.uint64(46)).astype(np.int64)]
            np.copyto(out, at, where=self._hashes[at] == hashes)
        return out

    def _solve_words(self, words: list[str]) -> list[bytes]:
        """For each word the counts at its byte prefixes, without the empty one."""
        out: list[bytes] = []
        # A special string alone is the special token; as a word of a text it is never more.
        raw = [b"" if w in self._specials else w.encode() for w in words]
        sizes = np.cumsum([0, *map(len, raw)])
        inner = np.searchsorted(sizes, np.arange(TOGETHER, sizes[-1], TOGETHER))
        cuts = np.unique([0, *inner.tolist(), len(raw)]).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            out += self._solve_some(raw[a:b])
        return out

    def _solve_some(self, words: list[bytes]) -> list[bytes]:
        first, lengths = joined_places(words)
        # Bytes as 1..256; 0 between the words.
        text = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.uint64) + np.uint64(1)
        where = ranges(first, lengths)
        offset = where - np.repeat(first, lengths)
        room = np.repeat(lengths, lengths) - offset
        starts, lens, tokens = [], [], []
        h = np.zeros(len(where), np.uint64)
        for n in range(1, self._longest + 1):
            if n > 1:
                fits = room >= n
                where, offset, room, h = where[fits], offset[fits], room[fits], h[fits]
            if not len(where):
                break
            h = h * np.uint64(self.STEP) + text[where + n - 1]
            token = self._find(h)
            hit = token >= 0
            starts.append(where[hit])
            tokens.append(token[hit])
            lens.append((n, offset[hit] + n))
        if not starts:
            return [self._one] * len(words)
        length = np.concatenate([np.full(len(o), n, np.int32) for n, o in lens])
        ends = np.concatenate([o for _, o in lens])
        _, _, count = relax(
            len(text) + 1, first, np.concatenate(starts), length, np.concatenate(tokens), ends,
            self._pairs,
        )
        return [
            count[a + 1 : a + n + 1].tobytes() or self._one
            for a, n in zip(first.tolist(), lengths.tolist(), strict=True)
        ]

    def words(self, text: str) -> list[str]:
        """Words of a text; special strings stand alone."""
        if self._special is None or not self._special.search(text):
            return self._word.findall(text)
        out: list[str] = []
        for i, part in enumerate(self._special.split(text)):
            out += [part] if i % 2 else self._word.findall(part)
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, list[list[str]], np.ndarray]:
        """Tokens of each text; its words; tokens of each word, all texts after each other."""
        words = [self.words(t) for t in texts]
        flat = [w for s in words for w in s]
        codes, answers = self._words(flat)
        each = self._last(answers)[codes]
        total = np.concatenate([[0], np.cumsum(each)])
        bounds = np.cumsum([0, *map(len, words)])
        return total[bounds[1:]] - total[bounds[:-1]], words, each

    @staticmethod
    def _last(answers: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join([x[-4:] for x in answers]), np.int32).astype(np.int64)

    def _total(self, words: list[str]) -> int:
        codes, answers = self._words(words)
        return int(self._last(answers)[codes].sum())

    def _within(self, words: list[str], j: int, upto: np.ndarray) -> np.ndarray:
        """The count of the whole text up to each character of its word ``j``, from the first to
        the last. ``upto``: tokens before each word.

        A shorter text has the same words before ``j`` and a shorter word ``j``, whose count is in
        the prefix table, but in three places.
        """
        word, white = words[j], self._white.match
        if word in self._specials:
            # A part of it is no special string, and the last words before may go on into it.
            i = j
            while i and j - i < 3 and words[i - 1] not in self._specials:
                i -= 1
            before = "".join(words[i:j])
            parts = [self._total(self.words(before + word[:k])) for k in range(1, len(word))]
            return np.array([*(upto[i] + p for p in parts), upto[j + 1]], np.int64)
        table = np.frombuffer(self._words([word])[1][0], np.int32)
        ends = np.cumsum([len(c.encode()) for c in word])
        out = upto[j] + table[ends - 1].astype(np.int64)
        if len(word) == 3 and word in CONTRACTIONS:
            out[1] = upto[j] + self._total(self.words(word[:2]))
        if j and white(word) and white(words[j - 1]) and white(words[j - 1][-1]):
            # White space at the end of a text is one word.
            out[0] = upto[j - 1] + self._total([words[j - 1] + word[0]])
        return out

    def prefix_counts(self, unit: str) -> np.ndarray:
        """The count at each character prefix of a text, from 0 characters to all, read from the
        prefix tables of its words."""
        words = self.words(unit)
        codes, answers = self._words(words)
        upto = np.concatenate([[0], np.cumsum(self._last(answers)[codes])]).astype(np.int64)
        return np.concatenate([[0], *(self._within(words, j, upto) for j in range(len(words)))])

    def cut(self, words: list[str], each: np.ndarray, limit: int) -> int:
        """Characters of the longest prefix with at most ``limit`` tokens."""
        upto = np.concatenate([[0], np.cumsum(each)])
        over = int(np.searchsorted(upto, limit, side="right")) - 1
        if over == len(words):
            return sum(map(len, words))
        # A text that ends after white space or inside a special string may have other words, and
        # fewer tokens, a little before its end.
        later = range(min(over + 3, len(words) - 1), over, -1)
        tried = [j for j in later if j == over + 1 or words[j] in self._specials]
        for j in (*tried, *range(over, -1, -1)):
            fits = np.flatnonzero(self._within(words, j, upto) <= limit)
            if len(fits):
                return sum(map(len, words[:j])) + int(fits[-1]) + 1
        return 0


@functools.cache
def prefix_counts(path: str) -> PrefixCounts:
    """One per worker process."""
    return PrefixCounts(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit, cut_chars.

    ``path`` names the vocabulary file on the executors. ``cut_chars``: characters of the longest
    prefix within ``limit`` tokens. Null text counts as empty; repeated rows are counted each;
    other columns are left out; an empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counts(path)
        for rows, texts in stretches(batches):
            total, words, each = counter.counts(texts)
            at, cuts = 0, []
            for own, n, text in zip(words, total.tolist(), texts, strict=True):
                over = n > limit
                cuts.append(counter.cut(own, each[at : at + len(own)], limit) if over else len(text))
                at += len(own)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": rows.column("doc_id"),
                    "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                    "n_tokens": pa.array(total, pa.int64()),
                    "over_limit": pa.array(total > limit),
                    "cut_chars": pa.array(cuts, pa.int64()),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(
        count,
        f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, cut_chars bigint",
    )
