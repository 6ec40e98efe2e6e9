"""Exact byte-pair tokens of many short texts at once, as a walk over a lattice.

A sequence of tokens is the merge result of its text exactly when every two neighbours are the
merge result of their joined text. So each prefix of a text has one last token, and it can be
found from the tokens that end there and the last tokens of the shorter prefixes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Pairs:
    """Tells which token may follow which. Answers are kept in a table of fixed size."""

    SLOT_BITS = 21

    def __init__(self, texts: list[str], rank: Callable[[tuple[str, str]], int | None]) -> None:
        """``texts``: the text of each token; ``rank``: when two parts merge, None: never."""
        self.nothing = len(texts)
        self.texts = [*texts, ""]
        self.rank = rank
        self._keys = np.full(1 << self.SLOT_BITS, -1, np.int64)
        self._yes = np.zeros(1 << self.SLOT_BITS, bool)

    def merged(self, text: str) -> list[str]:
        """The plain definition: merge the earliest rank, leftmost first, until none is left."""
        parts = list(text)
        while (best := self._next(parts)) is not None:
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _next(self, parts: list[str]) -> int | None:
        ranks = list(map(self.rank, zip(parts, parts[1:], strict=False)))
        known = [r for r in ranks if r is not None]
        return ranks.index(min(known)) if known else None

    def _fits(self, key: int) -> bool:
        """Whether no merge reaches over the border, and each side becomes one token."""
        left, right = (self.texts[i] for i in divmod(key, self.nothing))
        parts, border = list(left + right), len(left)
        while (best := self._next(parts)) is not None:
            if best == border - 1:
                return False
            border -= best < border
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return len(parts) == (2 if left else 1)

    def follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of token numbers; ``nothing`` on the left stands for the beginning."""
        key = left.astype(np.int64) * self.nothing + right
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        slot = (mixed >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        yes = self._yes[slot]
        miss = self._keys[slot] != key
        if miss.any():
            asked, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            found = np.fromiter(map(self._fits, asked.tolist()), bool, len(asked))
            yes[miss] = found[back]
            own = slot[miss][first]
            self._keys[own], self._yes[own] = asked, found
            # Where two new keys share a slot, the answer must belong to the key that stayed.
            lost = self._keys[own] != asked
            self._keys[own[lost]] = -1
        return yes


def relax(
    size: int,
    first: np.ndarray,
    start: np.ndarray,
    length: np.ndarray,
    token: np.ndarray,
    offset: np.ndarray,
    pairs: Pairs,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Walk the edges (start, length, token) by rising end offset within their text.

    ``first`` holds the places where texts begin. Returns for each of ``size`` places the last
    token, where it begins, and the number of tokens up to the place.
    """
    last = np.full(size, -1, np.int32)
    back = np.zeros(size, np.int32)
    count = np.zeros(size, np.int32)
    last[first] = pairs.nothing
    if not len(start):
        return last, back, count
    kind = np.uint16 if offset.max() < 1 << 16 else np.uint32
    order = np.argsort(offset.astype(kind), kind="stable")
    start, length, token, offset = start[order], length[order], token[order], offset[order]
    cuts = np.flatnonzero(np.diff(offset)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(offset)], strict=True):
        src, new = start[a:b], token[a:b]
        before = last[src]
        good = before >= 0
        good[good] = pairs.follow(before[good], new[good])
        src = src[good]
        end = src + length[a:b][good]
        last[end], back[end], count[end] = new[good], src, count[src] + 1
    return last, back, count
