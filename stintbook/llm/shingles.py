"""Sets of word shingles as sorted 64-bit hashes, for many texts at once."""

from __future__ import annotations

import functools

import numpy as np

SHINGLE = 5

# Bytes get random values; places of a word get powers of an odd number, which has an inverse.
_VALUES = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = x ^ np.uint64((salt * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=2)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_places(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words (cut at white space of ASCII), the text of each, and its first byte,
    counted over all texts with one byte between them."""
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.diff(_SPACE[data].view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(change == -1), np.flatnonzero(change == 1)
    room = 1 << int(len(data)).bit_length()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _powers(_STEP, room)[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _powers(_BACK, room)[starts])
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return hashes, np.searchsorted(begins, starts, side="right") - 1, starts


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z as a-z, cut at white space of ASCII) and the text of each."""
    return word_places([t.encode().lower() for t in texts])[:2]


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, all after each other; and the bounds.

    A text with fewer than five words has its whole sequence as its only shingle; without words
    the set is empty.
    """
    words, text = word_hashes(texts)
    counts = np.bincount(text, minlength=len(texts))
    n = max(len(words) - SHINGLE + 1, 0)
    full = np.flatnonzero(text[:n] == text[SHINGLE - 1 :]) if n else np.zeros(0, np.int64)
    h = words[full]
    for k in range(1, SHINGLE):
        h = h * np.uint64(_STEP) + words[full + k]
    hashes, owner = mix(h, SHINGLE), text[full]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        first = np.searchsorted(text, short)
        h = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            more = counts[short] > k
            at = np.minimum(first + k, len(words) - 1)
            h = np.where(more, h * np.uint64(_STEP) + words[at], h)
        # The number of words is part of the shingle.
        for k in range(1, SHINGLE):
            own = counts[short] == k
            hashes = np.concatenate([hashes, mix(h[own], k)])
            owner = np.concatenate([owner, short[own]])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def set_ids(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set, equal for equal sets. Empty sets have 0."""
    sizes = np.diff(bounds)
    out = np.zeros(len(sizes), np.uint64)
    filled = np.flatnonzero(sizes > 0)
    if len(filled):
        sums = np.add.reduceat(mix(hashes, 11), bounds[filled])
        out[filled] = mix(sums + sizes[filled].astype(np.uint64), 12) | np.uint64(1)
    return out.view(np.int64)
