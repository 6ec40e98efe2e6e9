"""Texts as runs of repeated units, each solved once for a stretch of text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

# Characters of text that are held as Python objects at one time.
STRETCH = 4_000_000
# Characters of units and bytes of answers that each of the two stores holds.
STORED = 64_000_000


class Units:
    """Answers for distinct units. What comes back in a later stretch is kept; both stores are
    bounded, in number and bytes, and only save time: an answer that was let go is worked out
    again."""

    def __init__(
        self,
        solve: Callable[[list[str]], list[bytes]],
        young: int = 150_000,
        old: int = 300_000,
        stored: int = STORED,
    ) -> None:
        self._solve, self._most, self._stored = solve, (young, old), stored
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._young_bytes = self._old_bytes = 0

    def __call__(self, units: list[str]) -> tuple[np.ndarray, list[bytes]]:
        """The number of each unit's answer, and the answers."""
        distinct = list(set(units))
        number = dict(zip(distinct, range(len(distinct)), strict=True))
        codes = np.fromiter(map(number.__getitem__, units), np.int32, len(units))
        answers = list(map(self._old.get, distinct))
        open_ = [i for i, x in enumerate(answers) if x is None]
        new = []
        for i in open_:
            known = self._young.pop(distinct[i], None)
            if known is None:
                new.append(i)
            else:
                answers[i] = self._old[distinct[i]] = known
                self._young_bytes -= len(distinct[i]) + len(known)
                self._old_bytes += len(distinct[i]) + len(known)
        for i, x in zip(new, self._solve([distinct[i] for i in new]), strict=True):
            answers[i] = self._young[distinct[i]] = x
            self._young_bytes += len(distinct[i]) + len(x)
        if len(self._young) > self._most[0] or self._young_bytes > self._stored:
            self._young.clear()
            self._young_bytes = 0
        if len(self._old) > self._most[1] or self._old_bytes > self._stored:
            self._old.clear()
            self._old_bytes = 0
        return codes, answers


def stretches(
    batches: Iterator[pa.RecordBatch], size: int = STRETCH
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts (null: empty), a few megabytes each; a row is
    never split."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        sizes = np.fromiter((len(x) for x in _views(column)), np.int64, len(column))
        part = (np.cumsum(sizes) - sizes) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                rows = batch.slice(a, b - a)
                yield rows, [x or "" for x in column.slice(a, b - a).to_pylist()]


def _views(column: pa.Array) -> Iterator[bytes]:
    for x in column:
        yield b"" if (raw := x.as_buffer()) is None else raw


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def joined_places(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Where each unit begins when the units stand side by side with one place between them,
    and the units' lengths."""
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    return np.cumsum(lengths + 1) - lengths - 1, lengths
