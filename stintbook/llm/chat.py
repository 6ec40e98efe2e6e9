"""Chat formatting with a loss mask that is exact to the character.

A conversation is rendered whole, turn after turn, and encoded once with offsets. The spans of the
assistant's texts are sorted, and so are the spans of the tokens; two binary searches find the
tokens under each text. Control strings inside texts are escaped, so they can't end a turn, and
the rendered text can be read back. The marks are special tokens, so no token reaches over one;
very long conversations are encoded in several pieces at turn ends, with the same tokens.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

BEGIN, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
# Characters of a conversation that are encoded together, at least one turn.
PIECE = 500_000

_TURN = re.compile(re.escape(BEGIN) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)
_BAR = re.compile(r"<(\\*)\|")
_ESCAPED_BAR = re.compile(r"<\\(\\*)\|")
_ESCAPED_ROLE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Without any ``<|``: a backslash goes between, one more if there are some already."""
    return _BAR.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED_BAR.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return _ESCAPED_ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of (role, text) turns and the spans of the assistant's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{BEGIN}{_escape_role(role)}\n", escape(text)
        if role == ASSISTANT:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END + "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(rendered: str) -> list[tuple[str, str]]:
    return [(_unescape_role(r), unescape(t)) for r, t in _TURN.findall(rendered)]


class Piece(NamedTuple):
    rendered: str
    ids: list[int]
    starts: np.ndarray  # of the tokens, in characters
    ends: np.ndarray
    mask: np.ndarray  # of the tokens: those with a character of an assistant's text
    loss: list[str]  # the texts under the mask


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    own = Tokenizer.from_file(path)
    own.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (BEGIN, END)])
    return own


def encode(turns: list[tuple[str, str]], path: str) -> Piece:
    """Encode turns once and align the mask with the offsets."""
    rendered, spans = render(turns)
    encoded = tokenizer(path).encode(rendered, add_special_tokens=False)
    offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
    starts, ends = offsets[:, 0], offsets[:, 1]
    mask = np.zeros(len(starts), bool)
    loss = []
    spans_at = np.array(spans, np.int64).reshape(-1, 2)
    first = np.searchsorted(ends, spans_at[:, 0], side="right")
    after = np.searchsorted(starts, spans_at[:, 1], side="left")
    for (a, b), i, j in zip(spans, first.tolist(), after.tolist(), strict=True):
        if a == b or i >= j:
            continue
        mask[i:j] = True
        # Tokens of one character share its span, so spans are united before they are read.
        covered = np.zeros(b - a + 1, np.int64)
        np.add.at(covered, np.maximum(starts[i:j], a) - a, 1)
        np.add.at(covered, np.minimum(ends[i:j], b) - a, -1)
        inside = np.cumsum(covered[:-1]) > 0
        text = rendered[a:b]
        if not inside.all():
            text = "".join(itertools.compress(text, inside))
        loss.append(unescape(text))
    return Piece(rendered, encoded.ids, starts, ends, mask, loss)


def _pieces(turns: Iterator[tuple[str, str]], path: str) -> Iterator[Piece]:
    held: list[tuple[str, str]] = []
    size = 0
    for turn in turns:
        held.append(turn)
        size += len(turn[1])
        if size >= PIECE:
            yield encode(held, path)
            held, size = [], 0
    if held:
        yield encode(held, path)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        roles = batch.column("role").to_pylist()
        texts = batch.column("text").to_pylist()
        for conv, role, text in zip(batch.column("conv_id").to_pylist(), roles, texts, strict=True):
            yield conv, (role or "", text or "")


def _ordered(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation together and by turn. A task sees them one after the other and
    never holds a conversation as a whole."""
    rows = conversations.select("conv_id", "turn", "role", F.col("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chats(conversations: DataFrame, path: str) -> DataFrame:
    """Training rows, one per piece of a conversation (one piece but for very long ones):
    conv_id, piece, rendered, ids, loss_mask (per token).

    Turns go by ``turn``, ties by role and text; null roles and texts count as empty; a repeated
    row is a repeated turn; rows without conv_id form one conversation. Other columns are left
    out; an empty table gives an empty result.
    """

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, rows in itertools.groupby(_turns(batches), key=lambda x: x[0]):
            for k, piece in enumerate(_pieces((t for _, t in rows), path)):
                yield pa.RecordBatch.from_pydict(
                    {
                        "conv_id": pa.array([conv], kind),
                        "piece": pa.array([k], pa.int64()),
                        "rendered": [piece.rendered],
                        "ids": pa.array([piece.ids], pa.list_(pa.int32())),
                        "loss_mask": pa.array([piece.mask.tolist()], pa.list_(pa.bool_())),
                    }
                )

    sql = conversations.schema["conv_id"].dataType.simpleString()
    kind = _arrow_kind(sql)
    return _ordered(conversations).mapInArrow(
        formatted,
        f"conv_id {sql}, piece bigint, rendered string, ids array<int>, loss_mask array<boolean>",
    )


def _arrow_kind(sql: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[sql]


def chat_digests(conversations: DataFrame, path: str) -> DataFrame:
    """Per conversation, read back from what ``format_chats`` makes: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens."""
    sql = conversations.schema["conv_id"].dataType.simpleString()
    kind = _arrow_kind(sql)
    names = (
        "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens",
        "loss_tokens",
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for conv, rows in itertools.groupby(_turns(batches), key=lambda x: x[0]):
            held.append((conv, *_digest((t for _, t in rows), path)))
            if len(held) >= 2_000:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_pydict(
            {"conv_id": pa.array(columns[0], kind)}
            | {n: pa.array(c) for n, c in zip(names, columns[1:], strict=True)}
        )

    return _ordered(conversations).mapInArrow(
        digest,
        f"conv_id {sql}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint, n_tokens bigint, loss_tokens bigint",
    )


def _digest(turns: Iterator[tuple[str, str]], path: str) -> tuple:
    turns_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
    n_turns = loss_chars = chars = n_tokens = loss_tokens = 0
    for piece in _pieces(turns, path):
        for role, text in parse(piece.rendered):
            turns_sha.update(f"{role}\n{text}\n".encode())
            n_turns += 1
        for text in piece.loss:
            loss_sha.update(text.encode())
            loss_chars += len(text)
        chars += len(piece.rendered)
        n_tokens += len(piece.ids)
        loss_tokens += int(piece.mask.sum())
    return (
        n_turns, turns_sha.hexdigest(), loss_chars, loss_sha.hexdigest(), chars, n_tokens,
        loss_tokens,
    )
