"""Aligned tokens against the libraries and brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from unittest.mock import Mock

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from conftest import SF_DIR
from tokenizers import Tokenizer

from stintbook.llm import token_alignment
from stintbook.llm.token_counts import byte_of

from .conftest import prose


class Brute:
    def __init__(self, path_a: str, path_b: str) -> None:
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.known = byte_of()

    def raw_b(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def groups(self, text: str | None) -> list[tuple[list[int], list[int]]]:
        if not text:
            return []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        sides = []
        for ids, raw in (
            (a, [bytes(self.known[c] for c in self.a.id_to_token(i)) for i in a]),
            (b, [self.raw_b(i) for i in b]),
        ):
            if b"".join(raw) != b" " + text.encode():
                return []
            sides.append((ids, np.cumsum([len(x) for x in raw]).tolist()))
        (a, ends_a), (b, ends_b) = sides
        out, i, j = [], 0, 0
        for end in sorted({*ends_a} & {*ends_b}):
            m, n = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            out.append((a[i:m], b[j:n]))
            i, j = m, n
        return out

    def rows(self, docs: list[tuple]) -> list[tuple]:
        each = [(i, self.groups(t)) for i, t in docs]
        held = Counter(
            p for _, g in each for p in {(x, y) for a, b in g for x in a for y in b}
        )
        best: dict[int, int] = {}
        for (x, _), n in held.items():
            best[x] = max(best.get(x, 0), n)
        out = []
        for i, g in each:
            links = [(x, y) for a, b in g for x in a for y in b]
            said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
            out.append(
                (
                    i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links),
                    sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(said.encode()).hexdigest() if said else "",
                )
            )
        return sorted(out, key=repr)


def odd_texts() -> list:
    rng = random.Random(3)
    return [
        "a", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "a\n b\tc", "it's  we'll 're", "é漢字 𝕏 x",
        "<|endoftext|> x</s><s> <unk> <0x41> [INST]", "▁", "a ▁b", "a▁ b", " a  b", "\x1c a \x1d",
        "naïve café ﬁ", "x" * 300, "ab" * 2_000, "漢" * 500, "é " * 40, "0123456789 " * 9,
        "\x00 a\x00b", "…—“”", "🙂" * 30, prose(rng, 60), prose(rng, 60), "\r\n\r\n", "a" * 7 + " " * 40 + "b",
    ]


def found(df, paths) -> list[tuple]:
    return sorted(map(tuple, token_alignment.link_counts(df, *paths).collect()), key=repr)


def test_odd_texts_equal_brute_force(spark, make, byte_pairs, pieces):
    df = make(odd_texts())
    docs = [(r.doc_id, r.text) for r in df.collect()]
    brute = Brute(byte_pairs, pieces)
    expected = brute.rows(docs)
    assert found(df, (byte_pairs, pieces)) == expected
    said = dict(map(tuple, token_alignment.groups(df, byte_pairs, pieces).collect()))
    digest = {i: hashlib.sha256(t.encode()).hexdigest() if t else "" for i, t in said.items()}
    assert digest == {r[0]: r[-1] for r in expected}
    # A text with the sign for a space is spelt otherwise.
    assert [r[1] for r in expected if r[0] == 12] == [0]
    assert found(df.limit(0), (byte_pairs, pieces)) == []


def test_table_equals_brute_force(spark, byte_pairs, pieces):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert found(df.repartition(5), (byte_pairs, pieces)) == Brute(byte_pairs, pieces).rows(docs)


def test_blocks_of_a_task(spark, byte_pairs, pieces):
    """Several blocks in one task, texts longer than a stretch, one long word."""
    rng = random.Random(8)
    long = prose(rng, 900_000)
    rows = [(1, long), (2, "tail " + long[:2_000]), (3, "ab" * 40_000), (4, "x y"), (5, None)]
    many = [(10 + k, f"{prose(rng, 40)}") for k in range(20)]
    df = spark.createDataFrame(rows + many, "doc_id int, text string").coalesce(1)
    assert found(df, (byte_pairs, pieces)) == Brute(byte_pairs, pieces).rows(rows + many)


def test_texts_held_at_a_time(monkeypatch, byte_pairs, pieces):
    aligner = token_alignment.aligner(byte_pairs, pieces)
    assert aligner._units._stored <= 32_000_000
    held, plain = [], aligner.answers
    monkeypatch.setattr(aligner, "answers", lambda texts: held.append(sum(map(len, texts))) or plain(texts))
    monkeypatch.setattr(token_alignment, "TaskContext", Mock())
    token_alignment.TaskContext.get.return_value.partitionId.return_value = 0
    texts = [prose(random.Random(k % 3), 20_000) for k in range(30)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    rows = sum(x.num_rows for x in token_alignment._counted(byte_pairs, pieces)(iter([batch])))
    assert rows == len(texts) + 1 and sum(held) == sum(map(len, texts)) > 2_000_000
    assert max(held) <= 1_000_000 + max(map(len, texts))


@pytest.mark.parametrize("seed", range(20))
def test_merge_path(seed):
    rng = np.random.default_rng(seed)
    top = int(rng.integers(1, 400))
    a, b = (np.unique(rng.integers(0, top, int(rng.integers(0, 300)))) for _ in range(2))
    for every in (1, 2, 3, 7, 50, 10_000):
        i, j = token_alignment.common_ends(a, b, every)
        assert a[i].tolist() == b[j].tolist() == sorted({*a.tolist()} & {*b.tolist()})
        x, y = token_alignment.merge_path(a, b, every)
        assert (x + y)[-1] == len(a) + len(b) and (np.diff(x + y)[:-1] == every).all()


def test_groups_multiplied(monkeypatch):
    ids_a, ids_b = np.array([1, 1, 2, 5, 5]), np.array([7, 8, 7, 9])
    args = (ids_a, ids_b, np.array([0, 3]), np.array([3, 2]), np.array([0, 3]), np.array([3, 1]))

    def counted() -> Counter:
        codes, times, sizes = token_alignment._links(*args)
        assert sizes.sum() == len(codes)
        return sum((Counter({c: t}) for c, t in zip(codes.tolist(), times.tolist())), Counter())

    each = counted()
    assert each[1 << 32 | 7] == 4 and each[5 << 32 | 9] == 2 and sum(each.values()) == 11
    monkeypatch.setattr(token_alignment, "WRITTEN", 2)
    assert counted() == each
