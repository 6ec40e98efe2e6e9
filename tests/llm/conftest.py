from __future__ import annotations

import random

import public_tokenizers
import pytest

LETTERS = "abcdefghij"


@pytest.fixture(scope="session")
def byte_pairs():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def pieces():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def make(spark):
    """Documents with an extra column whose name clashes with results, a null and an empty text,
    and a repeated row."""

    def build(texts: list, odd: bool = True):
        rows = [(i, t, "en", f"s{i % 3}", len(t or ""), True) for i, t in enumerate(texts)]
        if odd:
            n = len(rows)
            rows += [(n, None, None, None, None, None), (n + 1, "", "en", "s0", 0, False)]
            rows.append(rows[0])
        return spark.createDataFrame(
            rows,
            "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean",
        )

    return build


def word(rng: random.Random) -> str:
    return "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 6)))


def prose(rng: random.Random, words: int) -> str:
    return "".join(word(rng) + rng.choice([" ", " ", " ", ", ", ".\n", "  "]) for _ in range(words))


def changed(rng: random.Random, text: str, share: float) -> str:
    return " ".join(word(rng) if rng.random() < share else w for w in text.split())
