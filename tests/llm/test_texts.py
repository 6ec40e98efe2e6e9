"""Quality, tokens, chat, licenses, languages and mixing."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from conftest import SF_DIR
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stintbook.llm import (
    chat,
    language_id,
    lattice,
    licenses,
    mixing,
    quality,
    sentence_pieces,
    token_counts,
)
from stintbook.llm.units import Units

from .conftest import prose

SPECIAL = "<|im_end|><|im_start|>assistant ok"
ODD = [
    "", " ", "\n \n", "  a  b's don't I'll \n\n  \t y<|endoftext|>  z<|endoftext|>", "'''s",
    "日本語 text　wide\x85x\x1cy\x00\x07", "aaaa" * 60, "éế 🙂🙂", "a▁b ▁▁c", " " * 70 + "y",
]


def noise(seed: int, size: int = 200) -> list[str]:
    rng = random.Random(seed)
    letters = "ab' \n\t.é,1🙂\xa0s<|>dt▁"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(size)]


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def brute_quality(text: str) -> tuple:
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {
        j
        for i in range(len(words) - 2)
        if windows[tuple(words[i : i + 3])] > 1
        for j in (i, i + 1, i + 2)
    }
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(again),
    )


def test_quality(make, spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.choice([0, 2, 3, 60, 120])) for _ in range(40)]
    texts += ["a b c a b c", "x\nx\n \n\ny\nx", "# * $ %\f|", "w " * 5000, "a b c d"]
    docs = make(texts)
    expected = {i: brute_quality(t) for i, t in texts_of(docs)}
    found = quality.quality(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        n, *_, repeats = counts = tuple(r)[1:6]
        assert counts == expected[r.doc_id]
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (r.base_failed and r.kept)
    assert quality.quality(make([], odd=False)).count() == 0


def test_quality_agrees_with_labels(spark):
    docs = spark.read.parquet(f"{SF_DIR}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/../sf0.01/labels.parquet")
    rows = quality.quality(docs).join(labels, "doc_id").filter("NOT base_failed").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) >= 0.98 * len(rows)
    # Texts that are fine are left alone.
    assert sum(not r.kept for r in rows if r.quality) <= 0.01 * len(rows)


def test_token_counts(make, byte_pairs):
    library = Tokenizer.from_file(byte_pairs)
    docs = make(ODD + noise(3))
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for limit in (0, 3, 1024):
        found = token_counts.count_tokens(docs, byte_pairs, limit).collect()
        by_id = dict(texts_of(docs))
        assert len(found) == docs.count()
        for r in found:
            text = by_id[r.doc_id]
            assert (r.n_bytes, r.n_tokens) == (len(text.encode()), count(text))
            assert r.over_limit == (r.n_tokens > limit)
            if len(text) < 60:
                assert r.cut_chars == max(
                    k for k in range(len(text) + 1) if count(text[:k]) <= limit
                )
    assert token_counts.count_tokens(make([], odd=False), byte_pairs).count() == 0


def test_prefix_counts(byte_pairs):
    library = Tokenizer.from_file(byte_pairs)
    counts = token_counts.prefix_counts(byte_pairs)
    for unit in ["  hello's", "don't've", " \n\tword,", "🙂é🙂", "<|endoftext|>", "12345ab"]:
        expected = [
            len(library.encode(unit[:k], add_special_tokens=False).ids)
            for k in range(len(unit) + 1)
        ]
        assert counts.prefix_counts(unit).tolist() == expected


def test_cuts_of_all_limits(byte_pairs):
    library = Tokenizer.from_file(byte_pairs)
    counter = token_counts.prefix_counts(byte_pairs)
    rng = random.Random(12)
    bits = ["<|endoftext|>", "'re", "'ll've", "!!", "'", "é", "日本", " ", "    ", "\n\n\t", "word",
            "hello", "12", "<|", "\xa0", "r"]
    for _ in range(60):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        expected = [
            len(library.encode(text[:k], add_special_tokens=False).ids)
            for k in range(len(text) + 1)
        ]
        assert counter.prefix_counts(text).tolist() == expected
        _, (words,), each = counter.counts([text])
        for limit in range(expected[-1] + 1):
            longest = max(k for k, n in enumerate(expected) if n <= limit)
            assert counter.cut(words, each, limit) == longest


def test_a_cut_of_one_long_word_encodes_nothing_again(byte_pairs):
    library = Tokenizer.from_file(byte_pairs)
    counter = token_counts.PrefixCounts(byte_pairs)
    rng = random.Random(13)
    text = "".join(rng.choice("abcdefghij") for _ in range(100_000))
    solved = []

    def solve(words):
        solved.extend(map(len, words))
        assert sum(solved) < 2 * len(text)
        return counter._solve_words(words)

    counter._words = Units(solve)
    total, (words,), each = counter.counts([text])
    assert words == [text] and total[0] > token_counts.LIMIT
    cut = counter.cut(words, each, token_counts.LIMIT)
    count = lambda k: len(library.encode(text[:k], add_special_tokens=False).ids)
    assert count(cut) <= token_counts.LIMIT
    assert all(count(k) > token_counts.LIMIT for k in range(cut + 1, cut + 40))


def test_units_are_bounded_by_size():
    solve = lambda units: [bytes(4 * len(u)) for u in units]
    units = Units(solve, stored=10_000)
    for i in range(40):
        for _ in range(2):
            codes, answers = units([f"{i:03}" * 300, "a"])
            assert sorted(map(len, answers)) == [4, 3600] and len(codes) == 2
            assert sum(map(len, units._young.values())) <= 10_000
            assert sum(map(len, units._old.values())) <= 10_000


def test_neighbours_follow_the_merges():
    rank = {("a", "b"): 0, ("b", "a"): 1, ("ab", "a"): 2, ("a", "ab"): 3, ("b", "b"): 4}
    texts = ["a", "b", "ab", "ba", "aba", "aab", "bb"]
    pairs = lattice.Pairs(texts, rank.get)
    n = len(texts)
    left, right = np.divmod(np.arange((n + 1) * n), n)
    expected = [
        pairs.merged(pairs.texts[x] + texts[y]) == [*([texts[x]] if x < n else []), texts[y]]
        for x, y in zip(left.tolist(), right.tolist(), strict=True)
    ]
    assert pairs.follow(left, right).tolist() == expected
    assert pairs.follow(left, right).tolist() == expected


@pytest.mark.parametrize("together", [50, 400_000])
def test_sentence_pieces(make, pieces, monkeypatch, together):
    monkeypatch.setattr(sentence_pieces, "TOGETHER", together)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces)
    texts = ODD + noise(4)
    codec = sentence_pieces.Codec(pieces)
    ids, bounds = codec.encode(texts)
    for text, a, b in zip(texts, bounds, bounds[1:], strict=False):
        assert ids[a:b].tolist() == library.encode(text)
        assert codec.decode(ids[a:b].tolist()) == text.replace("▁", " ")


def test_sentence_piece_tables(make, pieces):
    docs = make(ODD + noise(5, 50))
    by_id = dict(texts_of(docs))
    encoded = sentence_pieces.encode(docs, pieces)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces)
    for r in encoded.collect():
        assert r.ids == library.encode(by_id[r.doc_id]) and r.n_tokens == len(r.ids)
    for r in sentence_pieces.decode(encoded, pieces).collect():
        assert r.text == by_id[r.doc_id].replace("▁", " ")
    for r in sentence_pieces.round_trip(docs, pieces).collect():
        assert r.same == ("▁" not in by_id[r.doc_id])
    assert sentence_pieces.encode(make([], odd=False), pieces).count() == 0


def test_sentence_pieces_on_the_smallest_table(spark, pieces):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    by_id = dict(texts_of(docs))
    for r in sentence_pieces.encode(docs, pieces).collect():
        assert r.ids == library.encode(by_id[r.doc_id])


def test_chat(spark, byte_pairs, monkeypatch):
    rows = [
        (-1, 0, "user", SPECIAL), (-1, 1, "assistant", SPECIAL), (0, 2, "assistant", "é🙂\n"),
        (0, 1, "user", None), (0, 3, "assistant", ""), (0, 0, None, "<\\|a<|<\\\\|"),
        (1, 0, "a\\n\nb<|", "x"), (1, 0, "assistant", "<|endoftext|>"), (1, None, "assistant", "\n\n"),
        (None, 0, "assistant", "lost"), (2, 0, "user", "long " * 20_000),
        (3, 0, "assistant", "twice"), (3, 0, "assistant", "twice"),
    ]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    expected = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or ""))
        said = "".join(t or "" for _, _, role, t in own if role == "assistant")
        turns = "".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in own)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected[conv] = (len(own), digest(turns), len(said), digest(said))
    found = chat.chat_digests(table.withColumn("ids", table.text), byte_pairs).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in found} == expected
    formatted = chat.format_chats(table, byte_pairs).collect()
    for r in formatted:
        assert len(r.ids) == len(r.loss_mask)
    assert chat.chat_digests(table.limit(0), byte_pairs).count() == 0


def test_chat_pieces_have_the_same_tokens(byte_pairs, monkeypatch):
    turns = [t for i in range(20) for t in (("user", f"say {i}"), ("assistant", f"é{i}\n\n"))]
    whole = chat.encode(turns, byte_pairs)
    monkeypatch.setattr(chat, "PIECE", 10)
    parts = list(chat._pieces(iter(turns), byte_pairs))
    assert len(parts) > 5
    assert [i for p in parts for i in p.ids] == whole.ids
    assert [x for p in parts for x in p.loss] == whole.loss


def test_posterior_equals_brute_force(spark):
    """Expectation maximisation over the documents one by one, with products of likelihoods."""
    docs = spark.read.parquet(f"{SF_DIR}/../sf0.01/documents.parquet").select("doc_id", "text")
    rules = list(quality.votes())
    voted = quality.features(docs).withColumns(quality.votes()).collect()
    votes = np.array([[r[k] for k in rules] for r in voted])
    good, right = 0.7, np.empty((len(rules), 2))
    for column, prior in enumerate((quality.PRIOR_GOOD, quality.PRIOR_BAD)):
        right[:, column] = prior[0] / sum(prior)

    def posterior():
        if_good = np.where(votes == 1, right[:, 0], np.where(votes == 0, 1 - right[:, 0], 1.0))
        if_bad = np.where(votes == 1, 1 - right[:, 1], np.where(votes == 0, right[:, 1], 1.0))
        a, b = good * if_good.prod(axis=1), (1 - good) * if_bad.prod(axis=1)
        return a / (a + b)

    for _ in range(quality.STEPS):
        p, before = posterior(), (good, right.copy())
        good = (p.sum() + 7) / (len(p) + 10)
        for k in range(len(rules)):
            voted_good, voted_bad = votes[:, k] == 1, votes[:, k] == 0
            either = voted_good | voted_bad
            a, b = quality.PRIOR_GOOD
            right[k, 0] = min((p[voted_good].sum() + a) / (p[either].sum() + a + b), 0.9999)
            a, b = quality.PRIOR_BAD
            share = ((1 - p)[voted_bad].sum() + a) / ((1 - p)[either].sum() + a + b)
            right[k, 1] = max(min(share, 0.9999), 1 - right[k, 0])
        if max(abs(good - before[0]), np.abs(right - before[1]).max()) < quality.CLOSE:
            break
    expected = dict(zip((r.doc_id for r in voted), posterior(), strict=True))
    found = quality.quality(docs).collect()
    assert len(found) == len(expected)
    for r in found:
        assert r.p_good == pytest.approx(expected[r.doc_id], abs=1e-6)
        near = abs(expected[r.doc_id] - quality.THRESHOLD) < 1e-6
        assert near or r.kept == (not r.base_failed and expected[r.doc_id] >= quality.THRESHOLD)


def test_licenses(make):
    texts = [
        "Released under the MIT License.", "the mit\nLicense and CC BY-NC, cc by", "GNU general",
        "x GNU General Public License, v3\nLicensed under the Apache License, Version 2.0.",
        "Licensed Apache the under\nLicense Version 2.0", "ccby é cc  by", "Apache Äpache license",
    ] + noise(6, 30)
    docs = make(texts)
    by_id = dict(texts_of(docs))
    for r in licenses.scan(docs).collect():
        words = re.findall(
            r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
            re.sub("[A-Z]", lambda m: m[0].lower(), by_id[r.doc_id]),
        )
        places = [
            (k, label)
            for k in range(len(words))
            for phrase, label in licenses.PHRASES.items()
            if words[k : k + len(phrase.split())] == phrase.split()
        ]
        starts = [k for k, _ in places]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        base = sorted({label for _, label in places})
        assert r.base_labels == ",".join(base)
        best, more, n_lines, n_windows = 0.0, set(), 0, 0
        said = licenses.words_of(by_id[r.doc_id])
        for name, template in licenses.TEMPLATES.items():
            own = licenses.words_of(template)
            size, step = licenses.window_of(len(own))
            for a in range(0, len(said), step):
                share = len(set(own) & set(said[a : a + size])) / len(set(own))
                if share >= licenses.THRESHOLD:
                    best, more, n_windows = max(best, share), more | {name}, n_windows + 1
        for line in by_id[r.doc_id].split("\n"):
            block = set(licenses.words_of(line))
            shares = {
                name: len(block & set(own)) / len(set(own))
                for name, own in ((k, licenses.words_of(t)) for k, t in licenses.TEMPLATES.items())
            }
            hits = {name: x for name, x in shares.items() if x >= licenses.THRESHOLD}
            n_lines += bool(hits)
            best, more = max([best, *hits.values()]), more | set(hits)
        assert r.labels == ",".join(sorted({*base, *more}))
        assert r.score == pytest.approx(best)
        assert (r.n_lines, r.n_windows) == (n_lines, n_windows)
    assert licenses.scan(make([], odd=False)).count() == 0


def test_licenses_over_line_ends(make):
    texts = {
        "# GNU Lesser General Public\n# License as published": ("lgpl-3.0", 1.0),
        "subject to the terms of the Mozilla Public\n * License, v. 2.0.": ("mpl-2.0", 1.0),
        "x\nsubject to the terms of Mozilla Public\nLicense v. 2.0": ("mpl-2.0", 1.0),
        "subject to the\nof the Mozilla Public\nLicense, v. 2.0": ("mpl-2.0", 10 / 11),
        "subject\nto the terms of the Mozilla Public License, v. 2.0": ("mpl-2.0", 1.0),
        "GNU Lesser\nGeneral Public\nLicense\n\nx GNU Lesser General\nPublic License": ("lgpl-3.0", 1.0),
        f"GNU Lesser General\n{'word ' * 10}Public License": ("", 0.0),
    }
    for r in licenses.scan(make(list(texts), odd=False)).collect():
        labels, score = list(texts.values())[r.doc_id]
        assert r.labels == labels and r.score == pytest.approx(score)


@pytest.mark.parametrize("name", list(licenses.TEMPLATES))
def test_each_template_wrapped_at_any_place(name):
    """With comment signs at the line starts, after any number of words, whatever its length."""
    rng = random.Random(len(name))
    template = licenses.TEMPLATES[name].split()
    known = licenses.Templates(licenses.TEMPLATES, {})
    for _ in range(60):
        before, width = rng.randrange(300), rng.randint(1, 12)
        lines = [" * " + " ".join(template[k : k + width]) for k in range(0, len(template), width)]
        text = prose(rng, before) + "\n" + "\n".join(lines) + "\n" + prose(rng, rng.randrange(300))
        assert name in licenses._scan(text, known)[5].split(",")
        # a tenth of its words, rounded down, may be missing
        own = list(dict.fromkeys(licenses.words_of(licenses.TEMPLATES[name])))
        gone = set(rng.sample(own, int((1 - licenses.THRESHOLD) * len(own) + 1e-9)))
        fewer = [w for w in licenses.words_of(licenses.TEMPLATES[name]) if w not in gone]
        text = "\n".join(w.decode() for w in fewer)
        assert name in licenses._scan(text, known)[5].split(",")


def test_language(spark):
    docs = spark.read.parquet(f"{SF_DIR}/../sf0.01/documents.parquet")
    model = language_id.train(docs)
    rows = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    # Labels of held-out rows are never seen.
    blind = docs.withColumn("lang", F.when(~language_id.held_out(), F.col("lang")))
    again = language_id.train(blind)
    assert again.languages == model.languages and (again.table == model.table).all()
    kept = language_id.keep_known(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() >= 0.99 * docs.count()


def test_repeated_row_changes_no_language(spark):
    docs = spark.read.parquet(f"{SF_DIR}/../sf0.01/documents.parquet").select("doc_id", "text", "lang")
    one = docs.filter("lang = 'en' AND text IS NOT NULL AND crc32(string(doc_id)) % 4 <> 2").limit(1)
    repeated = one.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(10_000)))).drop("n")
    rows = docs.unionByName(repeated)
    sample = language_id._sample(rows)
    assert sample.count() == language_id._sample(docs).count()
    found, expected = language_id.train(rows), language_id.train(docs)
    assert found.languages == expected.languages == ["de", "en", "es", "fr"]
    assert (found.table == expected.table).all() and found.least == expected.least
    # texts that differ under one doc_id: the smallest is learned
    other = one.withColumn("text", F.lit("!"))
    assert language_id._sample(docs.unionByName(other)).filter("text = '!'").count() == 1


@pytest.mark.parametrize("left_out", ["en", "es"])
def test_unlearned_language_is_rejected(spark, left_out):
    docs = spark.read.parquet(f"{SF_DIR}/../sf0.1/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train(docs.withColumn("lang", F.nullif("lang", F.lit(left_out))))
    assert left_out not in model.languages
    rows = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    share = rows.filter("score > 0").groupBy((F.col("lang") == left_out).alias("out")).agg(
        F.avg(F.col("rejected").cast("int")).alias("share")
    )
    share = {r.out: r.share for r in share.collect()}
    assert share[True] >= 0.9 and share[False] <= 0.01


def test_language_cases(make):
    docs = make(["hello there friend", "1234 !!", "x"])
    model = language_id.train(docs)
    found = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert [found[i].lang_pred for i in range(5)] == ["en", "und", "en", "und", "und"]
    assert found[1].score == 0 and found[1].rejected
    empty = make([], odd=False)
    none = language_id.train(empty)
    assert none.languages == []
    assert language_id.identify(empty, none).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def pieces_of(text):
    return -(-len((text or "").encode()) // 4)


def mixed_docs(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(1, 30)), "big" if i % 10 else f"s{i % 40}") for i in range(900)]
    rows += [(900, None, None), (901, "", "bare"), (902, "one two", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


@pytest.mark.parametrize(("entropy", "repeats"), [(0.9, 1.5), (0.99, 50.0), (0.1, 1.1)])
def test_mixing(spark, entropy, repeats):
    docs = mixed_docs(spark)
    words = {r.doc_id: pieces_of(r.text) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    tokens = Counter()
    for i, n in words.items():
        tokens[source[i]] += n
    filled = {s: n for s, n in tokens.items() if n}

    def entropy_at(t):
        z = sum(n**t for n in filled.values())
        return -sum(n**t / z * math.log(n**t / z) for n in filled.values())

    def last(meets, low=0.0, high=1.0):
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if meets(mid) else (low, mid)
        return low

    most, least = max(filled.values()), min(filled.values())
    natural = entropy_at(1) >= entropy * math.log(len(filled))
    t = 1.0 if natural else last(lambda t: entropy_at(t) >= entropy * math.log(len(filled)))
    if (most / least) ** (1 - t) > repeats:
        t = last(lambda t: (most / least) ** (1 - t) > repeats)
    rows = mixing.schedule(docs, entropy, repeats).collect()
    read = Counter(r.doc_id for r in rows)
    assert set(read) == set(words)
    spent = Counter()
    for i, times in read.items():
        spent[source[i]] += times * words[i]
    longest = max(words.values())
    for s, n in filled.items():
        budget = n * (most / n) ** (1 - t)
        assert budget - longest - 0.01 * n <= spent[s] <= budget + 0.01 * n + 1e-6
        times = {read[i] for i in words if source[i] == s}
        assert max(times) - min(times) <= 1
    assert {(r.doc_id, r.epoch) for r in rows} == {
        (i, k) for i, n in read.items() for k in range(1, n + 1)
    }
    mixed = mixing.mix(docs, entropy, repeats)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == read


def test_tokens_in_scripts_without_spaces(make, byte_pairs):
    """Shares of sources in different scripts are near those of a vocabulary's tokens."""
    rng = random.Random(6)
    kana = "あいうえおかきくけこさしすせそ"
    texts = ["".join(rng.choice(kana) for _ in range(400)) for _ in range(4)]
    texts += [prose(rng, 100) for _ in range(4)] + ["ab" * 300, "", None]
    docs = make(texts, odd=False)
    sizes = [r.n for r in docs.orderBy("doc_id").select(mixing.tokens().alias("n")).collect()]
    assert sizes == [pieces_of(t) for t in texts]
    real = Tokenizer.from_file(byte_pairs)
    counts = [len(real.encode(t or "").ids) for t in texts]
    share = lambda n: sum(n[:4]) / sum(n)
    # by words these four texts would have a hundredth
    assert abs(share(sizes) - share(counts)) < 0.25 * share(counts)
    # a caller's counts go before the estimate
    given = docs.withColumn("source", F.when(F.col("doc_id") < 4, "a").otherwise("b"))
    n = F.when(F.col("doc_id") < 4, 100).otherwise(10)
    read = Counter(r.source for r in mixing.mix(given, 1.0, 10.0, n).collect())
    assert read["a"] == 4 and read["b"] == 40


def test_mixing_cases(make):
    assert mixing.mix(make([], odd=False)).count() == 0
    docs = make(["", None], odd=False)
    assert mixing.mix(docs).count() == 2
    assert mixing.mix(make(["a b"], odd=False)).columns == docs.columns
