"""Exact dedup, the Jaccard join and suffix dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from stintbook.llm import (
    components,
    exact_dedup,
    jaccard_join,
    mixing,
    shingles,
    suffix_dedup,
)

from .conftest import changed, prose

WHITE = re.compile("[\x20\x09-\x0d]")


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def test_exact_dedup(make):
    rng = random.Random(1)
    base = [prose(rng, 20) for _ in range(5)]
    docs = make([rng.choice(base) + " " * rng.randrange(3) for _ in range(60)] + ["Zed"] * 40)
    groups: dict[str, list] = {}
    for i, text in rows_of(docs):
        groups.setdefault(WHITE.sub("", text), []).append((-len(text), i))
    found = exact_dedup.duplicates(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        assert r.text_sha256 in {hashlib.sha256(t.encode()).hexdigest() for t in groups}
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    for r in found:
        group = by_sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == (min(group)[1], len(group))
        assert not r.kept or r.keep_id == r.doc_id
    assert sum(r.kept for r in found) == len(groups)
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    assert left.count() == len(groups)


def test_exact_dedup_support_splits_hot_groups(make, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SUPPORT", 0.2)
    docs = make(["same"] * 50 + [f"text {i // 2}" for i in range(40)])
    found = exact_dedup.duplicates(docs).collect()
    assert len(found) == docs.count()
    assert sum(r.kept for r in found) == 1 + 20 + 1


def brute_components(rows):
    sets = {}
    for i, text in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
        n = len(words)
        sets[i] = {tuple(words[k : k + 5]) for k in range(n - 4)} if n > 4 else {tuple(words)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed):
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([3, 5, 6, 8, 12, 40, 120])) for _ in range(12)]
    texts = [changed(rng, rng.choice(base), rng.choice([0, 0.01, 0.03, 0.1])) for _ in range(150)]
    line = prose(rng, 15)
    texts += [line + prose(rng, rng.choice([5, 20, 60])) for _ in range(60)]
    return [*texts, "ONE two", "one\ttwo", "one", "x " * 3000]


@pytest.mark.parametrize(("seed", "group", "block"), [(1, 24, 2000), (2, 2, 2000), (3, 3, 10)])
def test_jaccard_join(make, seed, group, block):
    docs = make(near_copies(seed))
    expected = brute_components(rows_of(docs))
    found = jaccard_join.components(docs, group, block).collect()
    assert len(found) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected


def test_jaccard_join_of_one_split_cluster(make, monkeypatch):
    # all sets are candidates of each other, so only the comparison of blocks decides
    def star(docs, described, group):
        sets = described.filter("n_shingles > 0").select("set_id").distinct()
        least = sets.agg({"set_id": "min"}).first()[0]
        return sets.selectExpr("set_id AS a", f"{least} AS b")

    monkeypatch.setattr(jaccard_join, "_candidates", star)
    docs = make(near_copies(6))
    found = jaccard_join.components(docs, block=20).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(
        rows_of(docs)
    )


def test_jaccard_join_of_one_id_with_several_texts(make):
    rng = random.Random(7)
    a, b = prose(rng, 100), prose(rng, 100)
    docs = make([a, a + " end", b, b + " end"], odd=False).selectExpr(
        "CASE WHEN doc_id IN (0, 2) THEN 5 ELSE doc_id END AS doc_id", "text"
    )
    found = jaccard_join.components(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (3, 3), (5, 1), (5, 3)]


def test_jaccard_stage(make):
    docs = make(near_copies(4))
    left = jaccard_join.keep_first(docs)
    assert left.columns == docs.columns
    expected = {i for i, (_, c) in brute_components(rows_of(docs)).items() if c == i}
    assert {r.doc_id for r in left.collect()} == expected


def test_jaccard_stage_keeps_rows_without_an_id(make, spark):
    rng = random.Random(9)
    a, b, c = (prose(rng, 60) for _ in range(3))
    more = [b, c, c.upper(), c + " ", None, "", "\n", "one"]
    docs = make([a, a + " end", b])
    rows = [(None, t, "en", "s9", i, None) for i, t in enumerate(more)]
    left = jaccard_join.keep_first(docs.unionByName(spark.createDataFrame(rows, docs.schema)))
    assert left.columns == docs.columns
    found = left.collect()
    assert {r.doc_id for r in found} - {None} == {0, 2, 3, 4}
    nameless = [r for r in found if r.doc_id is None]
    texts = sorted((r.text for r in nameless if r.text), key=str)
    assert texts == sorted([min(c, c.upper(), c + " "), "\n", "one"])
    assert sum(not r.text for r in nameless) == 2
    assert all(rows[r.n_chars] == tuple(r) for r in nameless)


def test_set_ids_follow_sets():
    hashes, bounds = shingles.shingle_sets(["a b c d e f", "A  b\nc d e F", "", "a b", "b a", "a"])
    ids = shingles.set_ids(hashes, bounds)
    assert np.diff(bounds).tolist() == [2, 2, 0, 1, 1, 1]
    assert ids[0] == ids[1] and ids[2] == 0 and len(set(ids.tolist())) == 5


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(7, 7)]
    edges += [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    found = components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in found} == {x: find(x) for x in linked}
    assert len(found) == len(linked)


def brute_repeats(rows):
    first: dict[bytes, int] = {}
    for i, text in rows:
        raw = text.encode()
        for k in range(len(raw) - 49):
            first[raw[k : k + 50]] = min(first.get(raw[k : k + 50], i), i)
    out = {}
    for i, text in rows:
        raw = text.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", gone))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("shard", [1 << 20, 3_000])
def test_suffix_dedup(make, shard):
    rng = random.Random(6)
    base = "".join(rng.choice("ab é\0") for _ in range(500))
    texts = []
    for _ in range(120):
        a = rng.randrange(300)
        texts.append(base[a : a + rng.randrange(200)] + prose(rng, rng.randrange(12)))
    texts += [base, base, "a" * 300, "b" + "a" * 120, "x" * 49, "x" * 49, "y" * 50, "y" * 50]
    rng.shuffle(texts)
    docs = make(texts)
    expected = brute_repeats(rows_of(docs))
    found = suffix_dedup.repeated_bytes(docs, shard).collect()
    assert len(found) == docs.count()
    assert {(r.doc_id, tuple(r)[1:]) for r in found} == set(expected.items())


def test_suffix_dedup_on_the_smallest_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    expected = brute_repeats(rows_of(docs))
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeated_bytes(docs).collect()} == expected


def test_shards_hold_whole_names():
    rng = np.random.default_rng(4)
    tags = np.append(rng.integers(0, 300, 900), np.full(100, 300)).astype(np.uint32)
    sizes = rng.integers(50, 80, len(tags))
    found = suffix_dedup._shards(sizes, tags, 1_000)
    assert sorted(k for parts in found for part in parts for k in part) == list(range(len(tags)))
    held = [{int(tags[k]) for part in parts for k in part} for parts in found]
    assert sum(map(len, held)) == len(set(tags.tolist()))
    # only the last name is larger than a shard
    assert [len(parts) > 1 for parts in found] == [300 in names for names in held]
    assert max(sizes[part].sum() for parts in found for part in parts) <= 2 * 1_000 + 80
    assert suffix_dedup._shards(sizes[:0], tags[:0], 1_000) == []


def test_suffix_dedup_of_a_name_with_several_shards(make):
    """One phrase between other words in each text, some of which come back in part."""
    rng = random.Random(9)
    phrase = "the one phrase that they all have"
    texts = [f"{prose(rng, 9)} {phrase} {prose(rng, 9)}" for _ in range(60)]
    texts += [t[k : k + 90] for k, t in enumerate(texts[:30])]
    rng.shuffle(texts)
    docs = make(texts)
    found = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeated_bytes(docs, 200).collect()}
    assert found == brute_repeats(rows_of(docs))


def test_suffix_array_and_prefixes():
    rng = random.Random(7)
    for _ in range(40):
        raw = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 300)))
        text = np.frombuffer(raw, np.uint8)
        key = suffix_dedup.eights(text)
        order = suffix_dedup.suffix_array(key).tolist()
        assert sorted(order) == list(range(len(raw)))
        keys = [raw[i : i + 64].ljust(64, b"\0") for i in order]
        assert keys == sorted(keys)
        common = suffix_dedup.common_prefixes(text, key, np.array(order))
        for k, size in enumerate(common.tolist()):
            if k:
                x, y = raw[order[k - 1] :][:64], raw[order[k] :][:64]
                same = next((j for j in range(min(len(x), len(y))) if x[j] != y[j]), min(len(x), len(y)))
                assert size == same


def test_empty_tables(make):
    docs = make([], odd=False)
    assert exact_dedup.duplicates(docs).count() == 0
    assert exact_dedup.drop_duplicates(docs).count() == 0
    assert jaccard_join.components(docs).count() == 0
    assert jaccard_join.keep_first(docs).count() == 0
    assert suffix_dedup.repeated_bytes(docs).count() == 0


HELPERS = (
    "row id sha size best rows hot hash place minus nameless _sha _key _block _epoch _full _cut "
    "_source _set_id _row _stays_id _stays_sha key block of set_id own_set full last_block "
    "last_place cut epoch n_tokens component_id a b"
).split()


@pytest.mark.parametrize("stage", ["exact", "near", "mixed"])
def test_stages_keep_all_columns(spark, stage):
    """A caller's column may have any name, those of helper columns too."""
    run = {
        "exact": exact_dedup.drop_duplicates, "near": jaccard_join.keep_first, "mixed": mixing.mix,
    }[stage]
    rng = random.Random(7)
    texts = [prose(rng, 20) for _ in range(6)]
    rows = [(i, t, "s") for i, t in enumerate([*texts, texts[0], texts[1] + " x", None, ""])]
    rows += [(None, texts[2], "s"), (None, "other words", None)]
    schema = "doc_id bigint, text string, source string"
    docs = spark.createDataFrame(rows, schema)
    plain = run(docs)
    for names in (HELPERS, ["a.b", "my column", "MAP"]):
        wide = docs.withColumns({c: F.concat(F.lit(f"{c}:"), "doc_id") for c in names})
        found = run(wide)
        assert found.columns == wide.columns
        assert sorted(map(repr, found.select("doc_id", "text", "source").collect())) == sorted(
            map(repr, plain.collect())
        )
        for r in found.collect():
            assert all(r[c] == (None if r.doc_id is None else f"{c}:{r.doc_id}") for c in names)


@pytest.mark.parametrize("support", [None, 0.4])
def test_the_named_row_stays(spark, monkeypatch, support):
    if support:
        monkeypatch.setattr(exact_dedup, "SUPPORT", support)
    rng = random.Random(3)
    rows = [(1, "a   b   c", 0), (1, "a b c", 1), (2, "a b  c", 2), (None, "a     b c  ", 3)]
    rows += [(7, "x y", 4)] * 50 + [(8, "x y", 5)] * 3 + [(9, "x  y", 6)] * 2
    rows += [(4, "q r", 7), (4, "q\tr", 8), (4, "q\nr", 9), (None, None, 10), (5, "", 11), (6, "", 12)]
    for _ in range(3):
        rng.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int").repartition(3)
        found = exact_dedup.drop_duplicates(docs).collect()
        best = {}
        for i, t, n in rows:
            key = "".join((t or "").split())
            order = (-len(t or ""), i is None, i or 0)
            best[key] = min(best.get(key, (order,)), (order,))
        assert len(found) == len(best)
        for r in found:
            key = "".join((r.text or "").split())
            assert (-len(r.text or ""), r.doc_id is None, r.doc_id or 0) == best[key][0]
    assert exact_dedup.drop_duplicates(docs.limit(0)).count() == 0


def test_losers_of_frequent_texts_are_not_moved(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot " * 50)).otherwise(F.concat(F.lit("t"), "id")).alias("text"),
    )
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.count() == 20_000 - 6_667 + 1
    # they are left out by the broadcast table, below the exchange of the texts
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    ordinary = next(i for i, line in enumerate(lines) if "Join LeftOuter, (sha" in line)
    assert any("broadcast" in line for line in lines[ordinary + 1 :])


def test_each_text_of_a_doc_id_is_decided(spark):
    """A row whose text is a near copy of another document goes, even if its doc_id stays."""
    rng = random.Random(5)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(5, a), (7, a + " x"), (5, b), (3, b + " y"), (5, c), (None, c), (None, "own words here"), (5, a)]
    found = jaccard_join.keep_first(spark.createDataFrame(rows, "doc_id int, text string"))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(
        map(repr, [(5, a), (5, a), (3, b + " y"), (5, c), (None, "own words here")])
    )


def test_bytes_of_rows_without_ids_only(spark, monkeypatch):
    """They count as one document, and lie in several blocks."""
    rng = random.Random(11)
    shared = prose(rng, 60)
    rows = [(None, shared), (None, shared), (None, f"x {shared}"), (None, None), (None, "")]
    schema = "doc_id int, text string"
    found = suffix_dedup.repeated_bytes(spark.createDataFrame(rows, schema)).collect()
    assert [(r.n_removed, r.n_spans) for r in found] == [(0, 0)] * 5
    monkeypatch.setattr(suffix_dedup, "BLOCK", 100)
    named = [(5, f"{shared} y"), *rows]
    found = suffix_dedup.repeated_bytes(spark.createDataFrame(named, schema)).collect()
    assert len(found) == 6
    size = len(shared.encode())
    assert sorted(r.n_removed for r in found) == [0, 0, 0, size, size, size]
