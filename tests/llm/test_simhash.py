"""SimHash groups against brute force over all pairs."""

import itertools

import pytest
import xxhash

from scriptorium.llm.common import read_table
from scriptorium.llm.simhash import components, covering_masks, drop_near_duplicates, links, near_duplicates


def brute_print(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def brute_groups(prints, radius=2):
    """{node: smallest reachable node} over (id, fingerprint) pairs."""
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= radius:
            low, high = sorted((find(i), find(j)))
            root[high] = low
    return {i: find(i) for i, _ in prints}


def test_every_close_pair_collides_in_some_table():
    masks = covering_masks(2)
    assert len(masks) == 7
    for i, j in itertools.combinations(range(64), 2):
        assert any(not (1 << i | 1 << j) & m for m in masks)


def test_query_equals_brute_force(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text").collect()
    prints = [(r.doc_id, brute_print(r.text)) for r in rows]
    groups = brute_groups(prints)
    expected = {(i, f"{p:016x}", groups[i]) for i, p in prints}
    assert {tuple(r) for r in near_duplicates(docs).collect()} == expected


def test_dense_fingerprints_link_like_all_pairs(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(4)]
    values = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for b in base for _ in range(150)})
    signed = [v - 2**64 if v >> 63 else v for v in values]
    found = components(links(spark.createDataFrame([(v,) for v in signed], "fingerprint bigint")))
    got = {r.node: r.root for r in found.collect()}
    unsigned = {s: u for s, u in zip(signed, values, strict=True)}
    expected = brute_groups([(s, unsigned[s]) for s in signed])
    groups = lambda d: {frozenset(k for k in d if d[k] == v) for v in d.values()}
    assert groups({s: got.get(s, s) for s in signed}) == groups(expected)


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(200, 200), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "fingerprint bigint, center bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}
    assert components(spark.createDataFrame([], "fingerprint bigint, center bigint")).count() == 0


@pytest.fixture
def odd(spark):
    long = "word " * 30000
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\t ", "c"), (4, "one two", "d"), (5, "one two", "e"), (5, "one two", "e"),
            (6, long, "f"), (7, "ONE TWO", "g"), (None, "one two", "h")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string")


def test_odd_rows(spark, odd):
    got = near_duplicates(odd).collect()
    assert len(got) == 9
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == "0" * 16 and {by[k].component_id for k in (1, 2, 3)} == {1}
    assert {by[k].component_id for k in (4, 5, 7, None)} == {4}
    assert near_duplicates(odd.limit(0)).count() == 0
    left = drop_near_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 4, 6, None]
    assert drop_near_duplicates(odd.where("doc_id = 5")).count() == 1
