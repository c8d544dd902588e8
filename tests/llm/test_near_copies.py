"""Near copies against brute-force Jaccard similarity over all pairs."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from scriptorium.llm import near_copies
from scriptorium.llm.common import read_table
from scriptorium.llm.near_copies import _rows as rows_of
from scriptorium.llm.near_copies import _alone, bitmap_of, drop_near_copies


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """doc_ids of the smallest member of each component of pairs at 0.8 or more."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] | sets[j])
        if 5 * len(sets[i] & sets[j]) >= 4 * both:
            low, high = sorted((find(i), find(j)))
            root[high] = low
    return sorted(i for i in sets if find(i) == i)


def test_given_table(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == brute_kept(rows)


@pytest.mark.parametrize("sample", [1, 16])
def test_recall_on_edited_texts_with_common_lines(spark, sample):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(500)}"
    line = [word() for _ in range(25)]
    rows = []
    for base in range(12):
        text = [word() for _ in range(rng.choice([6, 12, 40, 120, 300]))]
        text = text + line if base % 2 else text
        for _ in range(20 if base else 60):
            copy = list(text)
            for _ in range(rng.randrange(0, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy[: len(copy) - rng.randrange(3)]))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_kept(rows)
    assert sorted(r.doc_id for r in drop_near_copies(docs, sample).collect()) == want and 12 < len(want) < 200


def test_stage_drops_a_copy_with_changed_words(spark, sf_dir):
    words = [f"word{k}" for k in range(200)]
    other = [*words[:70], "x", *words[71:150], "y", *words[151:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id bigint, text string")
    assert [r.doc_id for r in dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs, sf_dir).collect()] == [1]


def test_rows_are_told_apart_by_id_and_text(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    rows = [(1, a), (5, a), (5, b), (9, b), (9, b), (None, a), (None, "c d"), (None, "c d"), (7, None), (8, "")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id bigint, text string, n int")
    got = drop_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted((r[:2] for r in map(tuple, got.collect())), key=str) == sorted([(1, a), (5, b), (None, "c d"), (7, None)], key=str)
    assert drop_near_copies(docs.limit(0)).count() == 0


def test_texts_with_one_key_are_told_apart(spark, monkeypatch):
    """Where a hash gives two texts one key, another hash is taken for all."""
    monkeypatch.setattr(near_copies, "_rows", lambda docs, seed: rows_of(docs, seed).withColumn("key", F.when(F.lit(seed) == near_copies.SEED, 7).otherwise(F.col("key"))))
    rows = [(k, " ".join(f"{k}w{j}" for j in range(30))) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == [0, 1, 2, 3, 4]


def test_bitmaps_bound_the_overlap_at_every_size(spark):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for n in (1, 40, 512, 513, 1000, 4096, 4097, 5000):
        base = rng.integers(-(1 << 62), 1 << 62, n)
        for m in (n, -(-n * 4 // 5), n + n // 5):
            shared = min(n, m) * 9 // 10
            other = np.concatenate([base[:shared], rng.integers(-(1 << 62), 1 << 62, m - shared)])
            a, b = np.unique(base), np.unique(other)
            rows.append((len(want), bitmap_of(a).tolist(), bitmap_of(b).tolist()))
            want.append((len(np.setdiff1d(a, b)), len(np.setdiff1d(b, a))))
    table = spark.createDataFrame(rows, "i int, x array<bigint>, y array<bigint>")
    got = table.select("i", _alone(F.col("x"), F.col("y")), _alone(F.col("y"), F.col("x"))).orderBy("i").collect()
    for (_, x, y), (p, q) in zip(got, want, strict=True):
        assert p * 0.4 <= x <= p and q * 0.4 <= y <= q  # never more than there are, and not far fewer


def test_a_group_of_near_copies_is_compared_with_few(spark, monkeypatch):
    """SimHash proposes, one bucket a text ties the group, and its many other buckets add no pairs."""
    draw = random.Random(3)
    base = [f"w{draw.randrange(5000)}" for _ in range(120)]
    texts = []
    for _ in range(150):
        words = list(base)
        words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counted, verified = [], near_copies._verified

    def counting(pairs, *rest):
        counted.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(near_copies, "_verified", counting)
    assert near_copies.drop_near_copies(docs).count() == 1
    assert sum(counted) <= 4 * len(texts)


def test_texts_of_one_origin_that_are_not_similar_are_not_paired(spark, monkeypatch):
    """Most of their shingles are the same, but the pairs among them are as the square of their number."""
    draw = random.Random(5)
    base = [f"w{draw.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in draw.sample(range(len(words)), 1 if i % 2 else 6):
            words[at] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counted, verified = [], near_copies._verified

    def counting(pairs, *rest):
        counted.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(near_copies, "_verified", counting)
    # the order knows all shingles here, as a sample does of those of a large group
    assert sorted(r[0] for r in near_copies.drop_near_copies(docs, sample=1).collect()) == brute_kept(rows)
    assert sum(counted) <= 8 * len(rows)  # 60 * 60 / 2 and 60 * 60 pairs in full


def test_simhash_proposes(spark):
    """Sets with one fingerprint, or with two within two bits, are candidates."""
    rows = spark.createDataFrame(
        [(1, 10, 7), (2, 10, 7), (3, 10, 4), (4, 10, -1), (5, 100, 7), (6, 0, None)], "key long, n int, print long"
    )
    found = {tuple(r) for r in near_copies._proposed(rows).collect()}
    assert (1, 2) in found and (1, 3) in found
    assert not any(4 in p or 5 in p or 6 in p for p in found)
