"""Phrases and collocations against counting in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from scriptorium.llm.collocations import Sequence, collocations, frequent_phrases, phrases_of, shard_of
from scriptorium.llm.common import read_table


def pieces_of(text):
    text = (text or "").translate({k: k + 32 for k in range(65, 91)})
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n-\r]", text)]


def counts_of(rows, depth=4):
    found, lefts, rights, n = Counter(), Counter(), Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces_of(text):
            n[lang] += len(words)
            for size in range(1, depth + 1):
                for at in range(len(words) - size + 1):
                    key = (lang, " ".join(words[at : at + size]))
                    found[key] += 1
                    lefts[key] += at > 0
                    rights[key] += at + size < len(words)
    return found, lefts, rights, n


def brute(rows, depth=4, least=30, best=2000):
    found, _, _, n = counts_of(rows, depth)
    out = {}
    frequent = {k: f for k, f in found.items() if f >= least and " " in k[1]}
    longer = Counter()
    for (lang, phrase), f in frequent.items():
        words = phrase.split(" ")
        for size in range(2, len(words)):
            for at in range(len(words) - size + 1):
                key = lang, " ".join(words[at : at + size])
                longer[key] = max(longer[key], f)
    for (lang, phrase), a in frequent.items():
        words = phrase.split(" ")
        cuts = []
        for k in range(1, len(words)):
            left, right = found[lang, " ".join(words[:k])], found[lang, " ".join(words[k:])]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        if not 100 * longer[lang, phrase] >= 80 * a:
            out.setdefault(lang, []).append((-score, -a, phrase.encode(), left, right))
    return sorted(
        (lang, k, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for k, (s, a, p, x, y) in enumerate(sorted(rows)[:best], 1)
    )


def test_intervals_count_every_phrase():
    rng = random.Random(1)
    for _ in range(40):
        rows = [(rng.choice("ab"), " ".join(rng.choice(["x", "y", "z", "x.", "y\n"]) for _ in range(rng.randrange(30))).encode()) for _ in range(9)]
        shard = shard_of(rows)
        found, lefts, rights, _ = counts_of([(t.decode(), lang) for lang, t in rows])
        got = {}
        for words, *counts in phrases_of(Sequence.of(shard.ids), len(shard.words)):
            for ids, *row in zip(words.tolist(), *(c.tolist() for c in counts)):
                got[shard.langs[ids[0]].as_py(), " ".join(shard.words[k].as_py() for k in ids)] = tuple(row)
        assert got == {k: (f, lefts[k], rights[k]) for k, f in found.items()}


def test_empty_sequences():
    assert list(phrases_of(Sequence.of(np.zeros(3, np.int32)), 1)) == []
    assert shard_of([("a", b""), ("b", b" . ")]).words.to_pylist() == [""]


@pytest.mark.parametrize("bits, shard_bytes", [(1 << 26, 16 << 20), (64, 2000)])
def test_given_table(spark, sf_dir, bits, shard_bytes):
    """A bitmap that is full, and shards of few texts, change nothing."""
    docs = read_table(spark, sf_dir, "documents")
    rows = [(r.text, r.lang) for r in docs.collect()]
    got = sorted(map(tuple, collocations(docs, least=6, best=300, bits=bits, shard_bytes=shard_bytes).collect()))
    assert got == brute(rows, least=6, best=300) and len(got) > 50


def test_phrases_and_their_extensions(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    found, lefts, rights, n = counts_of([(r.text, r.lang) for r in docs.collect()], 3)
    phrases, totals = frequent_phrases(docs, 3, 10)
    got = {(r.lang, r.phrase): (r.size, r.f, r.lefts, r.rights) for r in phrases.collect()}
    assert got == {k: (k[1].count(" ") + 1, f, lefts[k], rights[k]) for k, f in found.items() if f >= 10}
    assert {r.lang: r.n for r in totals.collect()} == {k: v for k, v in n.items() if v}


def test_odd_rows(spark):
    rows = [(None, None), ("", "en"), (None, "en"), ("A b. c D", None), ("a B\tc; d", "und"), ("a b c d " * 20_000, "x"), ("é É ß a b", "x"),
            ("a b c", "x"), ("a b c", "x"), ("b c   d", "")]
    docs = spark.createDataFrame([(*r, "c", 3) for r in rows], "text string, lang string, phrase string, n int")
    for least in (1, 2, 3):
        assert sorted(map(tuple, collocations(docs, least=least).collect())) == brute(rows, least=least)
    assert collocations(docs.limit(0)).count() == 0


def test_scores_past_64_bits(spark):
    sql = "select (cast(2000000 as decimal(38,0)) * cast(a as decimal(19,0))) div (l + r) as s from values (9000000000000000L, 9000000000000000L, 9000000000000001L) t(a, l, r)"
    assert spark.sql(sql).first().s == 2000000 * 9000000000000000 // 18000000000000001
