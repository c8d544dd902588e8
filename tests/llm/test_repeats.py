"""Suffix arrays against sorting, and removal of repeats against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

from scriptorium.llm.common import read_table
from scriptorium.llm.repeats import repeat_report, runs_of, shared_between, slices, without_repeats
from scriptorium.llm.suffix_arrays import common_prefixes, suffix_array


def test_order_and_common_prefixes():
    rng = np.random.default_rng(0)
    for trial in range(40):
        n = int(rng.integers(1, 700))
        text = rng.integers(97, 97 + rng.integers(1, 4), n).astype(np.uint8)
        if trial % 3 == 0:
            text = np.concatenate([text, text[: n // 2], text])
        data = text.tobytes()
        order, words = suffix_array(text, 1 << 20)
        want = sorted(range(len(data)), key=lambda i: data[i:])
        assert order.tolist() == want
        lcp = [0]
        for a, b in zip(want, want[1:]):
            k = 0
            while k < 50 and max(a, b) + k < len(data) and data[a + k] == data[b + k]:
                k += 1
            lcp.append(k)
        assert common_prefixes(order, words, 50).tolist() == lcp


def test_common_prefixes_of_a_partial_order():
    """Repeats far over the refined depth: ties stay in order of position, and no prefix may be overstated."""
    rng = np.random.default_rng(3)
    for trial in range(60):
        base = rng.integers(97, 99, 900).astype(np.uint8)
        other = base.copy()
        other[rng.integers(300, 900, 3)] ^= 1
        parts = [base, rng.integers(97, 99, rng.integers(1, 40)).astype(np.uint8), other[: rng.integers(500, 900)], base[rng.integers(0, 300) :], other]
        data = np.concatenate([parts[k] for k in rng.permutation(5)])
        raw = data.tobytes()
        order, words = suffix_array(data, 400)
        shared = common_prefixes(order, words, 400)
        for (a, b), h in zip(zip(order.tolist(), order[1:].tolist()), shared[1:].tolist()):
            same = raw[a : a + 400] == raw[b : b + 400] and max(a, b) + 400 <= len(raw)
            assert (h >= 400) == same, (trial, a, b, h)


def test_runs_cover_every_start_and_equal_strings_share_anchors():
    rng = random.Random(1)
    base = bytes(rng.choices(b"ab", k=900))
    texts = [base, b"", b"x" * 399, base[100:700], b"z" * 1000, base]
    text, start, n, anchor, *_ = runs_of(texts)
    of = {}
    for t, s, m, a in zip(text.tolist(), start.tolist(), n.tolist(), anchor.tolist()):
        for p in range(s, s + m):
            assert of.setdefault((t, p), a) == a
    assert set(of) == {(t, p) for t, x in enumerate(texts) for p in range(len(x) - 399)}
    known = {}
    for (t, p), a in of.items():
        assert known.setdefault(texts[t][p : p + 400], a) == a


def test_slices_cover_long_texts():
    texts = [b"a" * 5, bytes(range(250)) * 30, b"b" * 7]
    seen = collections.defaultdict(set)
    for numbers, offsets, parts in slices(texts, length=400, size=1000):
        for k, off, part in zip(numbers, offsets, parts):
            assert texts[k][off : off + len(part)] == part
            seen[k] |= set(range(off, off + max(0, len(part) - 399)))
    assert seen[1] == set(range(7500 - 399))


def test_shared_digests():
    salts = np.array([0, 0, 1, 1, 2, 2, 2])
    digests = np.array([5, 7, 7, 9, 5, 11, 12])
    assert shared_between(salts, digests).tolist() == [True, True, True, False, True, False, False]


def brute(rows, length):
    seen = collections.Counter(t[p : p + length] for _, t in rows for p in range(len(t) - length + 1))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum() + (gone[0] if len(t) else 0))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_table(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text.encode()) for r in docs.collect()]
    want = brute(rows, 400)
    assert sorted(map(tuple, repeat_report(docs).collect()), key=str) == want
    assert any(r[2] for r in want) and any(not r[2] for r in want)


@pytest.mark.parametrize("shard_contexts", [2000, 3])
def test_odd_texts(spark, shard_contexts):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choices("abcdé ", k=n))
    shared, other = noise(700), noise(450)
    rows = [(1, None), (2, ""), (3, "a" * 1000), (4, noise(3000)), (5, shared), (5, shared), (None, other), (None, other + "x")]
    rows += [(10 + k, noise(rng.randrange(50, 300)) + shared[rng.randrange(80) : 700 - rng.randrange(80)] + noise(200)) for k in range(25)]
    rows += [(50 + k, noise(300) + other[: 380 + k] + noise(300)) for k in range(12)]
    rows += [(70, noise(500) * 3), (71, shared[:399])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, start int")
    want = brute([(i, (t or "").encode()) for i, t in rows], 400)
    cut = without_repeats(docs, shard_contexts=shard_contexts)
    got = [(r.doc_id, r.n_bytes, sum(x.behind - x.start for x in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in cut.collect()]
    assert sorted(got, key=str) == want
    assert repeat_report(docs.limit(0)).count() == 0
